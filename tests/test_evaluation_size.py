"""What the queries of evaluation write on their way grows with chunks and queries, not with their pairs."""

import os

import pytest

from quillspark import session
from quillspark.plans.catalogue import QUERIES

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.mark.parametrize("name", ["decision_gate", "gold_evidence", "run_history", "gold_metrics", "conservative_rescoring", "gold_metrics_mean", "reconstructed_metrics"])
def test_no_row_is_stored_per_chunk_and_term(spark, name):
    session.clear_stored(spark)
    assert QUERIES[name](spark, D).count()
    rows = [spark.read.parquet(path).count() for path in session._WRITTEN]
    assert rows and max(rows) <= spark.read.parquet(f"{D}/chunks.parquet").count()
