"""Gold queries whose texts have the same number (32 bits of a digest; one pair is likely among 11,000 queries)."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillspark.plans.catalogue import QUERIES, SQL
from tests.test_queries import shown

#: Both have the number 1577950150.
IMAGING, SMOKING = "Surveillance imaging of patients after repair, record 282544", "Smoking cessation should be advised before elective surgery, report 105783"
NAMES = ["run_history", "gold_metrics", "conservative_rescoring", "gold_metrics_mean", "reconstructed_metrics", "gold_evidence", "gold_coverage", "decision_gate"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("shared")
    rows = [("a", 1, IMAGING), ("c", 1, IMAGING), ("b", 4, IMAGING), ("a", 6, SMOKING), ("c", 2, SMOKING)]
    pq.write_table(pa.table(dict(zip(("document_id", "page_number", "recommendation_text"), zip(*rows)))), d / "recommendations.parquet")
    texts = [("a", 1, 2, IMAGING), ("a", 6, 6, SMOKING), ("c", 1, 2, f"{SMOKING}. {IMAGING}"), ("b", 9, 9, IMAGING), ("b", 4, 5, f"{IMAGING}. {IMAGING}"), ("a", 3, 3, "Smoking and imaging"), ("c", 7, 7, "Repair of vessels"), ("d", 1, 1, SMOKING)]
    at = datetime.datetime(2026, 1, 1)
    chunks = [(f"{doc}-{i}", doc, first, last, text, at) for i, (doc, first, last, text) in enumerate(texts)]
    pq.write_table(pa.table(dict(zip(("chunk_id", "document_id", "page_start", "page_end", "chunk_text", "ingested_at"), zip(*chunks)))), d / "chunks.parquet")
    return str(d)


@pytest.mark.parametrize("name", NAMES)
def test_texts_with_one_number_count_as_in_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("chunks", "recommendations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    found = con.execute(SQL[name])
    columns = [x[0] for x in found.description]
    want = [tuple(shown(v) for _, v in sorted(zip(columns, r))) for r in found.fetchall()]
    got = [tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    assert want and sorted(got, key=str) == sorted(want, key=str)
