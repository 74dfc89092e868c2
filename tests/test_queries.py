"""Every query against its SQL twin on the smallest tables, and the plans of the main ones."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans.catalogue import QUERIES, SQL
from quillspark.streaming import windows

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        return f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    got = [tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name in SQL:
        rel = duck.execute(SQL[name])
        names = [x[0] for x in rel.description]
        want = [tuple(shown(v) for _, v in sorted(zip(names, r))) for r in rel.fetchall()]
        assert sorted(df.columns) == sorted(names)
        assert sorted(got, key=str) == sorted(want, key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_nested_loop_over_corpora(spark):
    for name in ("bm25_topk", "recommendation_attach", "passage_overlap"):
        plan = QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{D}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("tumbling").collect())) == sorted(map(str, windows.tumbling(events).collect()))
