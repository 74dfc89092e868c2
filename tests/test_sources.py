"""Files, manifests, index binding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.sources import files, index as I


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "old").mkdir()
    for name, body in (("a/x.txt", "one"), ("y.txt", "one"), ("z.txt", "two"), ("old/w.txt", "three")):
        (tmp_path / name).write_text(body)
    found = files.discovered(spark, str(tmp_path), "*.txt", ("old",))
    assert found.count() == 3
    assert files.without_copies(found).filter("NOT kept").count() == 1
    expected = spark.createDataFrame([("z.txt", None), ("gone.txt", "0")], "name string, sha256 string")
    sha = found.filter(F.col("path").endswith("z.txt")).first().sha256
    expected = expected.withColumn("sha256", F.when(F.col("name") == "z.txt", sha).otherwise(F.col("sha256")))
    assert {r.name: r.status for r in files.manifest(found, expected).collect()} == {"z.txt": "ok", "gone.txt": "MISSING"}


def test_merge(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, files.merged(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def make(spark, order=(0, 1, 2)):
    eye = np.eye(3, 4, dtype=np.float32)
    return spark.createDataFrame([(p, f"DOC__p{i}-{i}__c{i:04d}", eye[i].tolist()) for p, i in enumerate(order)], "pos long, chunk_id string, embedding array<float>")


def test_index_binding(spark, tmp_path):
    path = str(tmp_path / "index")
    I.write_index(make(spark), path)
    assert I.read_index(spark, path).count() == 3
    with pytest.raises(Exception):
        I.write_index(make(spark), path)
    make(spark, (1, 0, 2)).write.mode("overwrite").parquet(f"{path}/vectors")  # reordered
    with pytest.raises(ValueError):
        I.read_index(spark, path)
    I.write_index(make(spark).limit(2), path, recreate=True)
    assert I.read_index(spark, path).count() == 2


def test_token_guard(spark):
    df = spark.createDataFrame([("a", 3), ("b", 900)], "chunk_id string, token_count int")
    assert I.guarded(df.filter("chunk_id = 'a'")).count() == 1
    with pytest.raises(Exception, match="over the limit"):
        I.guarded(df).collect()


def test_encoder_is_unit_and_deterministic(spark):
    df = spark.createDataFrame([("aorta repair",), ("",), (None,)], "t string")
    rows = [r.e for r in df.select(I.embedded(F.col("t")).alias("e")).collect()]
    assert abs(np.linalg.norm(rows[0]) - 1) < 1e-6 and not any(rows[1]) and not any(rows[2])


def test_preferred_folders_decide_which_copy_stays(spark, tmp_path):
    for name in ("new", "old"):
        (tmp_path / name).mkdir()
    for name in ("old/a.txt", "new/z.txt"):
        (tmp_path / name).write_text("one")
    kept = files.without_copies(files.discovered(spark, str(tmp_path), "*.txt", preferred=("new",))).filter("kept").collect()
    assert [r.path.endswith("new/z.txt") for r in kept] == [True]


def test_written_tables(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/pages")
    spark.range(3).write.parquet(f"{tmp_path}/other")
    got = {r.name: r.status for r in files.written(spark, str(tmp_path), ["pages", "chunks"]).collect()}
    assert got == {"pages": "ok", "chunks": "missing", "other": "unexpected"}


def test_chunk_store(spark, tmp_path):
    df = spark.createDataFrame([("a", "text"), ("b", None)], "chunk_id string, chunk_text string")
    path = f"{tmp_path}/store"
    files.write_chunks(df, path)
    assert files.read_chunks(spark, path).count() == 2
    assert spark.read.json(f"{path}/quality").first()["blank"] == 1
    with pytest.raises(Exception):
        files.write_chunks(df, path)
    files.write_chunks(df.union(df), path, recreate=True)
    with pytest.raises(ValueError):
        files.read_chunks(spark, path)


def test_upsert_is_checked(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(path)
    new = spark.createDataFrame([(2, "c")], "k long, v string")
    assert sorted(map(tuple, files.upserted(spark, path, new, "k").collect())) == [(1, "a"), (2, "c")]
    assert spark.read.parquet(path).count() == 2
    spark.createDataFrame([(1, "a")], "k long, v string").write.parquet(f"{tmp_path}/u")
    with pytest.raises(ValueError):
        files.upserted(spark, f"{tmp_path}/u", new.union(new), "k")


def test_frozen_json(spark, tmp_path):
    import hashlib

    (tmp_path / "x.json").write_text('{"a": "é"}')
    row = files.frozen_json(spark, f"{tmp_path}/x.json").first()
    assert row.json == '{"a": "é"}' and row.sha256 == hashlib.sha256('{"a": "é"}'.encode()).hexdigest()
