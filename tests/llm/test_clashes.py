"""Inputs with extra columns whose names the operators use inside, and nulls in every column."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import canonical, encoding, leaks, packing, repeated_lines, scans, splitting

EXTRA = ["lines", "line", "hashes", "form", "stored", "restored", "n", "pages", "word", "key", "group_no", "n_words", "band", "edge", "filled", "rank", "block"]


def wide(df):
    return df.select("*", *[F.lit("x").alias(c) for c in EXTRA if c not in df.columns])


def test_extra_columns(spark):
    pages = spark.createDataFrame([(f"p{i}", "d", "Name", i, f"Same notice here\ntext number {i * i} of its own") for i in range(6)] + [(None, None, None, None, None)], "page_key string, document_id string, document_name string, page_number int, text string")
    narrow = pages.select("page_key", "document_id", "text")
    assert repeated_lines.repeated_lines(wide(narrow)).count() == repeated_lines.repeated_lines(narrow).count()
    assert repeated_lines.clean_pages(wide(narrow)).columns == ["page_key", "document_id", "text"]
    records = pages.select(F.lit("t").alias("table_name"), F.col("page_key").alias("record_key"), "text")
    assert canonical.look_alike_pairs(canonical.same_looking(wide(records))).count() == 0
    assert encoding.garbled_texts(wide(records), ["record_key"]).count() == 0
    assert encoding.restored_texts(wide(records), "record_key").columns == wide(records).columns
    assert scans.scanned_lines(wide(pages)).count() == 12
    docs = pages.select(F.col("page_number").cast("long").alias("doc_id"), "text")
    items = spark.createDataFrame([(1, "a held out passage")], "item_id long, passage string")
    assert leaks.leaks(wide(docs), wide(items)).count() == 0
    assert splitting.split_oversized(wide(docs), "doc_id").count() == 0
    sized = docs.select("doc_id", F.length("text").cast("long").alias("n_tokens"))
    assert packing.pack(wide(sized).drop("n"), "doc_id").count() == 7


def test_all_null(spark):
    records = spark.createDataFrame([(None, None, None)] * 3, "table_name string, record_key string, text string")
    assert canonical.look_alike_pairs(canonical.same_looking(records)).count() == 0
    assert encoding.garbled_texts(records, ["record_key"]).count() == 0
    assert encoding.restored_texts(records, "record_key").count() == 3
