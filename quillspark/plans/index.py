"""Queries of the index: encoding, writing, reading back, and searching what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.parsing import json_object, name_id
from quillspark.operators import retrieval as R
from quillspark.plans.answers import results
from quillspark.plans.corpus import chunks
from quillspark.plans.registry import query, table
from quillspark.plans.retrieval import _encoded
from quillspark.session import shared_dir, stored
from quillspark.sources import index as I


@query(f"""WITH {_encoded("d", "doc_id", "text", "documents")},
dots AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.x * d.x) AS s FROM dv q JOIN dv d USING (b) WHERE q.id % 50 = 0 GROUP BY ALL),
r AS (SELECT q.doc_id AS query_id, d.doc_id, round(coalesce(s, 0), 4) AS score FROM documents q JOIN documents d ON q.doc_id % 50 = 0 LEFT JOIN dots ON dots.query_id = q.doc_id AND dots.doc_id = d.doc_id)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""")
def hash_embed_topk(spark: SparkSession, d: str) -> DataFrame:
    """Documents encoded, and for every fiftieth its ten nearest."""
    rows = stored(table(spark, d, "documents").select("doc_id", I.embedded(F.col("text")).alias("embedding")))
    return R.dense_topk(rows, rows.filter("doc_id % 50 = 0"), 10, "doc_id", digits=4)


@query("SELECT (SELECT count(*) FROM embeddings) AS n, (SELECT count(DISTINCT vec_id) FROM embeddings) AS ids, true AS bound")
def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as an index with its binding and read back through the check of it."""
    path = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    I.write_index(rows, path)
    return I.read_index(spark, path).agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"), F.lit(True).alias("bound"))


@query()
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic ids of the points of chunks."""
    return chunks(spark, d).select("chunk_id", name_id(F.col("chunk_id")).alias("point_id"))


@query()
def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers rendered as a model may return them, and read again."""
    body = F.to_json(F.struct("answer", "confidence"))
    raw = F.concat(F.lit("<think>{not this}</think>Here it is:\n```json\n"), body, F.lit("\n```"))
    read = results(spark, d).select("result_id", "answer", json_object(raw).alias("object"))
    fields = F.from_json("object", "answer string, confidence string")
    return read.select("result_id", fields["confidence"].alias("confidence"), fields["answer"].eqNullSafe(F.col("answer")).alias("same"))
