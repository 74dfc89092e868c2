"""The tables that the problems read, each row once however often it was delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages_df.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Texts of pages and chunks: table_name, record_key, text. Deliveries may repeat."""
    p = pages(spark, d).select(F.lit("pages_df").alias("table_name"), F.col("page_key").alias("record_key"), F.col("raw_text").alias("text"))
    c = spark.read.parquet(f"{d}/chunks.parquet").select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("record_key"), F.col("chunk_text").alias("text"))
    return p.unionAll(c)
