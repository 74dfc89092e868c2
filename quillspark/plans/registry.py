"""Queries by name: what Spark runs, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.session import SPREAD

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Tables whose rows hold whole texts, on which the work is mostly computing.
TEXTS = {"documents", "pages_df", "chunks"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the folder."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    if name in TEXTS and spark.conf.get(SPREAD, "false") == "true":
        cores = spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df
    return df
