"""The vector index as a table: records with their vectors in one place, and a sidecar that binds them.

Writing refuses to replace an index unless told to, and checks what it wrote. Reading checks that count,
dimension and the digest of the ids are those of the sidecar. The digest adds up per-row hashes of position
and id, so it is order-sensitive and computed in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillspark.functions.text import lexical_tokens

TOKEN_LIMIT = 512


def hashed(tokens: Column, dim: int) -> Column:
    """The stand-in encoder's input: each token as a place among twice ``dim``, by its MD5."""
    return F.transform(tokens, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(2 * dim)).cast("int"))


def embedded(text: Column, encode: Callable[[pd.Series], np.ndarray] | None = None, dim: int = 64) -> Column:
    """Unit vectors of a text column; a text without tokens gets zeros. ``encode`` turns a series of token lists
    into rows; without it, tokens are counted by hashed place and sign."""
    tokens = lexical_tokens(F.coalesce(text, F.lit("")))

    def count(places: pd.Series) -> np.ndarray:
        both = np.stack([np.bincount(p, minlength=2 * dim) for p in places])
        return (both[:, :dim] - both[:, dim:]).astype(np.float64)

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            rows = (encode or count)(batch)
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            yield pd.Series(list((rows / np.where(norm > 0, norm, 1)).astype(np.float32)))

    return run(tokens if encode else hashed(tokens, dim))


def guarded(chunks: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    """``chunks`` as they are; a chunk beyond the token limit stops the job rather than being cut silently."""
    over = F.raise_error(F.concat(F.col("chunk_id"), F.lit(f" is over the limit of {limit} tokens")))
    return chunks.withColumn("token_count", F.when(F.col("token_count") > limit, over.cast("int")).otherwise(F.col("token_count")))


def binding(index: DataFrame) -> DataFrame:
    """Count, least and most dimension, and digest of ``index`` (pos, chunk_id, embedding): one row."""
    row = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("pos").cast("string"), "chunk_id")), 1, 15), 16, 10).cast("decimal(38,0)")
    return index.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("most_dim"), F.sum(row).cast("string").alias("digest"))


def write_index(index: DataFrame, path: str, recreate: bool = False) -> None:
    """Write ``index`` and its sidecar to ``path``; an index that is there is only replaced on ``recreate``."""
    mode = "overwrite" if recreate else "errorifexists"
    index.write.mode(mode).parquet(f"{path}/vectors")
    spark = index.sparkSession
    binding(spark.read.parquet(f"{path}/vectors")).coalesce(1).write.mode(mode).json(f"{path}/binding")
    read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index at ``path``; an error if it isn't the one its sidecar describes."""
    index = spark.read.parquet(f"{path}/vectors")
    stored = spark.read.json(f"{path}/binding").select("n", "least_dim", "most_dim", "digest").first()
    now = binding(index).select("n", "least_dim", "most_dim", "digest").first()
    if tuple(map(str, stored)) != tuple(map(str, now)):
        raise ValueError(f"index {path} does not match its binding: {stored} against {now}")
    if now["least_dim"] != now["most_dim"]:
        raise ValueError(f"index {path} has vectors of different dimensions")
    return index
