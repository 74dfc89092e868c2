"""Problem 6: items combined into containers of fixed capacity.

First-fit decreasing over a tournament tree of container capacities: the tree's nodes hold the most
room of any container below, so the first container with enough room is found from the root in as many
steps as the tree is deep. It runs independently in random groups of documents; a group holds about
``group_items`` of them whatever the size of the corpus, so groups, not their size, grow with the data.
Only ids and sizes are shuffled, never texts.

A document larger than the capacity is cut into full containers and a rest, and the rest is packed
like any item. Null and empty texts have size 0 and go into the first container with any room, or a new
one. Every row comes out, repeated rows as often as they came in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillspark.llm.tokens import DEFAULT, VOCABULARIES, tokenizer

CAPACITY = 2048
GROUP_ITEMS = 20_000


def token_count(text: Column, name: str = DEFAULT, folder: str = VOCABULARIES) -> Column:
    """Tokens of each text; 0 for null."""

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tokenizer(name, folder)
        for s in batches:
            yield pd.Series(t.counts([x if isinstance(x, str) else None for x in s]))

    return count(text)


class Bins:
    """Containers under a tournament tree of the room left in them."""

    def __init__(self, capacity: int, leaves: int):
        self.capacity, self.size = capacity, 1
        while self.size < max(1, leaves):
            self.size *= 2
        self.tree = [capacity] * (2 * self.size)

    def place(self, size: int) -> int:
        """The first container with room for ``size``, and that room taken."""
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < size:
                at += 1
        tree[at] -= size
        leaf = at - self.size
        at //= 2
        while at:
            most = tree[2 * at] if tree[2 * at] >= tree[2 * at + 1] else tree[2 * at + 1]
            if tree[at] == most:
                break
            tree[at] = most
            at //= 2
        return leaf


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; no size may exceed ``capacity``."""
    bins, out = Bins(capacity, len(sizes)), np.zeros(len(sizes), dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        out[i] = bins.place(int(sizes[i]))
    return out


def pack(sized: DataFrame, key: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, seed: int = 1) -> DataFrame:
    """``sized`` (``key``, ``n_tokens`` bigint) as one row per piece: key, ``piece_no``,
    ``piece_tokens``, ``group_no``, ``container_no`` (within its group)."""
    groups = max(1, -(-sized.count() // group_items))
    rows = sized.select(key, F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).alias("n_tokens"))
    spread = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(groups))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "n_tokens"], kind="stable", ignore_index=True)
        n = pdf["n_tokens"].to_numpy()
        pieces = np.maximum(1, -(-n // capacity))
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.where(piece < pieces[row] - 1, capacity, n[row] - (pieces[row] - 1) * capacity)
        return pd.DataFrame({key: pdf[key].to_numpy()[row], "piece_no": piece, "piece_tokens": size, "group_no": pdf["group_no"].to_numpy()[row], "container_no": first_fit_decreasing(size, capacity)})

    kind = sized.schema[key].dataType.simpleString()
    return rows.withColumn("group_no", spread).groupBy("group_no").applyInPandas(run, f"`{key}` {kind}, piece_no bigint, piece_tokens bigint, group_no bigint, container_no bigint")
