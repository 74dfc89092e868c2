"""Problem 1: lines that come back on page after page of one document.

1. Heavy-hitter summaries. Each task keeps a Misra-Gries summary of the line hashes of every document it
   meets, with as many counters as make its error less than a tenth of its pages. Summaries merge by
   adding counters in an ordinary aggregation, so over all tasks the error stays less than a tenth of the
   document's pages: no line on the required fifth of them is missed. Texts are not shuffled.
2. Exact counts. The lines that match a candidate are counted over distinct pages by their full folded
   form; a candidate that is not repeated enough (or only shares a hash) drops out.
3. Removal. The confirmed lines of a document, as one set per document, are broadcast while the sets are
   few and otherwise joined, and each page is filtered by its document's set.

Pages without text take no part. A page delivered several times counts once. No page, one page, or a
document without a repeated line give no rows (``clean_pages`` gives the text as it was).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.lines import folded_line, numbered_lines
from quillspark.session import broadcast_if_small, is_small, stored

LEAST_PAGES, LEAST_SHARE = 5, 5  # on at least so many pages, and on at least one page in so many
#: A summary's error is below one page in so many.
ERROR = 2 * LEAST_SHARE
#: Counters that a task holds at once; only memory depends on it.
HELD = 1_000_000
#: Parts over which a document's pages are spread where its set of lines is joined and not broadcast.
SPREAD = 16


class Summary:
    """A Misra-Gries summary whose number of counters follows what it has seen."""

    def __init__(self) -> None:
        self.pages = self.lines = self.lost = self.checked = 0
        self.counters: Counter[int] = Counter()

    def add(self, hashes: list[int]) -> None:
        self.pages += 1
        self.lines += len(hashes)
        self.counters.update(hashes)
        room = ERROR * -(-self.lines // self.pages) + 1
        if len(self.counters) > max(2 * room, self.checked):
            self.shrink(room)
            self.checked = 2 * len(self.counters)

    def shrink(self, room: int) -> None:
        """Take from every counter what the first beyond the room holds, if the error allows."""
        cut = sorted(self.counters.values(), reverse=True)[room]
        if (self.lost + cut) * ERROR < self.pages:
            self.lost += cut
            self.counters = Counter({h: n - cut for h, n in self.counters.items() if n > cut})


def _summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Summaries of a task's documents; handed on, and begun anew, whenever they hold ``HELD`` counters (summaries
    merge by addition, so that changes no result)."""
    summaries: dict[str, Summary] = {}
    held = 0
    for pdf in batches:
        for document, hashes in zip(pdf["document_id"], pdf["hashes"]):
            summary = summaries.setdefault(document, Summary())
            held -= len(summary.counters)
            summary.add(hashes.tolist())
            held += len(summary.counters)
            if held > HELD:
                yield _rows(summaries)
                summaries, held = {}, 0
    yield _rows(summaries)


def _rows(summaries: dict[str, Summary]) -> pd.DataFrame:
    rows = [(d, s.lost if i == 0 else 0, h, n) for d, s in summaries.items() for i, (h, n) in enumerate(s.counters.items() or [(0, 0)])]
    return pd.DataFrame(rows, columns=["document_id", "lost", "line_hash", "n"]).astype({"lost": "int64", "line_hash": "int64", "n": "int64"})


def _lines_of(text):
    return F.filter(F.transform(F.split(text, "\n"), folded_line), lambda x: x.rlike(r"\p{L}"))


def candidates(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """``pages`` (document_id, text) as (document_id, line_hash): every line that may be on enough of its
    document's ``sizes`` (document_id, pages), and few others."""
    hashed = pages.select("document_id", F.array_distinct(F.transform(_lines_of(F.col("text")), lambda x: F.xxhash64(x))).alias("hashes"))
    summary = hashed.mapInPandas(_summarise, "document_id string, lost long, line_hash long, n long")
    counted = stored(summary.groupBy("document_id", "line_hash").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost")))
    bounds = counted.groupBy("document_id").agg(F.sum("lost").alias("lost")).join(sizes, "document_id")
    least = bounds.select("document_id", (F.greatest(F.col("pages") / LEAST_SHARE, F.lit(float(LEAST_PAGES))) - F.col("lost")).alias("least"))
    # A page delivered twice counts twice here, which only lets in more candidates.
    return counted.join(least, "document_id").filter("n > 0 AND n >= least").select("document_id", "line_hash")


def repeated_lines(pages: DataFrame) -> DataFrame:
    """Lines of ``pages`` (page_key, document_id, text) that are repeated within their document:
    page_key, document_id, line_no (from 1), line (folded)."""
    pages = pages.select("page_key", "document_id", "text").filter(F.col("text").isNotNull() & (F.length(F.trim("text")) > 0))
    sizes = stored(pages.select("document_id", "page_key").distinct().groupBy("document_id").agg(F.count("*").alias("pages")))
    few = broadcast_if_small(stored(candidates(pages, sizes)))
    lines = pages.select("page_key", "document_id", numbered_lines(F.col("text")).alias("pos", "raw"))
    folded = lines.select("page_key", "document_id", (F.col("pos") + 1).cast("long").alias("line_no"), folded_line(F.col("raw")).alias("line")).filter(F.col("line").rlike(r"\p{L}"))
    met = folded.withColumn("line_hash", F.xxhash64("line")).join(few, ["document_id", "line_hash"], "left_semi").drop("line_hash")
    met = stored(met.distinct())
    on = met.select("document_id", "line", "page_key").distinct().groupBy("document_id", "line").agg(F.count("*").alias("n"))
    enough = on.filter(F.col("n") >= LEAST_PAGES).join(sizes, "document_id").filter(F.col("n") * LEAST_SHARE >= F.col("pages"))
    confirmed = broadcast_if_small(stored(enough.select("document_id", "line")))
    return met.join(confirmed, ["document_id", "line"], "left_semi").select("page_key", "document_id", "line_no", "line")


def clean_pages(pages: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """``pages`` (page_key, document_id, text), once each, without the repeated lines."""
    pages = pages.select("page_key", "document_id", "text")
    found = repeated if repeated is not None else repeated_lines(pages)
    sets = stored(found.groupBy("document_id").agg(F.collect_set("line").alias("lines")))
    once = pages.dropDuplicates(["page_key"])
    if is_small(sets):
        once = once.join(F.broadcast(sets), "document_id", "left")
    else:  # one document may hold a third of all pages: its set goes to each of its parts
        parts = sets.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        once = once.withColumn("part", F.pmod(F.xxhash64("page_key"), F.lit(SPREAD)).cast("int")).join(parts, ["document_id", "part"], "left")
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("lines", folded_line(x)))
    return once.select("page_key", "document_id", F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
