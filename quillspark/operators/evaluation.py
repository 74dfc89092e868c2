"""Relevance of hits by required facts and answer passages, and the measures that rest on it.

A gold query has ``passages`` (array of struct: document_id, page_start, page_end), ``groups`` of facts (array of arrays of
patterns) and ``needed``, the least number of groups. A hit is relevant if, in normal form, it satisfies that many groups
(each by any pattern) and its pages overlap a passage of its document. Recall counts passages, not hits. Rows of one query
are at most its hits; nothing is collected beyond that. Null texts satisfy nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ["p_at_1", "p_at_3", "p_at_5", "rr", "recall_at_5", "recall_at_10"]


def covered(form: Column, groups: Column) -> Column:
    """How many groups a text in normal form satisfies."""
    return F.coalesce(F.size(F.filter(groups, lambda g: F.exists(g, lambda p: F.regexp(form, p)))), F.lit(0))


def judged(hits: DataFrame, texts: DataFrame, gold: DataFrame) -> DataFrame:
    """``hits`` (query_id, rank, chunk_id) with the pages and facts of ``texts`` (chunk_id, document_id, page_start, page_end,
    form) by ``gold`` (query_id, passages, groups, needed): ``covered``, ``needed``, ``passages`` matched (places), ``relevant``."""
    both = hits.join(texts, "chunk_id").join(gold.select("query_id", F.col("passages").alias("answers"), "groups", "needed"), "query_id")
    both = both.withColumn("covered", covered(F.col("form"), F.col("groups")))
    overlaps = lambda p: (p["document_id"] == F.col("document_id")) & (F.col("page_start") <= p["page_end"]) & (F.col("page_end") >= p["page_start"])
    places = F.filter(F.transform("answers", lambda p, i: F.when(overlaps(p), i)), lambda i: i.isNotNull())
    none = F.expr("cast(array() AS array<int>)")
    met = F.when((F.col("covered") >= F.col("needed")) & F.col("page_start").isNotNull() & F.col("page_end").isNotNull(), places).otherwise(none)
    return both.select("query_id", "rank", "chunk_id", "document_id", "page_start", "page_end", F.col("covered").cast("long").alias("covered"), "needed", met.alias("passages"), (F.size(met) > 0).alias("relevant"))


def scores(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """Measures per query of ``gold`` from judged ``rows``: P@k over k even with fewer hits, reciprocal rank within ten,
    share of the passages met within k. Queries without hits get zeros. Where queries share a ``query_id``, a hit that is
    relevant to any of them counts, once, for each."""
    top = lambda k: F.size(F.collect_set(F.when((F.col("rank") <= k) & F.col("relevant"), F.col("rank"))))
    met = lambda k: F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= k, F.col("passages"))))))
    per = rows.groupBy("query_id").agg(top(1).alias("h1"), top(3).alias("h3"), top(5).alias("h5"), F.min(F.when(F.col("relevant") & (F.col("rank") <= 10), F.col("rank"))).alias("first"), met(5).alias("m5"), met(10).alias("m10"))
    n = F.size("passages")
    out = gold.select("query_id", "passages").join(per, "query_id", "left").fillna(0, ["h1", "h3", "h5", "m5", "m10"])
    recall = lambda c: F.when(n > 0, F.col(c) / n).otherwise(0.0)
    return out.select("query_id", F.col("h1").cast("double").alias("p_at_1"), (F.col("h3") / 3).alias("p_at_3"), (F.col("h5") / 5).alias("p_at_5"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), recall("m5").alias("recall_at_5"), recall("m10").alias("recall_at_10"), F.col("first").cast("long").alias("first_relevant_rank"), (F.col("h5") > 0).alias("answering_at_5"), n.cast("long").alias("n_passages"))


def mean_scores(per_query: DataFrame) -> DataFrame:
    """Means over queries, to four places, and counts: one row."""
    means = [F.round(F.avg(c), 4).alias(c) for c in MEASURES]
    return per_query.agg(F.count("*").alias("n_queries"), *means, F.count_if(F.col("p_at_1") > 0).alias("relevant_top1"), F.count_if("answering_at_5").alias("answering_at_5"))


def start_page_only(texts: DataFrame) -> DataFrame:
    """``texts`` as if every chunk ended on the page it begins on."""
    return texts.withColumn("page_end", F.col("page_start"))


def narrowed(texts: DataFrame, by: int = 0) -> DataFrame:
    """``texts`` whose spans are widened by ``by`` pages at either end (narrowed, if it is negative; never to nothing)."""
    start = F.greatest(F.col("page_start") - by, F.lit(1))
    return texts.withColumn("page_start", start).withColumn("page_end", F.greatest(F.col("page_end") + by, start))


def decision(base: DataFrame, new: DataFrame, target: float = 0.55, within: float = 0.051, drop: float = 0.05) -> DataFrame:
    """Whether a run may replace another, from their mean scores: its P@1 near the target and no measure much lower."""
    watched = ["p_at_1", "rr", "recall_at_5", "recall_at_10"]
    worse = F.lit(False)
    for c in watched:
        worse = worse | (F.col(f"n.{c}") < F.col(f"b.{c}") - drop)
    near = F.abs(F.col("n.p_at_1") - target) <= within
    both = base.withColumn("k", F.lit(1)).alias("b").join(new.withColumn("k", F.lit(1)).alias("n"), "k")
    return both.select(F.col("n.p_at_1").alias("p_at_1"), near.alias("near_target"), worse.alias("regressed"), F.when(near & ~worse, "adopt with caveats").otherwise("reopen").alias("decision"))
