"""Problem 3: prompt and response pairs that are unusable, each with its type of defect.

``empty``, ``copies_question``, ``refusal``, ``wrong_language`` and ``truncated`` are tested in this order; a
pair gets the first that holds.

Refusals: the openings of every response (its first words, those of the prompt masked, numbers folded; the longest
takes in a short response whole; also the end of its first sentence) are clustered by MinHash over runs of five
words, links verified at a similarity of 0.8. A cluster is a refusal template if it recurs across unrelated prompts
and enough of its responses carry a reason code or report insufficient evidence; every response of such a cluster
is a refusal, coded or not. A single response, coded or not, is no template.

Language: naive Bayes over hashed character trigrams, trained on a bounded sample of labelled documents.
Null responses are empty; null prompts only rule out the tests that need one. A pair delivered several
times counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.codepoints import flatten
from quillspark.llm.tokens import hashes
from quillspark.session import broadcast_if_small, stored

# Nulls spelt as text, and the pipeline's reason codes.
NULLS = ["", "nan", "none", "null", "na", "n a"]
CODES = ["potential_emergency_presentation", "patient_specific_request", "guideline_edition_unavailable", "no_chunks_retrieved", "all_scores_below_threshold", "evidence_not_specific_enough"]
ABSTAINED = "Insufficient Evidence"
#: Opening lengths in words (in the longest, one changed word leaves a similarity of 0.8), shingle, similarity, and
#: hashing of the clustering.
OPENINGS, SHINGLE, SIMILARITY, BANDS, ROWS = (4, 6, 12, 60), 5, 0.8, 8, 4
#: Words of the end of the first sentence, which also tell a template.
CLOSING = 5
#: A template: its least share of coded responses; the share of their words (by weight) that two of its prompts have
#: in common on average, at most.
CODED_SHARE, RELATED = 0.15, 0.7
#: Labelled documents per language from which the language model is trained, and its features.
SAMPLE_PER_LANGUAGE, BUCKETS = 300, 1 << 14
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
LABEL = r"^[\s*_#>\"“]*(?:[\p{L}]+(?: [\p{L}]+){0,3}\s?:|(?:yes|no|ja|nein|oui|non|sí|si|no)[.,])?[\s*_#>\"“]*"
CITATION = r"(?:\s*\[[^\[\]\n]{1,80}\])+$"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"\p{N}+", "0"), F.lit(WORD), F.lit(0))


def once(df: DataFrame) -> DataFrame:
    """Each result once, as last delivered: result_id, query, answer, coded."""
    last = df.groupBy("result_id").agg(F.max_by(F.struct("query", "answer", "refusal", "confidence"), "ingested_at").alias("x"))
    coded = F.coalesce(F.col("x.refusal").isin(CODES) | (F.col("x.confidence") == ABSTAINED), F.lit(False))
    return last.select("result_id", F.col("x.query").alias("query"), F.col("x.answer").alias("answer"), coded.alias("coded"))


def is_empty(answer: Column) -> Column:
    content = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(answer, F.lit(""))), r"\\[nrt]", " "), r"[^\p{L}\p{N}]+", " "))
    return content.isin(NULLS)


def is_copy(query: Column, answer: Column) -> Column:
    """Nothing but the prompt's words, with few changed, dropped or added."""
    q, a = words(query), words(answer)
    extra, missing = F.size(F.array_except(a, q)), F.size(F.array_except(q, a))
    n = F.size(F.array_distinct(q))
    return F.coalesce((n >= 3) & (F.size(a) <= F.size(q) * 1.25 + 3) & (extra <= F.greatest(F.lit(3), n * 0.2)) & (missing <= F.greatest(F.lit(1), n * 0.25)), F.lit(False))


def is_truncated(answer: Column) -> Column:
    """Whether the response breaks off: its last line ends without an end mark, a closed bracket or a
    citation, and isn't an item of a list whose items have none."""
    text = F.regexp_replace(F.regexp_replace(answer, r"[\s*_\x{200b}\x{feff}]+$", ""), CITATION, "")
    text = F.regexp_replace(text, r"[\s*_]+$", "")
    marks = text.rlike(r"[.!?…。！？][\"'”’»)\]]*$")
    closed = text.rlike(r"\([^()\n]*\)$") | text.rlike(r"[”»]$")
    open_bracket = text.rlike(r"[\[(][^\])\n]*$")
    items = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*(?:[-*•–]|\d+[.)])\s+\S"))
    last_item = F.element_at(F.split(text, "\n"), -1).rlike(r"^\s*(?:[-*•–]|\d+[.)])\s+\S+\s\S")
    bare = ~F.exists(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), lambda x: x.rlike(r"[.!?…]\s*$"))
    bullet = F.element_at(F.split(text, "\n"), -1).rlike(r"^\s*[-*•–]\s")
    listed = last_item & bare & (bullet | (F.size(items) > 1)) & ~text.rlike(r"[,;:(/=–-]$")
    return F.coalesce(open_bracket | ~(marks | closed | listed), F.lit(False))


# Refusals


def openings(pairs: DataFrame) -> DataFrame:
    """Openings of each response, and the end of its first sentence (after a mark that no word is):
    result_id, query, coded, opening (array of words)."""
    # Step by step, so that no list of words is made twice.
    rows = pairs.select("result_id", "query", "coded", F.regexp_replace(F.lower("answer"), LABEL, "").alias("body"))
    sentence = F.regexp_extract("body", r"^[^.!?\n]*", 0)
    rows = rows.select("result_id", "query", "coded", F.slice(words(F.col("body")), 1, 2 * max(OPENINGS)).alias("a"), words(sentence).alias("sentence"), words(F.col("query")).alias("q"))
    # Words of the prompt become a slot, several in a row one slot; short words stay.
    masked = F.transform("a", lambda x: F.when((F.length(x) > 4) & F.array_contains("q", x), F.lit("_")).otherwise(x))
    rows = rows.select("result_id", "query", "coded", masked.alias("masked"), "sentence")
    one = F.filter("masked", lambda x, i: ~((x == "_") & (i > 0) & (F.get("masked", i - 1) == "_")))
    closing = F.concat(F.array(F.lit("$")), F.slice("sentence", -CLOSING, CLOSING))
    rows = rows.select("result_id", "query", "coded", one.alias("words"), F.when(F.size("sentence") >= CLOSING, closing).alias("closing"))
    return rows.select("result_id", "query", "coded", F.explode(F.array(*[F.slice("words", 1, n) for n in OPENINGS], "closing")).alias("opening")).filter(F.size("opening") > 1)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each opening (hashes of its words) the set of its runs and the MinHash bands of that set."""
    rng = np.random.default_rng(7)
    factor = rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64)
    for batch in batches:
        lists = batch.column("hashes")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        h = lists.values.to_numpy().astype(np.int64).view(np.uint64)
        n = np.maximum(1, np.diff(bounds) - SHINGLE + 1)  # shorter ones are one run
        first = np.cumsum(n) - n
        row = np.repeat(np.arange(len(n)), n)
        at = bounds[:-1][row] + np.arange(len(row)) - first[row]
        run = np.zeros(len(row), dtype=np.uint64)
        for j in range(SHINGLE):
            there = at + j < bounds[1:][row]
            run = run * np.uint64(0x9E3779B97F4A7C15) + np.where(there, h[np.minimum(at + j, max(0, len(h) - 1))], np.uint64(1))
        run ^= run >> np.uint64(31)
        pair = np.unique(np.stack((row.astype(np.uint64), run)), axis=1) if len(row) else np.zeros((2, 0), np.uint64)
        row, run = pair[0].astype(np.int64), pair[1]
        start = np.searchsorted(row, np.arange(len(n) + 1))
        bands = np.zeros((len(n), BANDS), dtype=np.uint64)
        for b in range(BANDS if len(n) else 0):
            for k in range(b * ROWS, (b + 1) * ROWS):
                mixed = run * factor[k] + add[k]
                low = np.minimum.reduceat(mixed ^ mixed >> np.uint64(29), start[:-1])
                bands[:, b] = (bands[:, b] + low) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(b)
        runs = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(run.view(np.int64)))
        keys = pa.ListArray.from_arrays(pa.array((np.arange(len(n) + 1) * BANDS).astype(np.int32)), pa.array(bands.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("node"), runs, keys], names=["node", "runs", "bands"])


def _distance(a: Column, b: Column) -> Column:
    """One less the similarity of two sets of runs: a metric."""
    shared = F.size(F.array_intersect(a, b))
    return 1 - shared / (F.size(a) + F.size(b) - shared)


def _prefixes(sets: DataFrame, rarity: DataFrame) -> DataFrame:
    """The rarest runs of each of ``sets`` (node, runs), as many as two similar sets can't both lack: node, run."""
    each = sets.select("node", F.size("runs").alias("n"), F.explode("runs").alias("run")).join(rarity, "run")
    enough = (F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-9) + 1).cast("int")
    rare = each.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "run"))).alias("rare"))
    return rare.select("node", F.explode(F.slice("rare", F.lit(1), enough)).alias("x")).select("node", "x.run")


def links(nodes: DataFrame) -> DataFrame:
    """Links of similar ``nodes`` (node, runs, bands) that share a band, as many as join them all: node, other.

    In every band the nodes near its first one are linked with that, which joins them with one another too. The others
    go on to a next round among themselves while a round leaves less than half of them. What is left then (and what a
    round left, against what it didn't) meets by its rarest runs, of which similar sets share one at least: all pairs
    of a band are never formed, and no link is lost that would join what isn't joined.
    """
    least = 1 - SIMILARITY + 1e-9
    all_bands = nodes.filter(F.size("runs") > 1).select("node", F.explode("bands").alias("band"))
    many = all_bands.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1").select("band")
    left = stored(all_bands.join(many, "band"))
    sets = stored(nodes.select("node", "runs").join(left.select("node").distinct(), "node"))
    found, others, n = [], None, left.count()
    while n:
        heads = left.groupBy("band").agg(F.min("node").alias("head")).join(sets.select(F.col("node").alias("head"), F.col("runs").alias("head_runs")), "head")
        met = stored(left.join(sets, "node").join(heads, "band").select("node", "band", "head", _distance(F.col("runs"), F.col("head_runs")).alias("d")))
        found.append(met.filter((F.col("d") <= least) & (F.col("node") != F.col("head"))).select("node", F.col("head").alias("other")))
        far = met.filter(F.col("d") > least).select("node", "band")
        others = far.select("node") if others is None else others.unionAll(far.select("node"))
        left, before = far, n
        n = left.count()
        if 2 * n > before:
            break
    if others is None:
        return nodes.select("node", F.col("node").alias("other")).filter("false")
    rarity = sets.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count("*").alias("df"))
    prefixes = stored(_prefixes(sets, rarity))
    far = prefixes.join(others.distinct(), "node").select(F.col("node").alias("other"), "run")
    pairs = prefixes.join(far, "run").filter("node <> other").select("node", "other").distinct()
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("other"), F.col("runs").alias("other_runs")), "other")
    out = both.filter(_distance(F.col("runs"), F.col("other_runs")) <= least).select("node", "other")
    for part in found:
        out = out.unionAll(part)
    return stored(out.distinct())


def components(pairs: DataFrame) -> DataFrame:
    """The least node of the component of every linked node of ``pairs`` (node, other): node, cluster. Labels go to
    neighbours, then to the label of the label, until none changes."""
    edges = stored(pairs.unionAll(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    label = stored(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("cluster")))
    while True:
        best = edges.join(label.select(F.col("node").alias("other"), "cluster"), "other").groupBy("node").agg(F.min("cluster").alias("least"))
        moved = label.join(best, "node").select("node", F.col("cluster").alias("old"), F.least("cluster", "least").alias("cluster"))
        jump = label.select(F.col("node").alias("cluster"), F.col("cluster").alias("root"))
        moved = stored(moved.join(jump, "cluster", "left").select("node", "old", F.least("cluster", F.coalesce("root", "cluster")).alias("cluster")))
        done = moved.filter("old <> cluster").isEmpty()
        label = moved.select("node", "cluster")
        if done:
            return label


def node_of(opening: Column) -> Column:
    """The number under which an opening is known."""
    return F.xxhash64(F.array_join(opening, " "))


def clusters(found: DataFrame) -> DataFrame:
    """The cluster of each distinct opening: node (see ``node_of``), cluster (the least node in it)."""
    hashed = found.select(node_of(F.col("opening")).alias("node"), F.transform("opening", lambda x: F.xxhash64(x)).alias("hashes")).dropDuplicates(["node"])
    nodes = stored(hashed.mapInArrow(_signatures, "node long, runs array<long>, bands array<long>"))
    linked = components(links(nodes))
    return nodes.select("node").join(linked, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


def unrelated(prompts: DataFrame, all_prompts: DataFrame) -> DataFrame:
    """Clusters of ``prompts`` (cluster, query) with at least two prompts of which an average pair has no more than
    ``RELATED`` of its words in common, rare words weighing more: cluster. The average over all pairs follows from how
    many prompts hold each word, so no pair is formed."""
    distinct = lambda c: F.explode(F.array_distinct(words(F.col(c)))).alias("word")
    asked = all_prompts.select("query").filter("query IS NOT NULL").distinct()
    total = F.lit(float(asked.count()))
    weight = asked.select(distinct("query")).groupBy("word").agg((F.log(total / F.count("*")) + 0.05).alias("weight"))
    own = stored(prompts.filter("query IS NOT NULL").distinct())
    held = own.select("cluster", distinct("query")).groupBy("cluster", "word").agg(F.count("*").alias("c")).join(weight, "word")
    sums = held.groupBy("cluster").agg(F.sum(F.col("weight") * F.col("c") * (F.col("c") - 1)).alias("both"), F.sum(F.col("weight") * F.col("c")).alias("one"))
    sizes = own.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1")
    return sizes.join(sums, "cluster").filter(F.col("both") <= RELATED * (F.col("n") - 1) * F.col("one")).select("cluster")


def refusals(pairs: DataFrame) -> DataFrame:
    """Results whose response follows a refusal template: result_id."""
    found = stored(openings(pairs))
    named = stored(found.select("result_id", "query", "coded", node_of(F.col("opening")).alias("node")).join(clusters(found), "node").select("result_id", "query", "coded", "cluster"))
    counted = named.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if("coded").alias("coded"))
    enough = broadcast_if_small(stored(counted.filter((F.col("coded") >= F.col("n") * CODED_SHARE) & (F.col("coded") >= 1) & (F.col("n") > 1)).select("cluster")))
    likely = named.join(enough, "cluster", "left_semi")
    template = broadcast_if_small(stored(unrelated(likely.select("cluster", "query"), pairs)))
    return likely.join(template, "cluster", "left_semi").select("result_id").distinct()


# Languages


@cache
def _letters() -> np.ndarray:
    """The lower case of each letter of the basic plane; a blank for anything else."""
    out = np.full(0x10001, 32, dtype=np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha() and len(ch.lower()) == 1:
            out[c] = ord(ch.lower())
    return out


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of texts, and the index of the text of each: the trigram around every letter (words
    are between blanks), and every word."""
    flat, starts = flatten(texts)
    c = _letters()[np.minimum(flat, 0x10000)]
    inside = c != 32
    at = np.flatnonzero(inside)
    wide = c.astype(np.int64)
    trigrams = (wide[at - 1] * 961 + wide[at] * 31279 + wide[at + 1] * 7919) % BUCKETS
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    whole = (hashes(c, begin, end) >> np.uint64(50)).astype(np.int64) % BUCKETS
    place = np.concatenate((at, begin))
    return np.concatenate((trigrams, whole)), np.searchsorted(starts, place, side="right") - 1


def train_languages(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities of the features, from up to ``SAMPLE_PER_LANGUAGE`` documents of each."""
    labelled = documents.filter(F.col("lang").isNotNull() & (F.col("n_chars") > 200)).select("doc_id", "lang")
    pick = labelled.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id")))).filter(F.col("r") <= SAMPLE_PER_LANGUAGE)
    rows = documents.select("doc_id", "text").join(F.broadcast(pick.select("doc_id", "lang")), "doc_id").select("lang", "text").collect()
    names = sorted({r.lang for r in rows})
    counts = np.full((len(names), BUCKETS), 0.1)
    for name in names:
        mine = [r.text for r in rows if r.lang == name]
        for i in range(0, len(mine), 50):
            counts[names.index(name)] += np.bincount(_features(mine[i : i + 50])[0], minlength=BUCKETS)
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def foreign_answers(pairs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Results whose response is mainly in another language than the prompt: result_id."""
    names, table = model
    known = pairs.sparkSession.sparkContext.broadcast(table)

    def languages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest language of each text (-1 for none) and its lead over the next."""
        best, lead = np.full(len(texts), -1), np.zeros(len(texts))
        for first in range(0, len(texts), 1000):
            part = texts[first : first + 1000]
            feature, of = _features(part)
            scores = np.stack([np.bincount(of, known.value[k][feature], minlength=len(part)) for k in range(len(names))], axis=1)
            order = np.sort(scores, axis=1)
            some = np.bincount(of, minlength=len(part)) > 0
            best[first : first + len(part)] = np.where(some, scores.argmax(axis=1), -1)
            lead[first : first + len(part)] = order[:, -1] - order[:, -2] if len(names) > 1 else 0
        return best, lead

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not names:
                continue
            (q, ql), (a, al) = languages(pdf["query"].fillna("").tolist()), languages(pdf["answer"].fillna("").tolist())
            yield pdf.loc[(q >= 0) & (a >= 0) & (q != a) & (al > 3) & (ql > 1), ["result_id"]]

    # Quoted passages and citations don't tell the language of the response.
    quoted = F.regexp_replace("answer", r"“[^”]*”|«[^»]*»|„[^“]*“|\"[^\"]*\"|\[[^\]]*\]", " ")
    body = F.when(F.size(words(quoted)) >= 4, quoted).otherwise(F.col("answer"))
    return pairs.select("result_id", "query", body.alias("answer")).mapInPandas(run, "result_id long")


def defects(results: DataFrame, documents: DataFrame) -> DataFrame:
    """Unusable pairs of ``results`` with their type: result_id, defect."""
    pairs = stored(once(results).withColumn("early", F.when(is_empty(F.col("answer")), "empty").when(is_copy(F.col("query"), F.col("answer")), "copies_question")))
    rest = pairs.filter("early IS NULL")
    declined = refusals(rest).withColumn("declined", F.lit(True))
    foreign = foreign_answers(rest, train_languages(documents)).withColumn("other", F.lit(True))
    joined = pairs.join(declined, "result_id", "left").join(foreign, "result_id", "left")
    kind = F.coalesce("early", F.when(F.col("declined"), "refusal").when(F.col("other"), "wrong_language").when(is_truncated(F.col("answer")), "truncated"))
    return joined.select("result_id", kind.alias("defect")).filter("defect IS NOT NULL")
