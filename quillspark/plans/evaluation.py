"""Queries of evaluation by facts, pages and passages. The gold queries are made from the recommendations: each text is a
question (every text whose number is divisible by 50), answered on the page that holds it and the one after, in every document
that has it; its long words are the facts, two thirds of which a chunk must hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import evaluation as E
from quillspark.operators import retrieval as R
from quillspark.plans.answers import _RESULTS, cmp_sql, results
from quillspark.plans.corpus import _CHUNKS, chunks, once
from quillspark.plans.registry import query, table
from quillspark.plans.retrieval import _folded
from quillspark.session import broadcast_if_small, shared_dir, stored

_WORDS = "[a-z]{7,}"
_TOKENS = "regexp_extract_all(lower({t}), '[0-9]+(?:\\.[0-9]+)?|[a-z]+(?:''[a-z]+)?')"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """query_id, query, passages, groups, needed."""
    number = F.conv(F.substring(F.md5("recommendation_text"), 1, 8), 16, 10).cast("long")
    rows = table(spark, d, "recommendations").filter("recommendation_text IS NOT NULL").select(number.alias("query_id"), F.col("recommendation_text").alias("query"), F.struct("document_id", F.col("page_number").alias("page_start"), (F.col("page_number") + 1).alias("page_end")).alias("p"))
    # Texts may share a number (32 bits): each is a row of its own, with the passages of all.
    per = rows.filter("query_id % 50 = 0").groupBy("query_id").agg(F.array_sort(F.collect_set("p")).alias("passages"), F.collect_set("query").alias("query")).withColumn("query", F.explode("query"))
    words = F.array_distinct(F.regexp_extract_all(T.compared(F.col("query")), F.lit(_WORDS), F.lit(0)))
    per = per.withColumn("groups", F.transform(words, lambda w: F.array(w)))
    return stored(per.withColumn("needed", F.ceil(F.size("groups") * 2 / 3).cast("long")))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", "document_id", "page_start", "page_end", "chunk_text")


def _formed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("form", T.compared(F.col("chunk_text"))).drop("chunk_text")


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold queries, ten hits of each by BM25, and the texts of these hits."""
    gold, delivered = _gold(spark, d), table(spark, d, "chunks")
    hits = stored(R.bm25_best(delivered.select("chunk_id", F.col("chunk_text").alias("text")), gold.select("query_id", "query"), 10, "chunk_id").select("query_id", "rank", "chunk_id"))
    found = stored(hits.select("chunk_id").distinct())
    held = once(delivered.join(broadcast_if_small(found), "chunk_id", "left_semi"), "chunk_id")
    return gold, hits, stored(_formed(held.select("chunk_id", "document_id", "page_start", "page_end", "chunk_text")))


_BASE = f"""
WITH g0 AS (SELECT ('0x' || substr(md5(recommendation_text), 1, 8))::BIGINT AS query_id, recommendation_text AS query, document_id, page_number AS a, page_number + 1 AS b FROM recommendations WHERE recommendation_text IS NOT NULL),
pas AS (SELECT DISTINCT query_id, document_id, a, b FROM g0 WHERE query_id % 50 = 0),
gold AS (SELECT query_id, query, list_distinct(regexp_extract_all({cmp_sql('query')}, '{_WORDS}')) AS words FROM (SELECT DISTINCT query_id, query FROM g0 WHERE query_id % 50 = 0)),
need AS (SELECT query_id, words, ceil(len(words) * 2 / 3)::BIGINT AS needed, (SELECT count(*) FROM pas p WHERE p.query_id = gold.query_id) AS n_passages FROM gold),
txt AS (SELECT chunk_id, document_id, page_start, page_end, chunk_text FROM {_CHUNKS}),
rq AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOKENS.format(t=_folded('query'))}) AS term FROM gold) GROUP BY ALL),
rd AS (SELECT chunk_id, {_TOKENS.format(t=_folded("coalesce(chunk_text, '')"))} AS toks FROM txt),
rs AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM rd),
rt AS (SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, len(toks) AS length, unnest(toks) AS term FROM rd) WHERE term IN (SELECT term FROM rq) GROUP BY ALL),
ri AS (SELECT term, ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM rt, rs GROUP BY term),
sc AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) AS score FROM rt JOIN rq USING (term) JOIN ri USING (term), rs GROUP BY ALL),
hits AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= 10)
"""


def _judged_sql(name: str, end: str = "page_end") -> str:
    return f"""{name} AS (SELECT h.query_id, h.rank, h.chunk_id, t.document_id, t.page_start, t.{end} AS page_end, needed, n_passages, len(list_filter(words, lambda w: contains({cmp_sql('t.chunk_text')}, w))) AS covered
  FROM hits h JOIN txt t USING (chunk_id) JOIN need USING (query_id)),
{name}m AS (SELECT j.query_id, j.rank, p.document_id, p.a FROM {name} j JOIN pas p ON p.query_id = j.query_id AND p.document_id = j.document_id AND j.page_start <= p.b AND j.page_end >= p.a WHERE covered >= needed),
{name}r AS (SELECT query_id, rank FROM {name}m GROUP BY ALL),
{name}s AS (SELECT n.query_id, (SELECT count(*) FROM {name}r r WHERE r.query_id = n.query_id AND rank <= 1)::DOUBLE AS p_at_1, (SELECT count(*) FROM {name}r r WHERE r.query_id = n.query_id AND rank <= 3) / 3 AS p_at_3,
  (SELECT count(*) FROM {name}r r WHERE r.query_id = n.query_id AND rank <= 5) / 5 AS p_at_5, coalesce(1 / (SELECT min(rank) FROM {name}r r WHERE r.query_id = n.query_id), 0.0)::DOUBLE AS rr,
  (SELECT count(DISTINCT (document_id, a)) FROM {name}m m WHERE m.query_id = n.query_id AND rank <= 5) / n_passages AS recall_at_5, (SELECT count(DISTINCT (document_id, a)) FROM {name}m m WHERE m.query_id = n.query_id) / n_passages AS recall_at_10,
  (SELECT min(rank) FROM {name}r r WHERE r.query_id = n.query_id) AS first_relevant_rank, EXISTS (SELECT 1 FROM {name}r r WHERE r.query_id = n.query_id AND rank <= 5) AS answering_at_5, n_passages FROM need n),
{name}a AS (SELECT count(*) AS n_queries, {', '.join(f'round(avg({c}), 4) AS {c}' for c in E.MEASURES)}, count(*) FILTER (p_at_1 > 0) AS relevant_top1, count(*) FILTER (answering_at_5) AS answering_at_5 FROM {name}s)
"""


_SCORED = _BASE + "," + _judged_sql("j")
_BOTH = _SCORED + "," + _judged_sql("k", "page_start")


@query(_SCORED + """SELECT j.query_id, j.rank, j.chunk_id, covered::BIGINT AS covered, needed, (SELECT count(*) FROM jm m WHERE m.query_id = j.query_id AND m.rank = j.rank) AS passages,
  EXISTS (SELECT 1 FROM jr r WHERE r.query_id = j.query_id AND r.rank = j.rank) AS relevant FROM j""")
def gold_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every hit with the facts and passages it meets."""
    gold, hits, texts = _run(spark, d)
    hit = W.partitionBy("query_id", "rank")  # more than one row where texts share a number
    return E.judged(hits, texts, gold).select("query_id", "rank", "chunk_id", "covered", "needed", F.sum(F.size("passages")).over(hit).alias("passages"), F.bool_or("relevant").over(hit).alias("relevant"))


@query(_SCORED + "SELECT * FROM js")
def gold_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Measures per query."""
    gold, hits, texts = _run(spark, d)
    return E.scores(E.judged(hits, texts, gold), gold)


@query(_SCORED + "SELECT * FROM ja")
def gold_metrics_mean(spark: SparkSession, d: str) -> DataFrame:
    """Measures over all queries."""
    return E.mean_scores(gold_metrics(spark, d))


_KEYS = ["p_at_1", "rr", "recall_at_5", "recall_at_10"]


@query(_BOTH + f"""SELECT {', '.join(f'ja.{c} AS {c}, ka.{c} AS {c}_strict, round(ka.{c} - ja.{c}, 4) AS {c}_delta' for c in _KEYS)},
  (SELECT round(100 * avg((page_end > page_start)::INT), 1) FROM j) AS multipage FROM ja, ka""")
def conservative_rescoring(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking judged as if every chunk ended on its first page: what wide page spans are worth."""
    gold, hits, texts = _run(spark, d)
    rows = E.judged(hits, texts, gold)
    a = E.mean_scores(E.scores(rows, gold)).select(F.lit(1).alias("k"), *_KEYS)
    b = E.mean_scores(E.scores(E.judged(hits, E.start_page_only(texts), gold), gold)).select(F.lit(1).alias("k"), *[F.col(c).alias(f"{c}_strict") for c in _KEYS])
    wide = rows.agg(F.lit(1).alias("k"), F.round(100 * F.avg((F.col("page_end") > F.col("page_start")).cast("int")), 1).alias("multipage"))
    deltas = [F.round(F.col(f"{c}_strict") - F.col(c), 4).alias(f"{c}_delta") for c in _KEYS]
    return a.join(b, "k").join(wide, "k").select(*_KEYS, *[f"{c}_strict" for c in _KEYS], *deltas, "multipage")


@query(_BASE + f""", c AS (SELECT DISTINCT n.query_id, t.chunk_id, len(list_filter(words, lambda w: contains({cmp_sql('t.chunk_text')}, w))) >= needed AS met, t.page_start <= p.a + 1 AND t.page_start >= p.a AS first_page
  FROM need n JOIN pas p USING (query_id) JOIN txt t ON t.document_id = p.document_id AND t.page_start <= p.b AND t.page_end >= p.a)
SELECT n.query_id, count(DISTINCT c.chunk_id) AS on_pages, count(DISTINCT c.chunk_id) FILTER (met) AS available, count(DISTINCT c.chunk_id) FILTER (met AND first_page) AS by_first_page, count(*) FILTER (met) > 0 AS answerable
  FROM need n LEFT JOIN c USING (query_id) GROUP BY n.query_id""")
def gold_coverage(spark: SparkSession, d: str) -> DataFrame:
    """All chunks on each query's pages, and those among them that hold the facts: whether it can be answered at all."""
    gold = _gold(spark, d)
    asked = gold.select("query_id", "groups", "needed", F.explode("passages").alias("p")).select("query_id", "groups", "needed", "p.document_id", F.col("p.page_start").alias("a"), F.col("p.page_end").alias("b"))
    pages = asked.withColumn("page", F.explode(F.sequence("a", "b")))
    paged = _texts(spark, d).withColumn("page", F.explode(F.sequence("page_start", "page_end")))
    met = _formed(paged.join(pages, ["document_id", "page"]).select("query_id", "chunk_id", "page_start", "a", "b", "groups", "needed", "chunk_text").distinct())
    met = met.withColumn("met", E.covered(F.col("form"), F.col("groups")) >= F.col("needed"))
    first = F.col("met") & F.col("page_start").between(F.col("a"), F.col("b"))
    per = met.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("on_pages"), F.count_distinct(F.when(F.col("met"), F.col("chunk_id"))).alias("available"), F.count_distinct(F.when(first, F.col("chunk_id"))).alias("by_first_page"))
    out = gold.select("query_id").distinct().join(per, "query_id", "left").fillna(0)
    return out.withColumn("answerable", F.col("available") > 0)


@query(_SCORED + f", m AS (UNPIVOT (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in E.MEASURES)} FROM ja) ON {', '.join(E.MEASURES)} INTO NAME measure VALUE published) SELECT measure, published, true AS reconstructed FROM m")
def reconstructed_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Published measures against those made anew from the evidence rows as written to and read from a file."""
    gold, hits, texts = _run(spark, d)
    rows = E.judged(hits, texts, gold)
    path = f"{shared_dir(spark).rstrip('/')}/evidence-{uuid.uuid4().hex}"
    rows.write.json(path)
    again = spark.read.schema(rows.schema).json(path)
    unpivoted = lambda df, name: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias(name)) for c in E.MEASURES])))
    a = unpivoted(E.mean_scores(E.scores(rows, gold)), "published")
    b = unpivoted(E.mean_scores(E.scores(again, gold)), "anew")
    return a.join(b, "measure").select("measure", "published", (F.abs(F.col("published") - F.col("anew")) <= 1e-9).alias("reconstructed"))


@query(_BOTH + f"""SELECT ka.p_at_1, abs(ka.p_at_1 - 0.55) <= 0.051 AS near_target, {' OR '.join(f'ka.{c} < ja.{c} - 0.05' for c in _KEYS)} AS regressed,
  CASE WHEN abs(ka.p_at_1 - 0.55) <= 0.051 AND NOT ({' OR '.join(f'ka.{c} < ja.{c} - 0.05' for c in _KEYS)}) THEN 'adopt with caveats' ELSE 'reopen' END AS decision FROM ja, ka""")
def decision_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether the run judged by first pages may stand for the run as it was scored."""
    gold, hits, texts = _run(spark, d)
    run = lambda t: E.mean_scores(E.scores(E.judged(hits, t, gold), gold))
    return E.decision(run(texts), run(E.start_page_only(texts)))


_EXPECTED = [("as scored", m) for m in ("p_at_1", "rr", "map")] + [("start page only", m) for m in ("p_at_1", "rr")] + [("widened", "p_at_1")]


@query(_BOTH + f""", m AS (SELECT 'as scored' AS run, unnest(['p_at_1', 'rr']) AS measure, unnest([p_at_1, rr]) AS value FROM ja UNION ALL SELECT 'start page only', unnest(['p_at_1', 'rr']), unnest([p_at_1, rr]) FROM ka)
SELECT e.run, e.measure, m.value, CASE WHEN m.value IS NOT NULL THEN 'present' WHEN e.run IN (SELECT run FROM m) THEN 'measure missing' ELSE 'run missing' END AS status FROM (VALUES {', '.join(str(x) for x in _EXPECTED)}) e(run, measure) LEFT JOIN m USING (run, measure)""")
def run_history(spark: SparkSession, d: str) -> DataFrame:
    """Measures of the runs on file, flattened, against those expected; what is missing is named."""
    gold, hits, texts = _run(spark, d)
    path = f"{shared_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    for name, t in (("as scored", texts), ("start page only", E.start_page_only(texts))):
        mean = E.mean_scores(E.scores(E.judged(hits, t, gold), gold))
        mean.select(F.lit(name).alias("run"), F.struct("p_at_1", "rr").alias("metrics")).coalesce(1).write.mode("append").json(path)
    files = spark.read.schema("run string, metrics map<string, double>").option("multiLine", "true").json(path)
    there = files.select("run", F.explode("metrics").alias("measure", "value"))
    expected = spark.createDataFrame(_EXPECTED, "run string, measure string")
    status = F.when(F.col("value").isNotNull(), "present").when(F.col("known"), "measure missing").otherwise("run missing")
    known = there.select("run", F.lit(True).alias("known")).distinct()
    return expected.join(there, ["run", "measure"], "left").join(known, "run", "left").select("run", "measure", "value", status.alias("status"))


_CODES = ["potential_emergency_presentation", "patient_specific_request", "guideline_edition_unavailable", "no_chunks_retrieved", "all_scores_below_threshold", "evidence_not_specific_enough"]
_ACCEPTED = ["no_chunks_retrieved", "all_scores_below_threshold", "evidence_not_specific_enough"]
_FORBIDDEN = ["as a language model", "i think", "probably"]


_GENERATION = f"""WITH r AS (SELECT result_id, coalesce(refusal IN ({', '.join(f"'{c}'" for c in _CODES)}), false) AS refused, refusal, confidence, lower(coalesce(answer, '')) AS prose, regexp_extract_all(coalesce(query, ''), '[0-9]{{2,}}') AS must, lower(coalesce(answer, '') || ' ' || coalesce(array_to_string(list_transform(supporting_evidence, lambda e: coalesce(e.excerpt, '')), ' '), '')) AS everything FROM {_RESULTS}),
c AS (SELECT result_id, refused, CASE WHEN confidence = 'Insufficient Evidence' THEN refused OR trim(prose) <> '' ELSE NOT refused END AS as_expected, CASE WHEN refused THEN refusal IN ({', '.join(f"'{c}'" for c in _ACCEPTED)}) END AS reason, CASE WHEN len(must) > 0 THEN refused OR len(list_filter(must, lambda m: NOT contains(prose, m))) = 0 END AS mentions,
  len(list_filter([{', '.join(f"'{w}'" for w in _FORBIDDEN)}], lambda w: contains(everything, w))) = 0 AS avoids FROM r)
SELECT result_id, refused, list_filter(['refusal expected', 'refusal reason', 'must mention', 'must not mention'], lambda n, i: list_extract([NOT as_expected, NOT reason, NOT mentions, NOT avoids], i)).array_to_string('; ') AS failed,
  (2 + (reason IS NOT NULL)::INT + (mentions IS NOT NULL)::INT)::BIGINT AS n_checks FROM c"""


@query(_GENERATION)
def generation_checks(spark: SparkSession, d: str) -> DataFrame:
    """Mechanical checks of answers: refused only where that is expected and for an accepted reason, the question's numbers
    mentioned, nothing forbidden said. Checks that don't apply are not counted."""
    refused = F.coalesce(F.col("refusal").isin(_CODES), F.lit(False))
    prose = F.lower(F.coalesce("answer", F.lit("")))
    quoted = F.coalesce(F.array_join(F.transform("supporting_evidence", lambda e: F.coalesce(e["excerpt"], F.lit(""))), " "), F.lit(""))
    rows = results(spark, d).select("result_id", refused.alias("refused"), "refusal", "confidence", prose.alias("prose"), F.regexp_extract_all(F.coalesce("query", F.lit("")), F.lit("[0-9]{2,}"), F.lit(0)).alias("must"), F.lower(F.concat(F.coalesce("answer", F.lit("")), F.lit(" "), quoted)).alias("everything"))
    r = F.col("refused")
    expected = F.coalesce(F.when(F.col("confidence") == "Insufficient Evidence", r | (F.trim("prose") != "")), ~r)
    reason = F.when(r, F.col("refusal").isin(_ACCEPTED))
    mentions = F.when(F.size("must") > 0, r | F.forall("must", lambda m: F.contains(F.col("prose"), m)))
    avoids = ~F.exists(F.array(*[F.lit(w) for w in _FORBIDDEN]), lambda w: F.contains(F.col("everything"), w))
    failed = F.array(F.when(~expected, "refusal expected"), F.when(~reason, "refusal reason"), F.when(~mentions, "must mention"), F.when(~avoids, "must not mention"))
    n = 2 + reason.isNotNull().cast("int") + mentions.isNotNull().cast("int")
    return rows.select("result_id", "refused", F.array_join(F.array_compact(failed), "; ").alias("failed"), n.cast("long").alias("n_checks"))


@query(f"""WITH g AS ({_GENERATION}) SELECT coalesce(r.confidence, '-') AS category, count(*) AS n, count(*) FILTER (g.refused) AS refused, count(*) FILTER (g.failed = '') AS ok, sum(n_checks)::BIGINT AS checks FROM g JOIN {_RESULTS} r USING (result_id) GROUP BY 1""")
def generation_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Answers that pass all their checks, per confidence."""
    category = results(spark, d).select("result_id", F.coalesce("confidence", F.lit("-")).alias("category"))
    return generation_checks(spark, d).join(category, "result_id").groupBy("category").agg(F.count("*").alias("n"), F.count_if("refused").alias("refused"), F.count_if(F.col("failed") == "").alias("ok"), F.sum("n_checks").alias("checks"))
