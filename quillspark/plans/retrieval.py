"""Queries of retrieval and of its evaluation. A search's queries are the rows whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import lexical_tokens
from quillspark.operators import retrieval as R
from quillspark.plans.registry import query, table
from quillspark.session import broadcast_if_small, stored
from quillspark.sources.index import embedded

_SCORES = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, label AS ql FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, ql, vec_id, label, round(list_inner_product(qv, embedding::DOUBLE[]), 6) AS score FROM q, embeddings),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
others AS (SELECT query_id, ql, vec_id, label, score, label = ql AS relevant,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE vec_id <> query_id),
rel AS (SELECT query_id, count(*) FILTER (label = ql AND vec_id <> query_id) AS n_relevant FROM s GROUP BY query_id),
per AS (SELECT rel.query_id,
  coalesce(count(*) FILTER (rank <= 1 AND relevant), 0)::DOUBLE AS p_at_1,
  count(*) FILTER (rank <= 3 AND relevant) / 3 AS p_at_3, count(*) FILTER (rank <= 5 AND relevant) / 5 AS p_at_5,
  coalesce(1 / min(rank) FILTER (rank <= 10 AND relevant), 0.0) AS rr,
  min(rank) FILTER (rank <= 10 AND relevant) AS first_relevant_rank,
  count(*) FILTER (rank <= 5 AND relevant) / greatest(any_value(n_relevant), 1) AS recall_at_5,
  count(*) FILTER (rank <= 10 AND relevant) / greatest(any_value(n_relevant), 1) AS recall_at_10,
  count(*) FILTER (rank <= 5 AND relevant) > 0 AS answering_at_5
  FROM rel LEFT JOIN others USING (query_id) GROUP BY rel.query_id)
"""
_MARGINS = _SCORES + """, m AS (SELECT query_id, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 6) AS margin_1_2,
  round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 5), 6) AS margin_1_5,
  round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 10), 6) AS margin_1_10 FROM others GROUP BY query_id)
"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings")
    return rows, rows.filter("vec_id % 50 = 0")


@query(_SCORES + "SELECT query_id, rank, vec_id, score FROM hits WHERE rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_topk(*_vectors(spark, d))


@query(_SCORES + "SELECT query_id, rank AS self_rank FROM hits WHERE vec_id = query_id AND rank <= 10")
def dense_self_hit(spark: SparkSession, d: str) -> DataFrame:
    return dense_topk(spark, d).filter("vec_id = query_id").select("query_id", F.col("rank").alias("self_rank"))


def _others(spark: SparkSession, d: str, k: int = 10, digits: int | None = None) -> DataFrame:
    """The best hits besides the query itself, with relevance by label."""
    rows, queries = _vectors(spark, d)
    if digits is not None:
        rows = rows.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), digits)))
        queries = rows.filter("vec_id % 50 = 0")
    hits = R.dense_topk(rows, queries, k + 1).filter("vec_id <> query_id")
    hits = R.ranked(hits.drop("rank"), "query_id", "score", "vec_id", k)
    labels = rows.select("vec_id", "label")
    return hits.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").withColumn("relevant", F.col("label") == F.col("ql"))


def _per_query(spark: SparkSession, d: str, digits: int | None = None) -> DataFrame:
    rows, queries = _vectors(spark, d)
    sizes = rows.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    relevant = queries.join(sizes, "label").select(F.col("vec_id").alias("query_id"), "n_relevant")
    return R.metrics(_others(spark, d, digits=digits), relevant)


@query(_SCORES + "SELECT * FROM per")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _per_query(spark, d)


_MEAN = """SELECT count(*) AS n_queries, round(avg(p_at_1), 4) AS p_at_1, round(avg(p_at_3), 4) AS p_at_3, round(avg(p_at_5), 4) AS p_at_5,
  round(avg(rr), 4) AS rr, round(avg(recall_at_5), 4) AS recall_at_5, round(avg(recall_at_10), 4) AS recall_at_10,
  count(*) FILTER (p_at_1 > 0) AS relevant_top1, count(*) FILTER (answering_at_5) AS answering_at_5 FROM per"""


@query(_SCORES + _MEAN)
def retrieval_metrics_mean(spark: SparkSession, d: str) -> DataFrame:
    return R.macro(_per_query(spark, d))


@query(_SCORES + """SELECT e.label, count(*) AS queries, count(*) FILTER (first_relevant_rank IS NULL) AS failures
  FROM per JOIN embeddings e ON e.vec_id = per.query_id GROUP BY ROLLUP (e.label)""")
def failure_census(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _vectors(spark, d)
    per = _per_query(spark, d).join(rows.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return per.rollup("label").agg(F.count("*").alias("queries"), F.count_if(F.col("first_relevant_rank").isNull()).alias("failures"))


@query(_MARGINS + "SELECT * FROM m")
def margin_signals(spark: SparkSession, d: str) -> DataFrame:
    return R.margins(_others(spark, d))


@query(_MARGINS + """, t AS (SELECT quantile_cont(margin_1_2, 0.25) AS t2, quantile_cont(margin_1_10, 0.25) AS t10 FROM m)
SELECT query_id, margin_1_10 < t10 AS policy_a, margin_1_2 < t2 AS policy_b, margin_1_10 < t10 AND margin_1_2 < t2 AS policy_c FROM m, t""")
def selective_policy(spark: SparkSession, d: str) -> DataFrame:
    return R.selective(R.margins(_others(spark, d)))


_ROUNDED = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS a, list_transform(embedding, lambda x: round(x::DOUBLE, 2)) AS b FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.a, v.a), 6) AS sa, round(list_inner_product(q.b, v.b), 6) AS sb,
  v.label = q.label AS relevant FROM v q, v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sa DESC, vec_id) AS lr, row_number() OVER (PARTITION BY query_id ORDER BY sb DESC, vec_id) AS rr FROM s)
"""


@query(_ROUNDED + """SELECT query_id, coalesce(bool_or(lr = 1 AND rr = 1), false) AS same_top1, bool_and(lr <= 10 AND rr <= 10) AS same_set,
  bool_and(lr = rr) AS same_order, round(max(abs(sa - sb)) FILTER (lr <= 10 AND rr <= 10), 4) AS max_difference
  FROM r WHERE lr <= 10 OR rr <= 10 GROUP BY query_id""")
def rank_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Rankings with vectors as stored and rounded to two places."""
    rows, queries = _vectors(spark, d)
    coarse = rows.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 2)))
    return R.equivalence(R.dense_topk(rows, queries), R.dense_topk(coarse, coarse.filter("vec_id % 50 = 0")), "vec_id")


@query(_ROUNDED + """, f AS (SELECT query_id, bool_or(lr = 1 AND rr = 1) AS same_top1, bool_and(lr <= 10 AND rr <= 10) AS same_set, bool_and(lr <= 10 AND rr <= 10 AND abs(sa - sb) <= 0.02) AS scores_within, 0::BIGINT AS field_mismatches, bool_and(lr = rr) AS same_order FROM r WHERE lr <= 10 OR rr <= 10 GROUP BY query_id),
t AS (SELECT a.query_id, bool_and(a.vec_id = b.vec_id OR coalesce(abs(a.sa - b.sa) <= 0.02 AND b.lr <= 10, false)) AS ties_only FROM r a JOIN r b ON b.query_id = a.query_id AND b.rr = a.lr WHERE a.lr <= 10 GROUP BY a.query_id)
SELECT f.*, ties_only, same_top1 AND same_set AND scores_within AND (same_order OR ties_only) AS passed FROM f JOIN t USING (query_id)""")
def migration_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index with coarse vectors may stand for the exact one, within two hundredths."""
    rows, queries = _vectors(spark, d)
    coarse = rows.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 2)))
    labels = rows.select("vec_id", "label")
    a = R.dense_topk(rows, queries).join(labels, "vec_id")
    b = R.dense_topk(coarse, coarse.filter("vec_id % 50 = 0")).join(labels, "vec_id")
    return R.migration_verdict(a, b, "vec_id", ["label"], 0.02)


_RUN = """per{n} AS (SELECT query_id, count(*) FILTER (k <= 1 AND relevant) AS p1, coalesce(1 / min(k) FILTER (k <= 10 AND relevant), 0) AS rr,
  count(*) FILTER (k <= 5 AND relevant) AS r5, count(*) FILTER (k <= 10 AND relevant) AS r10 FROM
  (SELECT query_id, relevant, row_number() OVER (PARTITION BY query_id ORDER BY {s} DESC, vec_id) AS k FROM s WHERE vec_id <> query_id) GROUP BY query_id)"""


@query(_ROUNDED + ", " + _RUN.format(n=1, s="sa") + ", " + _RUN.format(n=2, s="sb") + """
SELECT a.query_id, CASE WHEN (b.p1, b.rr, b.r5, b.r10) > (a.p1, a.rr, a.r5, a.r10) THEN 'improved'
  WHEN (b.p1, b.rr, b.r5, b.r10) < (a.p1, a.rr, a.r5, a.r10) THEN 'regressed' ELSE 'unchanged' END AS verdict FROM per1 a JOIN per2 b USING (query_id)""")
def run_compare(spark: SparkSession, d: str) -> DataFrame:
    return R.verdicts(_per_query(spark, d), _per_query(spark, d, digits=2))


@query("""SELECT label, count(*) AS n, count(*) FILTER (abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) <= 0.001) AS unit,
  min(len(embedding))::BIGINT AS least_dim, max(len(embedding))::BIGINT AS most_dim,
  count(*) FILTER (list_bool_and(list_transform(embedding, lambda x: isfinite(x)))) AS finite FROM embeddings GROUP BY label""")
def vector_norm_audit(spark: SparkSession, d: str) -> DataFrame:
    """Unit norm, dimension and finite values per label."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.abs(norm - 1) <= 1e-3).alias("unit"), F.min(F.size("embedding")).cast("long").alias("least_dim"), F.max(F.size("embedding")).cast("long").alias("most_dim"), F.count_if(finite).alias("finite"))


@query("""SELECT count(*) AS n, round(max(list_max(list_transform(list_zip(embedding, list_transform(embedding, lambda x: round(x::DOUBLE, 4))), lambda p: abs(p[1]::DOUBLE - p[2])))), 6) AS max_difference,
  max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE - round(x::DOUBLE, 4))))) < 0.0001 AS same FROM embeddings WHERE vec_id % 8 = 0""")
def reembed_sample(spark: SparkSession, d: str) -> DataFrame:
    """A strided sample of vectors against a second computation, here the rounded one."""
    rows = table(spark, d, "embeddings").filter("vec_id % 8 = 0")
    far = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double") - F.round(x.cast("double"), 4))))
    return rows.agg(F.count("*").alias("n"), F.round(F.max(far), 6).alias("max_difference"), (F.max(far) < 1e-4).alias("same"))


_BM25 = """
WITH q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower({fold_q}), '[0-9]+(?:\\.[0-9]+)?|[a-z]+(?:''[a-z]+)?')) AS term FROM heldout_items WHERE item_id % 50 = 0),
qt AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower({fold_d}), '[0-9]+(?:\\.[0-9]+)?|[a-z]+(?:''[a-z]+)?') AS toks FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM d),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS length, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY term),
parts AS (SELECT query_id, doc_id, term, tf, idf, times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl)) AS part FROM tf JOIN qt USING (term) JOIN idf USING (term), st),
scored AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM parts GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
"""


def _folded(column: str) -> str:
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("‘", "''"), ("’", "''"), ("“", '"'), ("”", '"')):
        column = f"replace({column}, '{a}', '{b}')"
    return column


_BM25 = _BM25.format(fold_q=_folded("query"), fold_d=_folded("coalesce(text, '')"))


def _lexical(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    queries = table(spark, d, "heldout_items").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "query")
    return table(spark, d, "documents").select("doc_id", "text"), queries


@query(_BM25 + "SELECT query_id, rank, doc_id, score FROM lex WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_topk(*_lexical(spark, d), 10)[0]


@query(_BM25 + "SELECT query_id, rank, doc_id, term, tf, round(idf, 6) AS idf, round(part, 6) AS part FROM parts JOIN (SELECT query_id, doc_id, rank FROM lex WHERE rank <= 3) USING (query_id, doc_id)")
def bm25_explain(spark: SparkSession, d: str) -> DataFrame:
    """Contribution of each term to the best three documents."""
    best, parts = R.bm25_topk(*_lexical(spark, d), 3)
    return parts.join(best.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"]).select("query_id", "rank", "doc_id", "term", "tf", "idf", F.round("part", 6).alias("part"))


_TOKENS = "regexp_extract_all(lower({t}), '[0-9]+(?:\\.[0-9]+)?|[a-z]+(?:''[a-z]+)?')"
#: The stand-in encoder: tokens counted by a place and sign that their MD5 names, as 64 numbers of unit length. Zero
#: texts have no rows.
_ENCODED = """
{n}t AS (SELECT {i} AS id, unnest({tokens}) AS w FROM {source}),
{n}h AS (SELECT w, ('0x' || substr(md5(w), 1, 8))::BIGINT % 128 AS h FROM (SELECT DISTINCT w FROM {n}t)),
{n}c AS (SELECT id, h % 64 AS b, sum(CASE WHEN h < 64 THEN 1 ELSE -1 END)::BIGINT AS v FROM {n}t JOIN {n}h USING (w) GROUP BY ALL),
{n}v AS (SELECT id, b, (v / sqrt(sum(v * v) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x FROM {n}c WHERE v <> 0)"""


def _encoded(name: str, ident: str, text: str, source: str) -> str:
    return _ENCODED.format(n=name, i=ident, tokens=_TOKENS.format(t=_folded(f"coalesce({text}, '')")), source=source)


_NEAREST = f"""
WITH {_encoded("ed", "doc_id", "text", "documents")},
{_encoded("eq", "item_id", "query", "heldout_items WHERE item_id % 50 = 0")},
dots AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.x * d.x) AS s FROM eqv q JOIN edv d USING (b) GROUP BY ALL),
ds AS (SELECT query_id, doc_id, round(coalesce(s, 0), 6) AS dense, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 6) DESC, doc_id) AS rank
  FROM (SELECT item_id AS query_id, doc_id FROM heldout_items, documents WHERE item_id % 50 = 0) LEFT JOIN dots USING (query_id, doc_id))"""
_POOL = _NEAREST + "," + _BM25.replace("WITH q AS", "bq AS", 1).replace(" FROM q GROUP BY ALL", " FROM bq GROUP BY ALL").replace("d AS (SELECT doc_id, regexp", "bd AS (SELECT doc_id, regexp").replace("FROM d)", "FROM bd)").replace("unnest(toks) AS term FROM d)", "unnest(toks) AS term FROM bd)") + """,
ids AS (SELECT query_id, doc_id FROM ds WHERE rank <= 30 UNION SELECT query_id, doc_id FROM lex WHERE rank <= 30),
pool AS (SELECT query_id, doc_id, dense, coalesce(scored.score, 0) AS lexical FROM ids JOIN ds USING (query_id, doc_id) LEFT JOIN scored USING (query_id, doc_id)),
n AS (SELECT *, min(dense) OVER w AS dl, max(dense) OVER w AS dh, min(lexical) OVER w AS ll, max(lexical) OVER w AS lh FROM pool WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, doc_id, CASE WHEN dh <= dl THEN 0 ELSE (dense - dl) / (dh - dl) END AS nd, CASE WHEN lh <= ll THEN 0 ELSE (lexical - ll) / (lh - ll) END AS nl FROM n)
"""


def _whole(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents, a vector encoded for each, and every fiftieth held-out query, whole and encoded alike."""
    texts, queries = _lexical(spark, d)
    vectors = stored(texts.select("doc_id", embedded(F.col("text")).alias("embedding")))
    return texts, vectors, stored(queries.withColumn("embedding", embedded(F.col("query"))))


def _dense(vectors: DataFrame, asked: DataFrame, depth: int) -> DataFrame:
    return R.dense_topk(vectors, asked.select(F.col("query_id").alias("doc_id"), "embedding"), depth, "doc_id")


def _pool(texts: DataFrame, vectors: DataFrame, asked: DataFrame, depth: int = 30) -> DataFrame:
    """The union of the best of both searches over ``texts`` (doc_id, text) with ``vectors`` (doc_id, embedding) for
    ``asked`` (query_id, query, embedding), with both scores; stored once."""
    dense = _dense(vectors, asked, depth).select("query_id", "doc_id")
    queries = asked.select("query_id", "query")
    counts = R.bm25_counts(texts, queries)
    best = R.bm25_topk(texts, queries, depth, counts=counts)[0].select("query_id", "doc_id")
    ids = stored(dense.union(best).distinct())
    q = asked.select("query_id", F.col("embedding").alias("qv"))
    dot = F.aggregate(F.zip_with("qv", "embedding", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    both = vectors.select("doc_id", "embedding").join(broadcast_if_small(ids), "doc_id").join(q, "query_id").select("query_id", "doc_id", F.round(dot, R.DIGITS).alias("dense"))
    found = R.bm25_of(counts, ids).withColumnRenamed("score", "lexical")
    return stored(both.join(found, ["query_id", "doc_id"], "left").fillna(0.0, ["lexical"]).select("query_id", "doc_id", "dense", "lexical"))


_FUSED = _POOL + """, r AS (SELECT alpha, query_id, doc_id, round(alpha * nd + (1 - alpha) * nl, 6) AS score FROM f, (VALUES (0.75::DOUBLE), (0.5::DOUBLE), (0.25::DOUBLE)) a(alpha))
SELECT alpha, query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10"""


@query(_FUSED)
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Dense and lexical scores of all documents, for whole held-out queries, blended with three weights."""
    return R.fused(_pool(*_whole(spark, d)), "doc_id", [0.75, 0.5, 0.25])


@query(_FUSED)
def hybrid_fusion_whole(spark: SparkSession, d: str) -> DataFrame:
    """The name under which hybrid_fusion was first run over all documents."""
    return hybrid_fusion(spark, d)


def _overlap(texts: DataFrame, vectors: DataFrame, asked: DataFrame) -> DataFrame:
    tokens = lambda c: F.array_distinct(lexical_tokens(F.coalesce(c, F.lit(""))))
    hits = broadcast_if_small(stored(_dense(vectors, asked, 30).select("query_id", "doc_id", F.col("rank").alias("dense_rank"))))
    both = texts.select("doc_id", "text").join(hits, "doc_id").join(asked.select("query_id", tokens("query").alias("qt")), "query_id")
    score = F.round(F.size(F.array_intersect(tokens("text"), "qt")) / F.greatest(F.size("qt"), F.lit(1)), 6)
    return R.ranked(both.withColumn("score", score), "query_id", "score", "dense_rank", 10).select("query_id", "rank", "doc_id", "dense_rank", "score")


_RERANKED = _NEAREST + """, dw AS (SELECT DISTINCT id, w FROM edt), qw AS (SELECT DISTINCT id, w FROM eqt), qn AS (SELECT id, count(*) AS n FROM qw GROUP BY id),
o AS (SELECT query_id, doc_id, ds.rank AS dense_rank, round(coalesce(any_value(s.n), 0) / greatest(coalesce(any_value(qn.n), 0), 1), 6) AS score FROM ds LEFT JOIN qn ON qn.id = query_id
  LEFT JOIN (SELECT qw.id AS qi, dw.id AS di, count(*) AS n FROM qw JOIN dw USING (w) GROUP BY ALL) s ON s.qi = query_id AND s.di = doc_id WHERE ds.rank <= 30 GROUP BY query_id, doc_id, ds.rank)
SELECT query_id, rank, doc_id, dense_rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank) AS rank FROM o) WHERE rank <= 10"""


@query(_RERANKED)
def overlap_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Thirty dense candidates among all documents rescored by the share of the query's tokens they hold, ties in dense
    order."""
    return _overlap(*_whole(spark, d))


@query(_RERANKED)
def overlap_rerank_whole(spark: SparkSession, d: str) -> DataFrame:
    """The name under which overlap_rerank was first run over all documents."""
    return overlap_rerank(spark, d)
