"""Queries on sentences and whole texts: unwrapping, table redundancy, recommendation sentences, grounding of answer
sentences, and the union of integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.plans.answers import _EVIDENCE, _RESULTS, cmp_sql, evidence, match_sql, novel_sql, results, tokens_sql
from quillspark.plans.corpus import _CHUNKS, _PAGES, chunks, once
from quillspark.plans.registry import query, table
from quillspark.plans.retrieval import _ROUNDED, _RUN, _others, _per_query

_INVISIBLE, _BLANKS = "\ufeff\xad", "\xa0\u2009\u202f"


def unwrapped(text: Column) -> Column:
    """Text with words cut at line ends joined and wrapped lines merged: a line end goes when the line has no end
    mark, is no table row, and the next begins with a lower-case letter. Numbers are never joined."""
    plain = F.translate(F.translate(text, _INVISIBLE, ""), _BLANKS, " " * len(_BLANKS))
    whole = F.regexp_replace(plain, r"([a-z])-\n([a-z])", "$1$2")
    merged = F.regexp_replace(whole, r"([^\n.!?:|])\n([a-z])", "$1 $2")
    return F.regexp_replace(F.regexp_replace(merged, r"[ \t]+", " "), r"^[ \n]+|[ \n]+$", "")


@query(rf"""SELECT page_key, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(translate(raw_text, '{_INVISIBLE}', ''), '{_BLANKS}', '   '), '([a-z])-\n([a-z])', '\1\2', 'g'), '([^\n.!?:|])\n([a-z])', '\1 \2', 'g'), '[ \t]+', ' ', 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS clean
  FROM {_PAGES} WHERE raw_text IS NOT NULL""")
def unwrapped_pages(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "pages_df").filter("raw_text IS NOT NULL").select("page_key", unwrapped(F.col("raw_text")).alias("clean")), "page_key")


@query(rf"""WITH t AS (SELECT page_key, {cmp_sql('table_text')} AS t, {cmp_sql("coalesce(clean_text, '')")} AS b FROM {_PAGES} WHERE table_text IS NOT NULL),
w AS (SELECT *, list_filter(string_split(t, ' '), lambda x: x NOT IN ('', '|')) AS w, list_filter(string_split(b, ' '), lambda x: x NOT IN ('', '|')) AS v FROM t),
g AS (SELECT *, list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) AS g, array_to_string(v, ' ') AS body FROM w)
SELECT page_key, len(w)::BIGINT AS words, CASE WHEN contains(b, t) OR (length(replace(t, ' ', '')) >= 40 AND contains(replace(b, ' ', ''), replace(t, ' ', ''))) THEN 1.0 WHEN len(w) < 5 THEN contains(body, array_to_string(w, ' '))::INT::DOUBLE
  ELSE round(len(list_filter(g, lambda x: contains(body, x))) / len(g), 6) END AS held FROM g""")
def table_redundancy(spark: SparkSession, d: str) -> DataFrame:
    """How much of a page's table its text already holds: whole, without blanks, or by runs of five words."""
    split = lambda c: F.filter(F.split(c, " "), lambda x: ~x.isin("", "|"))
    rows = table(spark, d, "pages_df").filter("table_text IS NOT NULL").select("page_key", T.compared(F.col("table_text")).alias("t"), T.compared(F.coalesce("clean_text", F.lit(""))).alias("b"))
    rows = rows.select("page_key", "t", "b", split("t").alias("w"), F.array_join(split("b"), " ").alias("body"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 5), " "))
    squeezed = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    whole = F.contains("b", "t") | ((F.length(squeezed("t")) >= 40) & F.contains(squeezed("b"), squeezed("t")))
    share = F.round(F.size(F.filter(runs, lambda x: F.contains(F.col("body"), x))) / F.size(runs), 6)
    held = F.when(whole, 1.0).when(F.size("w") < 5, F.contains("body", F.array_join("w", " ")).cast("double")).otherwise(share)
    return once(rows.select("page_key", F.size("w").cast("long").alias("words"), held.alias("held")), "page_key")


_SENTENCE = r"[^.!?\n]+[.!?]"
_VERB = r"(?i)\brecommend|\bshould (?:not )?(?:be|routinely|undergo|receive)|\bmay be offered|\bmust (?:not )?be|\bought to"


@query(rf"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_SENTENCE}')) AS s, generate_subscripts(regexp_extract_all(text, '{_SENTENCE}'), 1) AS pos FROM documents WHERE text IS NOT NULL)
SELECT doc_id, pos, trim(s) AS sentence, CASE WHEN regexp_matches(s, '(?i)\b(must|should|may) not\b|\bagainst\b') THEN 'against' WHEN regexp_matches(s, '(?i)\bmust\b|\brecommend') THEN 'strong' ELSE 'weak' END AS strength FROM s WHERE regexp_matches(s, '{_VERB}')""")
def recommendation_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that recommend, and how strongly."""
    found = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(_SENTENCE), F.lit(0))).alias("p", "s"))
    strength = F.when(F.col("s").rlike(r"(?i)\b(must|should|may) not\b|\bagainst\b"), "against").when(F.col("s").rlike(r"(?i)\bmust\b|\brecommend"), "strong").otherwise("weak")
    return found.filter(F.col("s").rlike(_VERB)).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), F.trim("s").alias("sentence"), strength.alias("strength"))


_NEGATIONS = ", ".join(f"'{w}'" for w in T.NEGATIONS)


@query(rf"""WITH s AS (SELECT result_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM (SELECT result_id, string_split(regexp_replace(trim(answer), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM {_RESULTS} WHERE answer IS NOT NULL)),
t AS (SELECT result_id, pos, {tokens_sql('m')} AS a FROM (SELECT result_id, pos, {match_sql('s')} AS m FROM s) WHERE m <> ''),
e AS (SELECT result_id, {tokens_sql('m')} AS b FROM (SELECT result_id, {match_sql('excerpt')} AS m FROM {_EVIDENCE} WHERE trim(excerpt) <> '')),
k AS (SELECT result_id, list_distinct(flatten(list({tokens_sql('m')}))) AS c FROM (SELECT DISTINCT e.result_id, c.chunk_id, {match_sql('c.chunk_text')} AS m FROM {_EVIDENCE} e JOIN {_CHUNKS} c USING (chunk_id)) GROUP BY result_id),
j AS (SELECT t.result_id, t.pos, any_value(t.a) AS a, any_value(k.c) AS c, coalesce(max(len(list_intersect(t.a, e.b))), 0) AS shared, bool_or(len(list_intersect(t.a, e.b)) >= 2 AND list_has_any(e.b, [{_NEGATIONS}]) = list_has_any(t.a, [{_NEGATIONS}])) AS agrees, count(e.result_id) AS n
  FROM t LEFT JOIN e USING (result_id) LEFT JOIN k USING (result_id) GROUP BY t.result_id, t.pos)
SELECT result_id, pos, len(a)::BIGINT AS tokens, shared::BIGINT AS shared, CASE WHEN c IS NULL THEN 0 ELSE {novel_sql('a', 'c')} END::BIGINT AS novel,
  CASE WHEN c IS NOT NULL AND {novel_sql('a', 'c')} >= 2 THEN 'unsupported fact' WHEN n = 0 OR len(a) < 2 THEN 'not tested' WHEN shared < 2 THEN 'ungrounded' WHEN NOT agrees THEN 'negation differs' ELSE 'grounded' END AS verdict FROM j""")
def sentence_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of answers: those with two terms that no cited chunk holds, those that share too few content words
    with any excerpt, and those that every excerpt they share words with negates."""
    split = F.split(F.regexp_replace(F.trim("answer"), r"([.!?])\s+", "$1\x01"), "\x01")
    s = results(spark, d).filter("answer IS NOT NULL").select("result_id", F.posexplode(split).alias("p", "s"))
    s = s.select("result_id", (F.col("p") + 1).cast("long").alias("pos"), T.matched(F.col("s")).alias("m")).filter("m <> ''").select("result_id", "pos", T.content_tokens(F.col("m")).alias("a"))
    own = evidence(spark, d)
    e = own.filter(F.trim("excerpt") != "").select("result_id", T.matched(F.col("excerpt")).alias("m")).select("result_id", T.content_tokens(F.col("m")).alias("b"))
    texts = chunks(spark, d).select("chunk_id", "chunk_text").join(own.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", T.matched(F.col("chunk_text")).alias("m")).select("chunk_id", T.content_tokens(F.col("m")).alias("k"))
    k = own.select("result_id", "chunk_id").distinct().join(texts, "chunk_id").groupBy("result_id").agg(F.array_distinct(F.flatten(F.collect_list("k"))).alias("c"))
    negates = lambda c: F.arrays_overlap(c, F.array(*[F.lit(w) for w in T.NEGATIONS]))
    shared = F.size(F.array_intersect("a", "b"))
    near = F.coalesce((shared >= 2) & (negates("a") == negates("b")), F.lit(False))
    joined = s.join(e, "result_id", "left").groupBy("result_id", "pos").agg(F.any_value("a").alias("a"), F.coalesce(F.max(F.when(F.col("b").isNotNull(), shared)), F.lit(0)).cast("long").alias("shared"), F.bool_or(near).alias("agrees"), F.count("b").alias("n")).join(k, "result_id", "left")
    joined = joined.withColumn("novel", F.when(F.col("c").isNull(), 0).otherwise(F.size(T.novel_stems(F.col("a"), F.col("c")))).cast("long"))
    verdict = F.when(F.col("novel") >= 2, "unsupported fact").when((F.col("n") == 0) | (F.size("a") < 2), "not tested").when(F.col("shared") < 2, "ungrounded").when(~F.col("agrees"), "negation differs").otherwise("grounded")
    return joined.select("result_id", "pos", F.size("a").cast("long").alias("tokens"), "shared", "novel", verdict.alias("verdict"))


@query(rf"""WITH y AS (SELECT DISTINCT result_id, unnest(regexp_extract_all(query, '\b(?:19|20)\d\d\b'))::INT AS year FROM {_RESULTS})
SELECT result_id, year, year IN (SELECT publication_year FROM documents_meta WHERE publication_year IS NOT NULL) AS known FROM y""")
def edition_years(spark: SparkSession, d: str) -> DataFrame:
    """Years that questions name, and whether any document is of that year."""
    asked = results(spark, d).select("result_id", F.explode(F.regexp_extract_all("query", F.lit(r"\b(?:19|20)\d\d\b"), F.lit(0))).alias("y")).select("result_id", F.col("y").cast("int").alias("year")).distinct()
    there = table(spark, d, "documents_meta").select(F.col("publication_year").alias("year"), F.lit(True).alias("there")).distinct()
    return asked.join(there, "year", "left").select("result_id", "year", F.col("there").isNotNull().alias("known"))


@query(_ROUNDED + ", " + _RUN.format(n=1, s="sa") + ", " + _RUN.format(n=2, s="sb") + """
SELECT CASE WHEN a.p1 > 0 AND b.p1 > 0 THEN 'preserved' WHEN a.p1 > 0 THEN 'lost' WHEN b.p1 > 0 THEN 'gained' ELSE 'neither' END AS change, count(*) AS queries FROM per1 a JOIN per2 b USING (query_id) GROUP BY 1""")
def top1_changes(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose first hit stays, becomes or stops being relevant between two runs."""
    a = _per_query(spark, d).select("query_id", F.col("p_at_1").alias("a"))
    both = a.join(_per_query(spark, d, digits=2).select("query_id", F.col("p_at_1").alias("b")), "query_id")
    change = F.when((F.col("a") > 0) & (F.col("b") > 0), "preserved").when(F.col("a") > 0, "lost").when(F.col("b") > 0, "gained").otherwise("neither")
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("queries"))


@query(_ROUNDED + """, h AS (SELECT q.query_id, q.k, q.relevant FROM (SELECT query_id, relevant, row_number() OVER (PARTITION BY query_id ORDER BY sa DESC, vec_id) AS k FROM s WHERE vec_id <> query_id) q WHERE k <= 30)
SELECT query_id, min(k) FILTER (relevant) AS first_relevant_rank, coalesce(min(k) FILTER (relevant) BETWEEN 11 AND 30, false) AS rescuable FROM h GROUP BY query_id""")
def rescue_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose first relevant hit lies beyond the tenth but among the thirty that a reranker sees."""
    hits = _others(spark, d, 30)
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    return hits.groupBy("query_id").agg(first.alias("first_relevant_rank"), F.coalesce(first.between(11, 30), F.lit(False)).alias("rescuable"))


@query(f"""SELECT result_id, documents FROM (SELECT result_id, len(list_distinct(list_filter(list_transform(supporting_evidence, lambda x: split_part(x.chunk_id, '__', 1)), lambda x: x IS NOT NULL))) AS documents FROM {_RESULTS} WHERE supporting_evidence IS NOT NULL)
ORDER BY documents DESC, result_id LIMIT 10""")
def subset_selection(spark: SparkSession, d: str) -> DataFrame:
    """The ten questions with evidence from most documents, ties by id: chosen without a look at results."""
    named = F.filter(F.transform("supporting_evidence", lambda e: F.split_part(e["chunk_id"], F.lit("__"), F.lit(1))), lambda x: x.isNotNull())
    return results(spark, d).filter("supporting_evidence IS NOT NULL").select("result_id", F.size(F.array_distinct(named)).cast("long").alias("documents")).orderBy(F.desc("documents"), "result_id").limit(10)


_CHECKS = [
    ("chunk spans are ordered", "structure", f"SELECT count(*) FROM {_CHUNKS} WHERE page_end < page_start OR page_number <> page_start"),
    ("chunk lengths are right", "structure", f"SELECT count(*) FROM {_CHUNKS} WHERE length(chunk_text) <> char_count"),
    ("chunks have a document", "reference", f"SELECT count(*) FROM {_CHUNKS} WHERE document_id NOT IN (SELECT document_id FROM documents_meta)"),
    ("recommendations have a document", "reference", "SELECT count(*) FROM recommendations WHERE document_id NOT IN (SELECT document_id FROM documents_meta)"),
    ("documents are unique", "identity", "SELECT count(*) - count(DISTINCT document_id) FROM documents_meta"),
    ("vectors are unique", "identity", "SELECT count(*) - count(DISTINCT vec_id) FROM embeddings"),
]


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, '{c}' AS category, n AS failures, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status FROM ({q}) t(n)" for n, c, q in _CHECKS))
def integrity_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks as rows: name, category, number of failures, status."""
    c, meta, vectors = chunks(spark, d), table(spark, d, "documents_meta"), table(spark, d, "embeddings")
    ids = meta.select("document_id")
    counted = [
        c.agg(F.count_if((F.col("page_end") < F.col("page_start")) | (F.col("page_number") != F.col("page_start"))).alias("failures")),
        c.agg(F.count_if(F.length("chunk_text") != F.col("char_count")).alias("failures")),
        c.join(ids, "document_id", "left_anti").agg(F.count("*").alias("failures")),
        table(spark, d, "recommendations").join(ids, "document_id", "left_anti").agg(F.count("*").alias("failures")),
        meta.agg((F.count("*") - F.count_distinct("document_id")).alias("failures")),
        vectors.agg((F.count("*") - F.count_distinct("vec_id")).alias("failures")),
    ]
    out = None
    for (name, category, _), one in zip(_CHECKS, counted):
        row = one.select(F.lit(name).alias("name"), F.lit(category).alias("category"), "failures", F.when(F.col("failures") == 0, "pass").otherwise("fail").alias("status"))
        out = row if out is None else out.unionAll(row)
    return out
