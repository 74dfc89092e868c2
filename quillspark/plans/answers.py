"""Queries on answers and their evidence: citation and excerpt checks, grounding, measurements, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import ordered as O
from quillspark.plans.corpus import _CHUNKS, chunks, once
from quillspark.plans.registry import query, table

_RESULTS = "(SELECT DISTINCT ON (result_id) * FROM generation_results ORDER BY result_id, ingested_at)"
_EVIDENCE = f"(SELECT result_id, pos, e.claim AS claim, e.chunk_id AS chunk_id, e.excerpt AS excerpt FROM (SELECT result_id, unnest(supporting_evidence) AS e, generate_subscripts(supporting_evidence, 1) AS pos FROM {_RESULTS}))"


def results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "generation_results").dropDuplicates(["result_id"])


def evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).select("result_id", F.posexplode("supporting_evidence").alias("pos", "e"))
    return rows.select("result_id", (F.col("pos") + 1).cast("long").alias("pos"), "e.claim", "e.chunk_id", "e.excerpt")


def _sq(x: str) -> str:
    return x.replace("'", "''")


def cmp_sql(c: str) -> str:
    """The compared form of a text."""
    for a, b in T.LIGATURES:
        c = f"replace({c}, '{a}', '{_sq(b)}')"
    return rf"trim(regexp_replace(lower(translate({c}, '{T.BLANKED}', '{' ' * len(T.BLANKED)}')), '[ \t\n\x0b\f\r\x{{a0}}]+', ' ', 'g'))"


def match_sql(c: str) -> str:
    """The matched form of a text. Of the characters that become several, those that texts here hold."""
    one, to, more = T.compatible()
    c = f"translate(replace({c}, '\xa0', ' '), '{_sq(''.join(a for a, _ in T.QUOTES))}', '{_sq(''.join(b for _, b in T.QUOTES))}')"
    for a, b in T.JOINED_LETTERS:
        c = f"replace({c}, '{a}', '{b}')"
    c = f"translate({c}, '{_sq(one)}', '{_sq(to)}')"
    for a, b in more:
        if a in "…½¼¾™№℃":
            c = f"replace({c}, '{a}', '{b}')"
    c = rf"regexp_replace(translate(nfc_normalize({c}), '{T.DASHES}', '{'-' * len(T.DASHES)}'), '{T.RANGE_E}', '\1-\2', 'g')"
    return rf"trim(regexp_replace(lower(translate({c}, '{T.SIGNS}', '{' ' * len(T.SIGNS)}')), '{T.BLANK}', ' ', 'g'))"


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def tokens_sql(form: str) -> str:
    """Content tokens of a matched form."""
    return f"list_distinct(list_filter(regexp_extract_all({form}, '{T.CONTENT}'), lambda x: length(x) >= 2 AND x NOT IN ({_STOP})))"


def stem_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({c}, '{s}') AND length({c}) >= {len(s) + 4} THEN left({c}, length({c}) - {len(s)})" for s in T.SUFFIXES) + f" ELSE {c} END"


_IGNORED = ", ".join(f"'{w}'" for w in dict.fromkeys(T.stem_of(w) for w in (*T.EVIDENCE_WORDS, *T.QUALIFIERS)))


def novel_sql(tokens: str, known: str) -> str:
    """How many stems of ``tokens`` those of ``known`` lack."""
    return f"len(list_filter(list_distinct(list_transform(list_filter({tokens}, lambda x: regexp_full_match(x, '[a-z]{{5,}}')), lambda x: {stem_sql('x')})), lambda x: x NOT IN ({_IGNORED}) AND NOT list_contains(list_transform({known}, lambda y: {stem_sql('y')}), x)))"


@query(f"""SELECT result_id, coalesce(top_score, 0.0) AS score, coalesce(top_score, 0.0) >= 0.5 AS usable FROM {_RESULTS}""")
def threshold_split(spark: SparkSession, d: str) -> DataFrame:
    """Results above and below an evidence threshold; a missing score counts as 0."""
    score = F.coalesce("top_score", F.lit(0.0))
    return results(spark, d).select("result_id", score.alias("score"), (score >= 0.5).alias("usable"))


@query(f"""SELECT e.result_id, e.pos, e.chunk_id, c.document_id, c.page_start, CASE WHEN e.chunk_id IS NULL THEN 'uncited' WHEN c.chunk_id IS NULL THEN 'unknown' ELSE 'resolved' END AS state
  FROM {_EVIDENCE} e LEFT JOIN {_CHUNKS} c ON c.chunk_id = e.chunk_id""")
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    """Cited chunks against the chunks there are; what has no match was made up."""
    c = chunks(spark, d).select("chunk_id", "document_id", "page_start", F.lit(True).alias("there"))
    state = F.when(F.col("chunk_id").isNull(), "uncited").when(F.col("there").isNull(), "unknown").otherwise("resolved")
    return evidence(spark, d).join(c, "chunk_id", "left").select("result_id", "pos", "chunk_id", "document_id", "page_start", state.alias("state"))


@query(f"""SELECT DISTINCT e.result_id, e.chunk_id FROM {_EVIDENCE} e LEFT JOIN {_CHUNKS} c USING (chunk_id) LEFT JOIN (SELECT result_id, unnest(documents_cited) AS document_id FROM {_RESULTS}) k ON k.result_id = e.result_id AND k.document_id = c.document_id
  WHERE e.chunk_id IS NOT NULL AND k.result_id IS NULL""")
def uncited_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence whose document the result doesn't name among those cited."""
    cited = results(spark, d).select("result_id", F.explode("documents_cited").alias("document_id"))
    known = chunks(spark, d).select("chunk_id", "document_id")
    return evidence(spark, d).filter("chunk_id IS NOT NULL").join(known, "chunk_id", "left").join(cited, ["result_id", "document_id"], "left_anti").select("result_id", "chunk_id").distinct()


@query(f"SELECT result_id, chunk_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY result_id, chunk_id ORDER BY pos) AS k FROM {_EVIDENCE} WHERE chunk_id IS NOT NULL) WHERE k > 1")
def duplicate_citations(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("result_id", "chunk_id").orderBy("pos")
    return evidence(spark, d).filter("chunk_id IS NOT NULL").withColumn("k", F.row_number().over(w)).filter("k > 1").select("result_id", "chunk_id", "pos")


@query(f"""WITH j AS (SELECT e.result_id, e.pos, {match_sql('c.chunk_text')} AS body, {match_sql("coalesce(e.excerpt, '')")} AS x FROM {_EVIDENCE} e JOIN {_CHUNKS} c USING (chunk_id)),
k AS (SELECT *, list_filter(string_split(regexp_replace(x, '[ ]*[.][.][.]+[ ]*', chr(1), 'g'), chr(1)), lambda p: p <> '') AS parts FROM j)
SELECT result_id, pos, len(parts)::BIGINT AS parts, len(list_filter(parts, lambda p: length(p) >= 12))::BIGINT AS tested, len(list_filter(parts, lambda p: length(p) >= 12 AND contains(body, p)))::BIGINT AS held, len(parts) > 1 AS stitched,
  CASE WHEN x = '' THEN 'empty' WHEN len(list_filter(parts, lambda p: length(p) >= 12 AND NOT contains(body, p))) > 0 THEN 'not verbatim' ELSE 'verbatim' END AS verdict FROM k""")
def excerpt_check(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts against the chunk they name, part by part between ellipses; short parts are not tested."""
    c = chunks(spark, d).select("chunk_id", "chunk_text")
    both = evidence(spark, d).join(c, "chunk_id").select("result_id", "pos", T.matched(F.col("chunk_text")).alias("body"), T.matched(F.coalesce("excerpt", F.lit(""))).alias("x"))
    both = both.withColumn("p", F.filter(F.split("x", r"[ ]*[.][.][.]+[ ]*"), lambda x: x != ""))
    tested = F.filter("p", lambda x: F.length(x) >= 12)
    held, n = F.size(F.filter(tested, lambda x: F.contains(F.col("body"), x))), F.size(tested)
    verdict = F.when(F.col("x") == "", "empty").when(held < n, "not verbatim").otherwise("verbatim")
    return both.select("result_id", "pos", F.size("p").cast("long").alias("parts"), n.cast("long").alias("tested"), held.cast("long").alias("held"), (F.size("p") > 1).alias("stitched"), verdict.alias("verdict"))


@query(f"""WITH k AS (SELECT result_id, unnest(documents_cited) AS cited FROM {_RESULTS}),
m AS (SELECT DISTINCT e.result_id, {match_sql('c.document_id')} AS a, {match_sql('c.document_name')} AS b FROM {_EVIDENCE} e JOIN {_CHUNKS} c USING (chunk_id)),
n AS (SELECT DISTINCT result_id, cited, {match_sql('cited')} AS x FROM k WHERE cited IS NOT NULL)
SELECT n.result_id, n.cited, coalesce(bool_or((x <> '' AND a <> '' AND (contains(a, x) OR contains(x, a))) OR (x <> '' AND b <> '' AND (contains(b, x) OR contains(x, b)))), false) AS matched
  FROM n LEFT JOIN m ON m.result_id = n.result_id GROUP BY n.result_id, n.cited""")
def cited_document_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a result names against those of its evidence, by id or name, either in part."""
    k = results(spark, d).select("result_id", F.explode("documents_cited").alias("cited")).filter("cited IS NOT NULL").distinct().withColumn("x", T.matched(F.col("cited")))
    c = chunks(spark, d).select("chunk_id", "document_id", "document_name")
    m = evidence(spark, d).select("result_id", "chunk_id").join(c, "chunk_id").select("result_id", "document_id", "document_name").distinct()
    m = m.select("result_id", T.matched(F.col("document_id")).alias("a"), T.matched(F.col("document_name")).alias("b"))
    near = T.matches_loosely(F.col("x"), F.col("a")) | T.matches_loosely(F.col("x"), F.col("b"))
    return k.join(m, "result_id", "left").groupBy("result_id", "cited").agg(F.coalesce(F.bool_or(near), F.lit(False)).alias("matched"))


_POL = "CASE WHEN regexp_matches({0}, '{neg}') OR regexp_matches({0}, '{scoped}') THEN 'negative' WHEN regexp_matches({0}, '{pos}') THEN 'positive' END"


def _pol(c: str) -> str:
    return _POL.format(c, neg=_sq(T.NEGATIVE), scoped=_sq(T.NEGATED_STANCE), pos=_sq(T.POSITIVE))


@query(f"WITH p AS (SELECT content_type, {_pol('s')} AS polarity FROM (SELECT content_type, {match_sql('chunk_text')} AS s FROM {_CHUNKS})) SELECT content_type, polarity, count(*) AS n FROM p GROUP BY ALL")
def polarity_scan(spark: SparkSession, d: str) -> DataFrame:
    """Stance of chunks: a negated stance dominates."""
    rows = table(spark, d, "chunks").select("chunk_id", "content_type", T.matched(F.col("chunk_text")).alias("s"))
    return rows.select("chunk_id", "content_type", T.polarity(F.col("s")).alias("polarity")).dropDuplicates(["chunk_id"]).groupBy("content_type", "polarity").agg(F.count("*").alias("n"))


_CLAIMS = f"SELECT e.result_id, e.pos, e.chunk_id, {match_sql('e.claim')} AS a, {match_sql('e.excerpt')} AS b FROM {_EVIDENCE} e WHERE claim IS NOT NULL AND excerpt IS NOT NULL"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims (a) and excerpts (b) in matched form."""
    rows = evidence(spark, d).filter("claim IS NOT NULL AND excerpt IS NOT NULL")
    return rows.select("result_id", "pos", "chunk_id", T.matched(F.col("claim")).alias("a"), T.matched(F.col("excerpt")).alias("b"))


@query(f"""WITH k AS (SELECT result_id, pos, {_pol('a')} AS pa, {_pol('b')} AS pb, len(list_intersect({tokens_sql('a')}, {tokens_sql('b')})) AS shared FROM ({_CLAIMS}))
SELECT result_id, pos, pa AS claim_polarity, pb AS excerpt_polarity, shared::BIGINT AS shared, coalesce(pa <> pb AND shared >= 2, false) AS opposed FROM k""")
def claim_polarity(spark: SparkSession, d: str) -> DataFrame:
    """Claims whose stance is opposite to that of the excerpt, where both speak of the same thing."""
    shared = F.size(F.array_intersect(T.content_tokens(F.col("a")), T.content_tokens(F.col("b"))))
    a, b = T.polarity(F.col("a")), T.polarity(F.col("b"))
    return _claims(spark, d).select("result_id", "pos", a.alias("claim_polarity"), b.alias("excerpt_polarity"), shared.cast("long").alias("shared"), F.coalesce((a != b) & (shared >= 2), F.lit(False)).alias("opposed"))


_UNIT_SQL = "(VALUES " + ", ".join(f"('{u}', '{c}', {f}::DOUBLE)" for u, c, f in T.UNITS) + ") u(raw, unit, factor)"


def _quantities_sql(source: str, keys: str, form: str) -> str:
    """Distinct keys, unit and value of a matched form."""
    s = form
    for word, n in T.NUMBER_WORDS:
        s = rf"regexp_replace({s}, '\b{word}\b', '{n}', 'g')"
    one = lambda p, v, u: f"SELECT {keys}, unnest(regexp_extract_all(s, '{p}', {v}))::DOUBLE AS v, unnest(regexp_extract_all(s, '{p}', {u})) AS raw FROM spelt"
    named = " UNION ".join(f"SELECT {keys}, 'month' AS unit, {m}::DOUBLE AS value FROM spelt WHERE regexp_matches(s, '{p}')" for p, m in T.INTERVALS)
    return f"""WITH spelt AS (SELECT {keys}, {s} AS s FROM {source}), raws AS ({one(T.MEASURED_RANGE, 1, 3)} UNION ALL {one(T.MEASURED_RANGE, 2, 3)} UNION ALL {one(T.MEASUREMENT, 1, 2)})
      SELECT {keys}, unit, round(v * factor, 4) AS value FROM raws JOIN {_UNIT_SQL} USING (raw) UNION {named}"""


@query(f"SELECT unit, count(*) AS n, count(DISTINCT value) AS values, min(value) AS least, max(value) AS most FROM ({_quantities_sql(f'(SELECT chunk_id, {match_sql("chunk_text")} AS m FROM {_CHUNKS})', 'chunk_id', 'm')}) GROUP BY unit")
def measurement_scan(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of chunks, each once a chunk, per unit."""
    rows = once(table(spark, d, "chunks").select("chunk_id", T.matched(F.col("chunk_text")).alias("m")).select("chunk_id", T.quantities(F.col("m")).alias("q")), "chunk_id")
    each = rows.select(F.inline("q"))
    return each.groupBy("unit").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"), F.min("value").alias("least"), F.max("value").alias("most"))


@query(f"""WITH c AS ({_CLAIMS}), a AS ({_quantities_sql('c', 'result_id, pos', 'a')}), b AS ({_quantities_sql('c', 'result_id, pos', 'b')})
SELECT a.result_id, a.pos, a.unit, a.value FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.result_id = a.result_id AND b.pos = a.pos AND b.unit = a.unit)
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.result_id = a.result_id AND b.pos = a.pos AND b.unit = a.unit AND b.value = a.value)""")
def numeric_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of a claim that its excerpt, speaking in the same unit, doesn't give."""
    rows = _claims(spark, d).select("result_id", "pos", T.quantities(F.col("a")).alias("qa"), T.quantities(F.col("b")).alias("qb"))
    other = F.filter("qa", lambda x: F.exists(F.col("qb"), lambda y: y["unit"] == x["unit"]) & ~F.array_contains("qb", x))
    return rows.select("result_id", "pos", F.inline(other))


@query(f"""WITH e AS (SELECT result_id, {match_sql("coalesce(string_agg(concat_ws(' ', claim, excerpt), chr(10) ORDER BY pos), '')")} AS b FROM {_EVIDENCE} GROUP BY result_id),
t AS (SELECT r.result_id, {tokens_sql('m')} AS ta, {tokens_sql('e.b')} AS tb FROM (SELECT result_id, {match_sql('answer')} AS m FROM {_RESULTS} WHERE answer IS NOT NULL) r JOIN e USING (result_id))
SELECT result_id, len(ta)::BIGINT AS tokens, {novel_sql('ta', 'tb')}::BIGINT AS novel FROM t""")
def novel_terms(spark: SparkSession, d: str) -> DataFrame:
    """Word stems of an answer that its evidence lacks, but for words that bring nothing new."""
    rows = results(spark, d).filter("answer IS NOT NULL AND size(supporting_evidence) > 0")
    held = F.array_join(F.transform("supporting_evidence", lambda e: F.concat_ws(" ", e["claim"], e["excerpt"])), "\n")
    rows = rows.select("result_id", T.matched(F.col("answer")).alias("a"), T.matched(held).alias("b"))
    rows = rows.select("result_id", T.content_tokens(F.col("a")).alias("ta"), T.content_tokens(F.col("b")).alias("tb"))
    return rows.select("result_id", F.size("ta").cast("long").alias("tokens"), F.size(T.novel_stems(F.col("ta"), F.col("tb"))).cast("long").alias("novel"))


@query(f"""WITH j AS (SELECT e.result_id, e.pos, {match_sql('e.claim')} AS a, {match_sql("concat_ws(chr(10), c.chunk_text, e.excerpt)")} AS b FROM {_EVIDENCE} e JOIN {_CHUNKS} c USING (chunk_id) WHERE trim(e.claim) <> ''),
t AS (SELECT result_id, pos, {tokens_sql('a')} AS ta, {tokens_sql('b')} AS tb FROM j), n AS (SELECT result_id, pos, {novel_sql('ta', 'tb')} AS novel FROM t)
SELECT result_id, pos, novel::BIGINT AS novel, novel >= 2 AS unsupported FROM n""")
def claim_support(spark: SparkSession, d: str) -> DataFrame:
    """Claims with two or more substantive terms that neither the chunk they cite nor its excerpt holds."""
    c = chunks(spark, d).select("chunk_id", "chunk_text")
    rows = evidence(spark, d).filter(F.trim("claim") != "").join(c, "chunk_id")
    rows = rows.select("result_id", "pos", T.matched(F.col("claim")).alias("a"), T.matched(F.concat_ws("\n", "chunk_text", "excerpt")).alias("b"))
    novel = F.size(T.novel_stems(T.content_tokens(F.col("a")), T.content_tokens(F.col("b"))))
    return rows.select("result_id", "pos", novel.cast("long").alias("novel"), (novel >= 2).alias("unsupported"))


_GRADE = "CASE WHEN lower(trim({0})) IN ('', 'nan', 'none', 'null', '<na>', 'n/a') THEN NULL ELSE {0} END"


@query(f"""SELECT document_id, array_to_string(list_sort(list_distinct(list({_GRADE.format('recommendation_grade')}) FILTER ({_GRADE.format('recommendation_grade')} IS NOT NULL))), ',') AS grades, array_to_string(list_sort(list_distinct(list({_GRADE.format('evidence_level')}) FILTER ({_GRADE.format('evidence_level')} IS NOT NULL))), ',') AS levels,
  count(*) FILTER ({_GRADE.format('recommendation_grade')} IS NOT NULL OR {_GRADE.format('evidence_level')} IS NOT NULL) AS graded, count(*) AS n FROM {_CHUNKS} GROUP BY document_id""")
def grade_summary(spark: SparkSession, d: str) -> DataFrame:
    """Grades and levels that are given, sorted, once each; nulls spelt as text are not."""
    g, l = T.present(F.col("recommendation_grade")), T.present(F.col("evidence_level"))
    joined = lambda c: F.when(F.size(F.collect_set(c)) > 0, F.array_join(F.array_sort(F.collect_set(c)), ","))
    return chunks(spark, d).groupBy("document_id").agg(joined(g).alias("grades"), joined(l).alias("levels"), F.count_if(g.isNotNull() | l.isNotNull()).alias("graded"), F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT e.result_id, count(*) AS n, count(c.chunk_id) AS verified, count(*) FILTER (e.chunk_id IS NOT NULL AND c.chunk_id IS NULL) AS unknown FROM {_EVIDENCE} e LEFT JOIN {_CHUNKS} c USING (chunk_id) GROUP BY 1)
SELECT r.result_id, coalesce(n, 0) AS evidence, coalesce(verified, 0) AS verified, CASE WHEN confidence = 'Insufficient Evidence' THEN 'Abstained' WHEN coalesce(verified, 0) = 0 THEN 'Ungrounded' WHEN unknown = 0 AND verified = n THEN 'Grounded' ELSE 'Partially grounded' END AS verdict FROM {_RESULTS} r LEFT JOIN e USING (result_id)""")
def grounding_verdict(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select("chunk_id", F.lit(True).alias("there"))
    per = evidence(spark, d).join(c, "chunk_id", "left").groupBy("result_id").agg(F.count("*").alias("evidence"), F.count("there").alias("verified"))
    both = results(spark, d).join(per, "result_id", "left").fillna(0, ["evidence", "verified"])
    verdict = F.when(F.col("confidence") == "Insufficient Evidence", "Abstained").when(F.col("verified") == 0, "Ungrounded").when(F.col("verified") == F.col("evidence"), "Grounded").otherwise("Partially grounded")
    return both.select("result_id", "evidence", "verified", verdict.alias("verdict"))


@query(f"SELECT k.document_id, count(DISTINCT r.result_id) AS results, count(DISTINCT r.session_id) AS sessions, any_value(m.publication_year) AS year FROM (SELECT result_id, session_id, unnest(documents_cited) AS document_id FROM {_RESULTS}) k JOIN {_RESULTS} r USING (result_id) LEFT JOIN documents_meta m ON m.document_id = k.document_id GROUP BY k.document_id")
def documents_cited(spark: SparkSession, d: str) -> DataFrame:
    cited = results(spark, d).select("result_id", "session_id", F.explode("documents_cited").alias("document_id"))
    per = cited.groupBy("document_id").agg(F.count_distinct("result_id").alias("results"), F.count_distinct("session_id").alias("sessions"))
    return per.join(table(spark, d, "documents_meta").select("document_id", F.col("publication_year").alias("year")), "document_id", "left")


@query(f"""SELECT result_id, array_to_string(list_filter([CASE WHEN regexp_full_match(coalesce(answer, ''), '[ \\t\\n]*') THEN 'empty answer' END, CASE WHEN confidence IS NULL THEN 'no confidence' WHEN confidence NOT IN ('High', 'Medium', 'Low', 'Insufficient Evidence') THEN 'unknown confidence' END,
  CASE WHEN disclaimer IS NULL THEN 'no disclaimer' END, CASE WHEN supporting_evidence IS NULL OR len(supporting_evidence) = 0 THEN 'no evidence' END], lambda x: x IS NOT NULL), '; ') AS findings FROM {_RESULTS}""")
def structure_check(spark: SparkSession, d: str) -> DataFrame:
    """Fields that an answer lacks or that hold something unexpected."""
    found = [
        F.when(F.coalesce("answer", F.lit("")).rlike(r"^[ \t\n]*$"), "empty answer"),
        F.when(F.col("confidence").isNull(), "no confidence").when(~F.col("confidence").isin("High", "Medium", "Low", "Insufficient Evidence"), "unknown confidence"),
        F.when(F.col("disclaimer").isNull(), "no disclaimer"),
        F.when(F.coalesce(F.size("supporting_evidence"), F.lit(0)) <= 0, "no evidence"),
    ]
    return results(spark, d).select("result_id", F.array_join(F.filter(F.array(*found), lambda x: x.isNotNull()), "; ").alias("findings"))


@query(f"""SELECT coalesce(confidence, '-') AS confidence, count(*) AS n, count(*) FILTER (len(supporting_evidence) > 0) AS with_evidence, round(avg(top_score), 6) AS mean_score, min(latency_ms) AS least_ms, max(latency_ms) AS most_ms,
  round(quantile_cont(latency_ms, 0.5), 3) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 3) AS p95_ms FROM {_RESULTS} GROUP BY 1""")
def latency_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Counts, mean score and latency percentiles (linear between neighbours)."""
    rows = results(spark, d).select(F.coalesce("confidence", F.lit("-")).alias("confidence"), "supporting_evidence", "top_score", "latency_ms")
    exact = O.percentiles(rows, "confidence", "latency_ms", {"p50": 0.5, "p95": 0.95}).select("confidence", F.round("p50", 3).alias("p50_ms"), F.round("p95", 3).alias("p95_ms"))
    return rows.groupBy("confidence").agg(F.count("*").alias("n"), F.count_if(F.size("supporting_evidence") > 0).alias("with_evidence"), F.round(F.avg("top_score"), 6).alias("mean_score"), F.min("latency_ms").alias("least_ms"), F.max("latency_ms").alias("most_ms")).join(exact, "confidence", "left")


@query(f"""SELECT result_id, (floor(length(answer) / 3.5) + 256)::BIGINT AS tokens, (floor(length(answer) / 3.5) + 256) > 350 AS over_budget FROM {_RESULTS} WHERE answer IS NOT NULL""")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    n = T.token_estimate(F.col("answer"))
    return results(spark, d).filter("answer IS NOT NULL").select("result_id", n.alias("tokens"), (n > 350).alias("over_budget"))


@query(rf"""WITH y AS (SELECT result_id, unnest(regexp_extract_all(answer, '\[([A-Z]+_\d{{4}}), p\. (\d+)\]', 1)) AS document_id, unnest(regexp_extract_all(answer, '\[([A-Z]+_\d{{4}}), p\. (\d+)\]', 2))::INT AS page FROM {_RESULTS} WHERE answer IS NOT NULL),
p AS (SELECT DISTINCT document_id, page_number FROM pages_df)
SELECT y.result_id, y.document_id, y.page, p.page_number IS NOT NULL AS exists FROM y LEFT JOIN p ON p.document_id = y.document_id AND p.page_number = y.page""")
def cited_pages(spark: SparkSession, d: str) -> DataFrame:
    """Page citations inside answers against the pages there are."""
    pattern = r"\[([A-Z]+_\d{4}), p\. (\d+)\]"
    both = F.arrays_zip(F.regexp_extract_all("answer", F.lit(pattern), F.lit(1)).alias("d"), F.regexp_extract_all("answer", F.lit(pattern), F.lit(2)).alias("p"))
    cited = results(spark, d).filter("answer IS NOT NULL").select("result_id", F.explode(both).alias("c")).select("result_id", F.col("c.d").alias("document_id"), F.col("c.p").cast("int").alias("page"))
    there = table(spark, d, "pages_df").select("document_id", F.col("page_number").alias("page"), F.lit(True).alias("there")).distinct()
    return cited.join(there, ["document_id", "page"], "left").select("result_id", "document_id", "page", F.col("there").isNotNull().alias("exists"))


@query(f"""WITH e AS (SELECT result_id, string_agg(pos || '. ' || coalesce(claim, '') || ' [' || coalesce(chunk_id, '-') || ']', chr(10) ORDER BY pos) AS block FROM {_EVIDENCE} GROUP BY 1)
SELECT result_id, query || chr(10) || coalesce(block, '') AS rendered FROM {_RESULTS} LEFT JOIN e USING (result_id)""")
def evidence_card(spark: SparkSession, d: str) -> DataFrame:
    """A question with its evidence in order, as text."""
    each = F.transform("supporting_evidence", lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(e["claim"], F.lit("")), F.lit(" ["), F.coalesce(e["chunk_id"], F.lit("-")), F.lit("]")))
    return results(spark, d).select("result_id", F.concat("query", F.lit("\n"), F.coalesce(F.array_join(each, "\n"), F.lit(""))).alias("rendered"))


@query(f"""WITH t AS (SELECT session_id, created_at, result_id, epoch_us(created_at) // 1000 - epoch_us(lag(created_at) OVER w) // 1000 AS gap FROM {_RESULTS} WINDOW w AS (PARTITION BY session_id ORDER BY created_at, result_id))
SELECT session_id, count(*) AS n, count(*) FILTER (gap > 86400000) AS pauses, coalesce(max(gap), 0) AS longest_ms FROM t GROUP BY session_id""")
def session_pauses(spark: SparkSession, d: str) -> DataFrame:
    """Pauses of more than a day inside sessions."""
    rows = results(spark, d).select("session_id", "result_id", F.unix_millis(F.col("created_at").cast("timestamp")).alias("ms"))
    rows = O.beside(O.blocked(rows, "ms", 7 * 86400000), "session_id", ["ms", "result_id"], F.col("ms"), "before", back=True)
    gap = F.col("ms") - F.col("before")
    return rows.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(gap > 86400000).alias("pauses"), F.coalesce(F.max(gap), F.lit(0)).alias("longest_ms"))


@query(f"""WITH c AS (SELECT result_id, chunk_id, row_number() OVER (PARTITION BY result_id ORDER BY pos) AS k FROM {_EVIDENCE} WHERE chunk_id IS NOT NULL),
e AS (SELECT result_id, pos, chunk_id FROM {_EVIDENCE}), d AS (SELECT DISTINCT result_id, chunk_id FROM c WHERE k <= 2), known AS (SELECT chunk_id FROM {_CHUNKS})
SELECT e.result_id, e.pos, CASE WHEN e.chunk_id IS NULL THEN 'no chunk' WHEN e.chunk_id NOT IN (SELECT chunk_id FROM known) THEN 'made up' WHEN d.chunk_id IS NULL THEN 'not cited' ELSE 'cited' END AS state FROM e LEFT JOIN d ON d.result_id = e.result_id AND d.chunk_id = e.chunk_id""")
def evidence_citations(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of evidence against the chunks that the answer cites (its first two) and those there are."""
    e = evidence(spark, d).select("result_id", "pos", "chunk_id")
    k = F.row_number().over(W.partitionBy("result_id").orderBy("pos"))
    cited = e.filter("chunk_id IS NOT NULL").withColumn("k", k).filter("k <= 2").select("result_id", "chunk_id", F.lit(True).alias("cited")).distinct()
    known = chunks(spark, d).select("chunk_id", F.lit(True).alias("known"))
    both = e.join(known, "chunk_id", "left").join(cited, ["result_id", "chunk_id"], "left")
    state = F.when(F.col("chunk_id").isNull(), "no chunk").when(F.col("known").isNull(), "made up").when(F.col("cited").isNull(), "not cited").otherwise("cited")
    return both.select("result_id", "pos", state.alias("state"))
