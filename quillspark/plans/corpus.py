"""Queries on pages, chunks and recommendations: classification, audits, joins on page ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import ordered as O
from quillspark.operators import sections as S
from quillspark.plans.registry import query, table
from quillspark.session import stored

_WS = r"[ \t\n\x0b\f\r\x{a0}]+"


def once(df: DataFrame, key: str) -> DataFrame:
    """Each key once, as first delivered; deliveries carry the same content."""
    return df.dropDuplicates([key])


_PAGES = "(SELECT DISTINCT ON (page_key) * FROM pages_df ORDER BY page_key, ingested_at)"
_CHUNKS = "(SELECT DISTINCT ON (chunk_id) * FROM chunks ORDER BY chunk_id, ingested_at)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "pages_df"), "page_key")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "chunks"), "chunk_id")


@query(f"""SELECT document_id, count(*) AS n_chunks, count(DISTINCT page_number) AS n_pages, max(token_count)::BIGINT AS most_tokens,
  count(*) FILTER (section_title IS NULL) AS without_section FROM {_CHUNKS} GROUP BY document_id""")
def corpus_by_document(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.count_distinct("page_number").alias("n_pages"), F.max("token_count").cast("long").alias("most_tokens"), F.count_if(F.col("section_title").isNull()).alias("without_section"))


@query(f"""SELECT m.document_id, m.publication_year, coalesce(c.n, 0) AS n_chunks FROM documents_meta m
  LEFT JOIN (SELECT document_id, count(*) AS n FROM {_CHUNKS} GROUP BY 1) c USING (document_id)""")
def corpus_with_years(spark: SparkSession, d: str) -> DataFrame:
    n = chunks(spark, d).groupBy("document_id").agg(F.count("*").alias("n"))
    return table(spark, d, "documents_meta").join(n, "document_id", "left").select("document_id", "publication_year", F.coalesce("n", F.lit(0)).alias("n_chunks"))


_STATUS = ["ok", "low_text", "image_only", "ocr_required", "corrupted"]


@query(f"SELECT document_id, {', '.join(f'''count(*) FILTER (extraction_status = '{s}') AS {s}''' for s in _STATUS)} FROM {_PAGES} GROUP BY document_id")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).groupBy("document_id").pivot("extraction_status", _STATUS).count().fillna(0)


@query(f"""SELECT document_id, CASE max(CASE extraction_status WHEN 'corrupted' THEN 3 WHEN 'ocr_required' THEN 2 WHEN 'ok' THEN 0 ELSE 1 END)
  WHEN 3 THEN 'corrupted' WHEN 2 THEN 'ocr_required' WHEN 1 THEN 'partial' ELSE 'ok' END AS status FROM {_PAGES} GROUP BY document_id""")
def doc_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Worst status of a document's pages."""
    s = F.col("extraction_status")
    rank = F.max(F.when(s == "corrupted", 3).when(s == "ocr_required", 2).when(s == "ok", 0).otherwise(1))
    named = F.element_at(F.array(*[F.lit(x) for x in ("ok", "partial", "ocr_required", "corrupted")]), F.col("r") + 1)
    return pages(spark, d).groupBy("document_id").agg(rank.alias("r")).select("document_id", named.alias("status"))


_ALNUM = r"length(regexp_replace(regexp_replace({0}, '[ \t\n\x0b\f\r\x{{a0}}]+', '', 'g'), '[^\p{{L}}\p{{N}}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace({0}, '[ \t\n\x0b\f\r\x{{a0}}]+', '', 'g')), 0)"


@query(rf"""WITH p AS (SELECT page_key, coalesce(raw_text, '') AS t FROM {_PAGES}),
m AS (SELECT page_key, t, length(trim(t)) AS n, length(t) - length(replace(t, '�', '')) AS lost, len(regexp_extract_all(t, '\.{{5,}}')) >= 4 AS toc,
  len(list_filter(string_split(t, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2 AND trim(x) <> '')) AS bars,
  len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) AS filled, {_ALNUM.format('t')} AS alnum FROM p)
SELECT page_key, CASE WHEN n = 0 THEN 'image_only' WHEN lost >= 12 AND lost / n > 0.02 THEN 'corrupted'
  WHEN toc OR bars >= 3 OR bars / greatest(filled, 1) >= 0.4 THEN CASE WHEN n < 80 THEN 'low_text' ELSE 'ok' END
  WHEN n >= 80 AND 1 - alnum >= 0.65 THEN 'corrupted' WHEN n < 80 THEN 'low_text' ELSE 'ok' END AS status FROM m""")
def extraction_status(spark: SparkSession, d: str) -> DataFrame:
    # Judged before deliveries are made one, so that only keys and labels are shuffled.
    return once(table(spark, d, "pages_df").select("page_key", T.extraction_status(F.col("raw_text")).alias("status")), "page_key")


def _sq(s: str) -> str:
    return s.replace("'", "''")


_CONTENT = rf"""WITH c AS (SELECT chunk_id, trim(coalesce(chunk_text, '')) AS b, coalesce(section_title, '') AS s FROM {_CHUNKS}),
m AS (SELECT *, length(regexp_replace(b, '[ \t\n\x0b\f\r]+', '', 'g')) AS compact, {_ALNUM.format('b')} AS alnum,
  coalesce(list_sum(list_transform(regexp_extract_all(b, '{T.DOT_LEADER}'), lambda x: length(regexp_replace(x, '[^.]', '', 'g')))), 0) AS leaders,
  trim(regexp_replace(b, '[ \t\n\x0b\f\r\x{{a0}}]+', ' ', 'g')) AS sq,
  trim(regexp_replace(regexp_replace(regexp_replace(b, '{T.BOILERPLATE}', ' ', 'g'), '(?i)page\s*\d+\s*of\s*\d*|https?://\S+|www\.\S+', ' ', 'g'), '[ \t\n\x0b\f\r\x{{a0}}]+', ' ', 'g')) AS rest FROM c)
SELECT chunk_id, CASE WHEN b = '' THEN 'boilerplate' WHEN leaders / greatest(compact, 1) >= 0.10 THEN 'toc' WHEN compact >= 20 AND alnum < 0.20 THEN 'boilerplate'
  WHEN regexp_matches(b, '{T.RECOMMENDATION}') AND regexp_matches(b, '{T.CLINICAL}') THEN 'clinical' WHEN regexp_matches(s, '{T.REFERENCE_SECTION}') THEN 'reference'
  WHEN len(regexp_extract_all(b, '{T.CITATION}')) >= 3 THEN 'reference'
  WHEN regexp_matches(b, '{T.BOILERPLATE}') AND length(rest) < 200 AND NOT regexp_matches(rest, '{T.CLINICAL}') THEN 'boilerplate'
  WHEN length(sq) < 200 AND NOT regexp_matches(sq, '{T.CLINICAL}') THEN 'title_only' ELSE 'clinical' END AS kind FROM m"""


@query(_CONTENT)
def content_class(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "chunks").select("chunk_id", T.content_type(F.col("chunk_text"), F.col("section_title")).alias("kind")), "chunk_id")


@query(f"SELECT k.kind, c.content_type, count(*) AS n FROM ({_CONTENT}) k JOIN {_CHUNKS} c USING (chunk_id) GROUP BY CUBE (k.kind, c.content_type)")
def content_class_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Computed against stored content type, with all subtotals."""
    rows = table(spark, d, "chunks").select("chunk_id", T.content_type(F.col("chunk_text"), F.col("section_title")).alias("kind"), "content_type")
    return once(rows, "chunk_id").cube("kind", "content_type").agg(F.count("*").alias("n"))


_INVALID = rf"""SELECT chunk_id, list_filter([CASE WHEN document_id = '' OR document_id IS NULL THEN 'missing document_id' END, CASE WHEN page_number IS NULL THEN 'missing page_number' END,
  CASE WHEN coalesce(source_file, '') = '' THEN 'missing source_file' END, CASE WHEN trim(coalesce(chunk_text, '')) = '' THEN 'empty chunk' WHEN length(trim(chunk_text)) < 50 THEN 'extremely short' END,
  CASE WHEN length(chunk_text) > 2600 THEN 'excessively large' END, CASE WHEN token_count > 512 THEN 'over token limit' END,
  CASE WHEN regexp_matches(chunk_text, '\d\.\d+\.\d{{2}}') THEN 'broken numeric range' END, CASE WHEN contains(chunk_text, '���') THEN 'corrupted text' END], lambda x: x IS NOT NULL) AS issues FROM {_CHUNKS}"""


def _issues(df: DataFrame) -> DataFrame:
    t = F.col("chunk_text")
    found = [
        F.when(F.coalesce("document_id", F.lit("")) == "", "missing document_id"),
        F.when(F.col("page_number").isNull(), "missing page_number"),
        F.when(F.coalesce("source_file", F.lit("")) == "", "missing source_file"),
        F.when(F.trim(F.coalesce(t, F.lit(""))) == "", "empty chunk").when(F.length(F.trim(t)) < 50, "extremely short"),
        F.when(F.length(t) > 2600, "excessively large"),
        F.when(F.col("token_count") > 512, "over token limit"),
        F.when(t.rlike(r"\d\.\d+\.\d{2}"), "broken numeric range"),
        F.when(t.contains("���"), "corrupted text"),
    ]
    return df.withColumn("issues", F.filter(F.array(*found), lambda x: x.isNotNull()))


@query(f"SELECT chunk_id, array_to_string(issues, '; ') AS issues FROM ({_INVALID}) WHERE len(issues) > 0")
def chunk_quality(spark: SparkSession, d: str) -> DataFrame:
    bad = _issues(table(spark, d, "chunks")).filter(F.size("issues") > 0)
    return once(bad.select("chunk_id", F.array_join("issues", "; ").alias("issues")), "chunk_id")


@query(f"SELECT count(*) AS total, count(*) FILTER (len(issues) = 0) AS valid, count(*) FILTER (len(issues) > 0) AS invalid, CASE WHEN count(*) FILTER (len(issues) > 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({_INVALID})")
def chunk_quality_report(spark: SparkSession, d: str) -> DataFrame:
    bad = F.size("issues") > 0
    return once(_issues(table(spark, d, "chunks")).select("chunk_id", "issues"), "chunk_id").agg(F.count("*").alias("total"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"), F.when(F.count_if(bad) == 0, "PASS").otherwise("FAIL").alias("status"))


@query(f"""SELECT chunk_id, document_id, token_count FROM {_CHUNKS} WHERE trim(chunk_text) <> '' AND NOT contains(chunk_text, '���') AND content_type NOT IN ('reference', 'toc', 'boilerplate', 'title_only')
  AND lower(trim(document_type)) IN ('official guideline', 'government/public health recommendation') AND chunk_id NOT IN (SELECT chunk_id FROM ({_INVALID}) WHERE len(issues) > 0)""")
def embeddable_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that go into the index: valid, informative, from guidelines."""
    rows = table(spark, d, "chunks")
    good = rows.filter((F.trim("chunk_text") != "") & ~F.col("chunk_text").contains("���") & ~F.col("content_type").isin("reference", "toc", "boilerplate", "title_only") & F.lower(F.trim("document_type")).isin("official guideline", "government/public health recommendation"))
    return once(_issues(good).filter(F.size("issues") == 0).select("chunk_id", "document_id", "token_count"), "chunk_id")


@query(rf"SELECT md5(trim(regexp_replace(chunk_text, '[ \t\n\x0b\f\r\x{{a0}}]+', ' ', 'g'))) AS digest, count(*) AS copies, count(DISTINCT document_id) AS documents, min(chunk_id) AS first_chunk FROM {_CHUNKS} GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "chunks").select("chunk_id", "document_id", F.md5(T.squashed(F.col("chunk_text"))).alias("digest")), "chunk_id").groupBy("digest").agg(F.count("*").alias("copies"), F.count_distinct("document_id").alias("documents"), F.min("chunk_id").alias("first_chunk")).filter("copies > 1")


@query(r"SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS kept FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One document per distinct content, the first by id, and how many were left out for it."""
    return table(spark, d, "documents").filter("text IS NOT NULL").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept"))


_SHINGLES = "list_distinct(list_transform(range(1, greatest(len({0}) - 6, 1)), lambda i: array_to_string(list_slice({0}, i, i + 7), ' ')))"


@query(rf"""WITH t AS (SELECT chunk_id, document_id, regexp_extract_all(lower(chunk_text), '[a-z0-9]+') AS w, lag(regexp_extract_all(lower(chunk_text), '[a-z0-9]+')) OVER (PARTITION BY document_id ORDER BY page_start, chunk_id) AS p FROM {_CHUNKS}),
s AS (SELECT chunk_id, document_id, {_SHINGLES.format('w')} AS a, {_SHINGLES.format('p')} AS b FROM t WHERE p IS NOT NULL)
SELECT document_id, count(*) AS pairs, round(max(len(list_intersect(a, b)) / greatest(len(a) + len(b) - len(list_intersect(a, b)), 1)), 6) AS most_alike,
  count(*) FILTER (len(list_intersect(a, b)) / greatest(len(a) + len(b) - len(list_intersect(a, b)), 1) >= 0.85) AS near FROM s GROUP BY document_id""")
def near_dup_adjacent(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of neighbouring chunks by shared runs of eight words."""
    w = F.regexp_extract_all(F.lower("chunk_text"), F.lit("[a-z0-9]+"), F.lit(0))
    n = F.greatest(F.size("w") - 7, F.lit(0))
    runs = F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("w", i, 8), " "))).otherwise(F.expr("cast(array() AS array<string>)")))
    # Runs as numbers, made before deliveries are made one: no text is shuffled.
    rows = table(spark, d, "chunks").select("chunk_id", "document_id", "page_start", w.alias("w")).select("chunk_id", "document_id", "page_start", F.transform(runs, lambda x: F.xxhash64(x)).alias("a"))
    rows = once(rows, "chunk_id")
    rows = O.beside(O.blocked(rows, "page_start"), "document_id", ["page_start", "chunk_id"], F.col("a"), "b", back=True).filter("b IS NOT NULL")
    shared = F.size(F.array_intersect("a", "b"))
    alike = shared / F.greatest(F.size("a") + F.size("b") - shared, F.lit(1))
    return rows.withColumn("alike", alike).groupBy("document_id").agg(F.count("*").alias("pairs"), F.round(F.max("alike"), 6).alias("most_alike"), F.count_if(F.col("alike") >= 0.85).alias("near"))


@query(rf"""WITH p AS (SELECT document_id, page_key, list_filter(list_transform(string_split(coalesce(raw_text, ''), chr(10)), lambda x: regexp_replace(x, '^[ \t]+|[ \t]+$', '', 'g')), lambda x: x <> '') AS l FROM {_PAGES}),
n AS (SELECT document_id, count(*) AS pages FROM p GROUP BY 1),
e AS (SELECT document_id, 'header' AS place, unnest(list_slice(l, 1, 2)) AS line FROM p UNION ALL SELECT document_id, 'footer', unnest(list_slice(l, greatest(len(l) - 1, 1), len(l))) FROM p)
SELECT document_id, place, line, count(*) AS n FROM e JOIN n USING (document_id) WHERE length(line) <= 100 AND pages >= 3 GROUP BY document_id, place, line, pages HAVING count(*) >= greatest(3, floor(pages * 0.5))""")
def header_footer_lines(spark: SparkSession, d: str) -> DataFrame:
    """First and last two lines that come back on half of a document's pages."""
    lines = F.filter(F.transform(F.split(F.coalesce("raw_text", F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", "")), lambda x: x != "")
    rows = pages(spark, d).select("document_id", lines.alias("l"))
    total = rows.groupBy("document_id").agg(F.count("*").alias("pages"))
    last = F.slice("l", F.greatest(F.size("l") - 1, F.lit(1)), 2)
    edge = rows.select("document_id", F.explode(F.concat(F.transform(F.slice("l", 1, 2), lambda x: F.struct(F.lit("header").alias("place"), x.alias("line"))), F.transform(last, lambda x: F.struct(F.lit("footer").alias("place"), x.alias("line"))))).alias("e")).select("document_id", "e.*")
    counted = edge.filter(F.length("line") <= 100).groupBy("document_id", "place", "line").agg(F.count("*").alias("n"))
    return counted.join(total, "document_id").filter("pages >= 3 AND n >= greatest(3, floor(pages * 0.5))").select("document_id", "place", "line", "n")


def _bag(column: str) -> str:
    return rf"list_transform(regexp_extract_all(trim(regexp_replace(translate({column}, '–−', '--'), '[ \t\n\x0b\f\r\x{{a0}}]+', ' ', 'g')), '{T.NUMERIC}'), lambda x: replace(replace(replace(lower(trim(x)), ' ', ''), '≥', '>='), '≤', '<='))"


_LOSS = f"""WITH p AS (SELECT page_key, {_bag('raw_text')} AS r, {_bag("coalesce(clean_text, '')")} AS c FROM {_PAGES} WHERE raw_text IS NOT NULL AND clean_text IS NOT NULL),
a AS (SELECT page_key, t, count(*) AS n FROM (SELECT page_key, unnest(r) AS t FROM p) GROUP BY ALL), b AS (SELECT page_key, t, count(*) AS n FROM (SELECT page_key, unnest(c) AS t FROM p) GROUP BY ALL),
m AS (SELECT page_key, a.t, a.n - coalesce(b.n, 0) AS missing FROM a LEFT JOIN b USING (page_key, t) WHERE a.n > coalesce(b.n, 0)) """


def _numbers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "pages_df").filter("raw_text IS NOT NULL AND clean_text IS NOT NULL").select("page_key", T.numeric_tokens(F.col("raw_text")).alias("raw"), T.numeric_tokens(F.col("clean_text")).alias("clean"))
    rows = once(rows, "page_key")
    side = lambda c, s: rows.select("page_key", F.explode(c).alias("t"), F.lit(s).alias("s"))  # noqa: E731
    # One pass over both bags: copies in the raw text less those in the clean one.
    bags = side("raw", 1).unionAll(side("clean", -1)).groupBy("page_key", "t").agg(F.sum("s").alias("missing"))
    return rows, bags.filter("missing > 0")


@query(_LOSS + "SELECT page_key, t AS token, missing::BIGINT AS missing FROM m")
def numeric_bag_loss(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the raw text that the clean text lacks."""
    return _numbers(spark, d)[1].select("page_key", F.col("t").alias("token"), "missing")


@query(_LOSS + f", tot AS (SELECT sum(len(r))::BIGINT AS n FROM p) SELECT any_value(n) AS numbers, coalesce(sum(missing), 0)::BIGINT AS missing, round(coalesce(sum(missing), 0) / any_value(n), 6) AS loss, coalesce(sum(missing) FILTER (regexp_matches(t, '{T.CRITICAL}')), 0)::BIGINT AS critical FROM tot LEFT JOIN m ON true")
def numeric_loss_report(spark: SparkSession, d: str) -> DataFrame:
    rows, missing = _numbers(spark, d)
    total = rows.agg(F.sum(F.size("raw"))).first()[0]
    critical = F.coalesce(F.sum(F.when(F.col("t").rlike(T.CRITICAL), F.col("missing"))), F.lit(0))
    lost = missing.agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"), critical.alias("critical"))
    return lost.select(F.lit(total).cast("long").alias("numbers"), "missing", F.round(F.col("missing") / total, 6).alias("loss"), "critical")


@query(f"""SELECT document_type, min(token_count)::BIGINT AS least, max(token_count)::BIGINT AS most, round(avg(token_count), 2) AS mean, quantile_cont(token_count, 0.5) AS median,
  list_sort(list(token_count))[count(*) // 2 + 1]::BIGINT AS upper_median, list_sort(list(token_count))[floor(0.9 * (count(*) - 1))::BIGINT + 1]::BIGINT AS p90, count(*) FILTER (token_count > 512) AS over_limit FROM {_CHUNKS} GROUP BY document_type""")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of chunks. Order statistics come from counts per size, so no group is collected whole."""
    per = chunks(spark, d).groupBy("document_type", "token_count").agg(F.count("*").alias("n"))
    w = W.partitionBy("document_type").orderBy("token_count")
    cum = per.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy("document_type")))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("token_count")))  # noqa: E731
    total = F.col("total")
    out = cum.groupBy("document_type").agg(F.min("token_count").cast("long").alias("least"), F.max("token_count").cast("long").alias("most"), F.round(F.sum(F.col("token_count") * F.col("n")) / F.sum("n"), 2).alias("mean"), ((at(F.ceil(total / 2)) + at(F.floor(total / 2) + 1)) / 2).alias("median"), at(F.floor(total / 2) + 1).cast("long").alias("upper_median"), at(F.floor(0.9 * (total - 1)) + 1).cast("long").alias("p90"), F.coalesce(F.sum(F.when(F.col("token_count") > 512, F.col("n"))), F.lit(0)).alias("over_limit"))
    return out


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9]+(?:\.[0-9]+)?|[a-z]+(?:''[a-z]+)?') AS w FROM (SELECT doc_id, replace(replace(text, '‘', ''''), '’', '''') AS text FROM documents)),
s AS (SELECT doc_id, unnest(range(0, greatest(len(w) - 20, 1), 100)) AS a, w FROM t WHERE len(w) > 0)
SELECT doc_id, format('{}__c{:04d}', doc_id, (a // 100)::INT) AS chunk_id, a AS first_token, least(len(w) - a, 120) AS n_tokens, md5(array_to_string(list_slice(w, a + 1, a + 120), ' ')) AS digest FROM s""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 120 tokens that share 20 with the one before."""
    t = F.regexp_extract_all(F.lower(F.translate(F.coalesce("text", F.lit("")), "‘’", "''")), F.lit(T.LEXICAL), F.lit(0))
    rows = table(spark, d, "documents").select("doc_id", t.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 21, F.lit(0)), F.lit(100))
    each = rows.select("doc_id", "w", F.explode(starts).alias("a"))
    return each.select("doc_id", F.format_string("%d__c%04d", F.col("doc_id"), (F.col("a") / 100).cast("int")).alias("chunk_id"), F.col("a").cast("long").alias("first_token"), F.least(F.size("w") - F.col("a"), F.lit(120)).cast("long").alias("n_tokens"), F.md5(F.array_join(F.slice("w", F.col("a") + 1, 120), " ")).alias("digest"))


_ATTACH = rf"""WITH c AS (SELECT chunk_id, document_id, page_start, page_end, chunk_text, trim(regexp_replace(chunk_text, '[ \t\n\x0b\f\r\x{{a0}}]+', ' ', 'g')) AS norm FROM {_CHUNKS}),
r AS (SELECT DISTINCT document_id, page_number, recommendation_id, recommendation_text, evidence_level, substr(trim(regexp_replace(source_excerpt, '[ \t\n\x0b\f\r\x{{a0}}]+', ' ', 'g')), 1, 80) AS head FROM recommendations),
m AS (SELECT chunk_id, r.*, row_number() OVER (PARTITION BY chunk_id ORDER BY page_number, recommendation_text, recommendation_id, evidence_level) AS k FROM c JOIN r ON c.document_id = r.document_id
  AND r.page_number BETWEEN c.page_start AND c.page_end AND (contains(c.norm, r.head) OR contains(c.chunk_text, r.recommendation_id)))"""


def _attached(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = chunks(spark, d).select("chunk_id", "document_id", "page_start", "page_end", "chunk_text", T.squashed(F.col("chunk_text")).alias("norm"))
    r = table(spark, d, "recommendations").select("document_id", "page_number", "recommendation_id", "recommendation_text", "evidence_level", F.substring(T.squashed(F.col("source_excerpt")), 1, 80).alias("head")).distinct()
    # One row per page of a chunk turns the range into an equality, so a long document is not one group.
    paged = c.select("chunk_id", "document_id", "chunk_text", "norm", F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    met = paged.join(r, ["document_id", "page_number"]).filter(F.coalesce(F.contains("norm", "head"), F.lit(False)) | F.coalesce(F.contains("chunk_text", "recommendation_id"), F.lit(False)))
    order = ["page_number", F.asc_nulls_last("recommendation_text"), F.asc_nulls_last("recommendation_id"), F.asc_nulls_last("evidence_level")]
    return c, met.withColumn("k", F.row_number().over(W.partitionBy("chunk_id").orderBy(*order)))


@query(_ATTACH + " SELECT chunk_id, recommendation_id, evidence_level, page_number FROM c LEFT JOIN (SELECT * EXCLUDE (document_id) FROM m WHERE k = 1) USING (chunk_id)")
def recommendation_attach(spark: SparkSession, d: str) -> DataFrame:
    """The first recommendation on a chunk's pages whose excerpt or id the chunk holds."""
    c, met = _attached(spark, d)
    first = met.filter("k = 1").select("chunk_id", "recommendation_id", "evidence_level", "page_number")
    return c.select("chunk_id").join(first, "chunk_id", "left")


@query(_ATTACH + f""" SELECT c.chunk_id, CASE WHEN k.anchor_kind = 'recommendation' THEN coalesce(m.recommendation_id, k.anchor_label) ELSE m.recommendation_id END AS recommendation_id, m.recommendation_id IS NULL AND k.anchor_kind = 'recommendation' AND k.anchor_label IS NOT NULL AS from_label
  FROM c JOIN {_CHUNKS} k USING (chunk_id) LEFT JOIN (SELECT chunk_id, recommendation_id FROM m WHERE k = 1) m USING (chunk_id)""")
def recommendation_labels(spark: SparkSession, d: str) -> DataFrame:
    """The recommendation of each chunk; chunks cut at a recommendation fall back on their anchor's label."""
    own = chunks(spark, d).select("chunk_id", F.when(F.col("anchor_kind") == "recommendation", F.col("anchor_label")).alias("label"))
    both = own.join(recommendation_attach(spark, d).select("chunk_id", F.col("recommendation_id").alias("attached")), "chunk_id", "left")
    return both.select("chunk_id", F.coalesce("attached", "label").alias("recommendation_id"), (F.col("attached").isNull() & F.col("label").isNotNull()).alias("from_label"))


@query(_ATTACH + " SELECT DISTINCT r.document_id, r.recommendation_id FROM r LEFT JOIN m ON m.document_id = r.document_id AND m.recommendation_id = r.recommendation_id WHERE r.recommendation_id IS NOT NULL AND m.chunk_id IS NULL")
def recommendations_unattached(spark: SparkSession, d: str) -> DataFrame:
    """Recommendation ids that no chunk carries."""
    _, met = _attached(spark, d)
    ids = table(spark, d, "recommendations").filter("recommendation_id IS NOT NULL").select("document_id", "recommendation_id").distinct()
    return ids.join(met.filter("recommendation_id IS NOT NULL").select("document_id", "recommendation_id"), ["document_id", "recommendation_id"], "left_anti")


@query(rf"""SELECT r.document_id, r.page_number, count(*) AS recommendations, bool_or(p.document_id IS NOT NULL) AS page_found,
  count(*) FILTER (contains(p.t, substr(trim(regexp_replace(r.source_excerpt, '[ \t\n\x0b\f\r\x{{a0}}]+', ' ', 'g')), 1, 80)) AND length(r.source_excerpt) >= 8) AS traceable
  FROM recommendations r LEFT JOIN (SELECT document_id, page_number, string_agg(trim(regexp_replace(raw_text, '[ \t\n\x0b\f\r\x{{a0}}]+', ' ', 'g')), chr(10) ORDER BY page_key) AS t FROM {_PAGES} GROUP BY ALL) p ON p.document_id = r.document_id AND p.page_number = r.page_number GROUP BY ALL""")
def recommendation_trace(spark: SparkSession, d: str) -> DataFrame:
    """Recommendations against the page they name, in any of its runs: found, and holding the excerpt."""
    p = once(table(spark, d, "pages_df").select("page_key", "document_id", "page_number", T.squashed(F.col("raw_text")).alias("page")), "page_key")
    p = p.groupBy("document_id", "page_number").agg(F.collect_list("page").alias("runs"))
    both = table(spark, d, "recommendations").join(p, ["document_id", "page_number"], "left")
    head = F.substring(T.squashed(F.col("source_excerpt")), 1, 80)
    held = F.exists("runs", lambda x: F.contains(x, head)) & (F.length("source_excerpt") >= 8)
    return both.groupBy("document_id", "page_number").agg(F.count("*").alias("recommendations"), F.bool_or(F.col("runs").isNotNull()).alias("page_found"), F.count_if(held).alias("traceable"))


@query(f"""WITH g AS (SELECT document_id, page_number AS a, page_number + 1 AS b, count(*) AS n FROM recommendations GROUP BY ALL)
SELECT c.chunk_id, count(*) AS passages, sum(n)::BIGINT AS recommendations FROM {_CHUNKS} c JOIN g ON g.document_id = c.document_id AND c.page_start <= g.b AND c.page_end >= g.a GROUP BY c.chunk_id""")
def passage_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Chunks against answer passages of two pages that overlap their pages."""
    g = table(spark, d, "recommendations").groupBy("document_id", "page_number").agg(F.count("*").alias("n")).select("document_id", F.col("page_number").alias("a"), "n")
    pairs = g.select("document_id", "a", "n", F.explode(F.array(F.col("a"), F.col("a") + 1)).alias("page"))
    paged = chunks(spark, d).select("chunk_id", "document_id", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    met = paged.join(pairs, ["document_id", "page"]).select("chunk_id", "a", "n").distinct()
    return met.groupBy("chunk_id").agg(F.count("*").alias("passages"), F.sum("n").alias("recommendations"))


@query(f"""SELECT document_id, count(*) AS answerable, count(DISTINCT c.chunk_id) AS chunks, round(avg(c.page_end > c.page_start), 6) AS multipage, count(DISTINCT c.chunk_id) FILTER (c.page_start = r.page_number) AS by_first_page
  FROM {_CHUNKS} c JOIN recommendations r USING (document_id) WHERE r.page_number BETWEEN c.page_start AND c.page_end AND (regexp_matches(lower(c.chunk_text), 'aneurysm|repair') OR regexp_matches(lower(c.chunk_text), 'surveillance')) GROUP BY document_id""".replace("avg(c.page_end > c.page_start)", "avg((c.page_end > c.page_start)::INT)"))
def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that hold the required facts on a recommendation's page, and those left if only a chunk's first
    page counted."""
    facts = [["aneurysm|repair", "surveillance"]]
    met = F.exists(F.array(*[F.lit(p) for p in facts[0]]), lambda p: F.regexp(F.lower("chunk_text"), p))
    c = chunks(spark, d).filter(met).select("chunk_id", "document_id", "page_start", "page_end", F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    both = c.join(table(spark, d, "recommendations").select("document_id", "page_number"), ["document_id", "page_number"])
    return both.groupBy("document_id").agg(F.count("*").alias("answerable"), F.count_distinct("chunk_id").alias("chunks"), F.round(F.avg((F.col("page_end") > F.col("page_start")).cast("int")), 6).alias("multipage"), F.count_distinct(F.when(F.col("page_start") == F.col("page_number"), F.col("chunk_id"))).alias("by_first_page"))


@query(f"""SELECT chunk_id, row_number() OVER w AS seq, last_value(CASE WHEN anchor_kind = 'section' THEN anchor_label END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_start, chunk_id ROWS UNBOUNDED PRECEDING) AS section,
  lead(chunk_id) OVER w AS next_chunk FROM {_CHUNKS} WINDOW w AS (PARTITION BY document_id ORDER BY page_start, chunk_id)""")
def enclosing_section(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's place in its document, the last section begun before it, and the chunk after it."""
    order = ["page_start", "chunk_id"]
    rows = O.blocked(chunks(spark, d).select("chunk_id", "document_id", "page_start", "anchor_kind", "anchor_label"), "page_start")
    rows = O.carried(rows, "document_id", order, F.when(F.col("anchor_kind") == "section", F.col("anchor_label")), "section")
    rows = O.beside(rows, "document_id", order, F.col("chunk_id"), "next_chunk", back=False)
    return O.numbered(rows, "document_id", order).select("chunk_id", "seq", "section", "next_chunk")


@query(f"SELECT document_id, {', '.join(f'''count(*) FILTER (anchor_kind = '{k}') AS {k}''' for k in ('recommendation', 'section', 'page'))} FROM {_CHUNKS} GROUP BY document_id")
def anchor_census(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("document_id").pivot("anchor_kind", ["recommendation", "section", "page"]).count().fillna(0)


_REQUIRED = ["chunk_id", "document_id", "document_name", "document_type", "page_number", "page_start", "page_end", "source_file", "chunk_text", "token_count"]
_OPTIONAL = ["section_title", "recommendation_id", "recommendation_grade", "evidence_level"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, {str(c in _REQUIRED).lower()} AS required, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (lower(trim({c}::VARCHAR)) IN ('', 'nan', 'none', 'null', '<na>', 'n/a')) AS spelt FROM {_CHUNKS}" for c in _REQUIRED + _OPTIONAL))
def payload_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Missing values per field of the payload, true and spelt as text: one pass, then a row per field."""
    aggs = []
    for c in _REQUIRED + _OPTIONAL:
        spelt = F.count_if(F.lower(F.trim(F.col(c).cast("string"))).isin(T.MISSING))
        aggs.append(F.struct(F.lit(c).alias("field"), F.lit(c in _REQUIRED).alias("required"), F.count_if(F.col(c).isNull()).alias("nulls"), spelt.alias("spelt")).alias(c))
    one = chunks(spark, d).agg(*aggs)
    return one.select(F.inline(F.array(*[F.col(c) for c in _REQUIRED + _OPTIONAL])))


@query(f"""WITH b AS (SELECT document_id, page_start // 64 AS block, sha256(string_agg(chunk_id || chr(10), '' ORDER BY page_start, chunk_id)) AS digest, count(*) AS n FROM {_CHUNKS} GROUP BY ALL)
SELECT document_id, sha256(string_agg(digest || chr(10), '' ORDER BY block)) AS digest, sum(n)::BIGINT AS n FROM b GROUP BY document_id""")
def ordered_id_digest(spark: SparkSession, d: str) -> DataFrame:
    """Order-sensitive digest of each document's chunk ids: of the digests of its blocks of pages, so that no
    document's ids are collected whole."""
    text = lambda c: F.sha2(F.concat(F.array_join(c, "\n"), F.lit("\n")), 256)  # noqa: E731
    rows = O.blocked(chunks(spark, d).select("document_id", "page_start", "chunk_id"), "page_start")
    inner = rows.groupBy("document_id", "block").agg(F.array_sort(F.collect_list(F.struct("page_start", "chunk_id"))).alias("ids"))
    per = inner.select("document_id", "block", text(F.col("ids.chunk_id")).alias("digest"), F.size("ids").alias("n"))
    outer = per.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("block", "digest"))).alias("parts"), F.sum("n").alias("n"))
    return outer.select("document_id", text(F.col("parts.digest")).alias("digest"), "n")


@query(f"""WITH a AS (SELECT document_id, chunk_id, md5(chunk_text) AS t, row_number() OVER (PARTITION BY document_id ORDER BY page_start, chunk_id) AS pos FROM {_CHUNKS}),
b AS (SELECT document_id, chunk_id, md5(coalesce(source_excerpt, '')) AS t, row_number() OVER (PARTITION BY document_id ORDER BY page_start, chunk_id) AS pos FROM {_CHUNKS} WHERE content_type = 'clinical')
SELECT coalesce(a.document_id, b.document_id) AS document_id, count(*) FILTER (a.chunk_id IS NULL OR b.chunk_id IS NULL) AS missing, count(*) FILTER (a.chunk_id <> b.chunk_id) AS other_id, count(*) FILTER (a.t <> b.t) AS other_text
  FROM a FULL JOIN b ON a.document_id = b.document_id AND a.pos = b.pos GROUP BY 1""")
def reproducibility(spark: SparkSession, d: str) -> DataFrame:
    """A stored selection against one made anew, position by position."""
    rows = O.blocked(chunks(spark, d).select("document_id", "page_start", "chunk_id", "chunk_text", "source_excerpt", "content_type"), "page_start")
    number = lambda df: O.numbered(df, "document_id", ["page_start", "chunk_id"], "pos")  # noqa: E731
    a = number(rows).select("document_id", "pos", F.col("chunk_id").alias("ia"), F.md5("chunk_text").alias("ta"))
    b = number(rows.filter("content_type = 'clinical'")).select("document_id", "pos", F.col("chunk_id").alias("ib"), F.md5(F.coalesce("source_excerpt", F.lit(""))).alias("tb"))
    both = a.join(b, ["document_id", "pos"], "full_outer")
    return both.groupBy("document_id").agg(F.count_if(F.col("ia").isNull() | F.col("ib").isNull()).alias("missing"), F.count_if(F.col("ia") != F.col("ib")).alias("other_id"), F.count_if(F.col("ta") != F.col("tb")).alias("other_text"))


@query(rf"SELECT page_key, concat_ws(chr(10) || chr(10), nullif(trim(clean_text), ''), 'Table:' || chr(10) || CASE WHEN NOT contains(replace(coalesce(clean_text, ''), ' ', ''), replace(table_text, ' ', '')) THEN table_text END) AS working_text FROM {_PAGES} WHERE clean_text IS NOT NULL OR table_text IS NOT NULL")
def working_text(spark: SparkSession, d: str) -> DataFrame:
    """A page's clean text and its table, unless the text already holds it."""
    fresh = ~F.contains(F.replace(F.coalesce("clean_text", F.lit("")), F.lit(" "), F.lit("")), F.replace("table_text", F.lit(" "), F.lit("")))
    block = F.concat(F.lit("Table:\n"), F.when(fresh, F.col("table_text")))
    return once(table(spark, d, "pages_df").filter("clean_text IS NOT NULL OR table_text IS NOT NULL").select("page_key", F.concat_ws("\n\n", F.nullif(F.trim("clean_text"), F.lit("")), block).alias("working_text")), "page_key")


@query(r"""SELECT document_id, CASE WHEN regexp_matches(lower(document_name), '\bliving guideline\b') THEN 'living' WHEN regexp_matches(lower(document_name), '\bscreening\b') THEN 'screening' WHEN regexp_matches(lower(document_name), '\bguid(ance|eline)') THEN 'guidance'
  WHEN regexp_matches(lower(document_name), '\bmanagement\b|\bcare\b') THEN 'care' ELSE 'other' END AS family, nullif(regexp_extract(document_id, '_(\d{4})', 1), '')::INT AS year, nullif(regexp_extract(source_url, 'https?://([^/]+)', 1), '') AS host,
  substr(regexp_replace(regexp_replace(document_name, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS slug, concat_ws('; ', 'Type: ' || document_type, 'Source: ' || source_organization) AS note FROM documents_meta""")
def document_identity(spark: SparkSession, d: str) -> DataFrame:
    """Ordered first-match rules on names, and fields read from ids and addresses."""
    name = F.lower("document_name")
    family = F.when(name.rlike(r"\bliving guideline\b"), "living").when(name.rlike(r"\bscreening\b"), "screening").when(name.rlike(r"\bguid(ance|eline)"), "guidance").when(name.rlike(r"\bmanagement\b|\bcare\b"), "care").otherwise("other")
    year = F.nullif(F.regexp_extract("document_id", r"_(\d{4})", 1), F.lit("")).cast("int")
    host = F.nullif(F.regexp_extract("source_url", "https?://([^/]+)", 1), F.lit(""))
    note = F.concat_ws("; ", F.concat(F.lit("Type: "), F.col("document_type")), F.concat(F.lit("Source: "), F.col("source_organization")))
    return table(spark, d, "documents_meta").select("document_id", family.alias("family"), year.alias("year"), host.alias("host"), T.slug(F.col("document_name")).alias("slug"), note.alias("note"))


@query(f"""SELECT extraction_library, count(*) AS pages, count(*) FILTER (extraction_status = 'ok') AS ok, count(*) FILTER (raw_text IS NULL) AS without_text, sum(word_count)::BIGINT AS words, sum(line_count)::BIGINT AS lines,
  count(*) FILTER (length(coalesce(raw_text, '')) <> character_count) AS other_length FROM {_PAGES} GROUP BY GROUPING SETS ((extraction_library), ())""")
def extraction_report(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).rollup("extraction_library").agg(F.count("*").alias("pages"), F.count_if(F.col("extraction_status") == "ok").alias("ok"), F.count_if(F.col("raw_text").isNull()).alias("without_text"), F.sum("word_count").cast("long").alias("words"), F.sum("line_count").cast("long").alias("lines"), F.count_if(F.length(F.coalesce("raw_text", F.lit(""))) != F.col("character_count")).alias("other_length"))


@query(f"""SELECT m.document_id, m.page_count, count(DISTINCT p.page_number) AS found, coalesce(count(DISTINCT p.page_number) <> m.page_count, false) AS differs, coalesce(max(p.page_number) - count(DISTINCT p.page_number), 0) AS gaps
  FROM documents_meta m LEFT JOIN {_PAGES} p USING (document_id) GROUP BY m.document_id, m.page_count""")
def page_count_check(spark: SparkSession, d: str) -> DataFrame:
    """Pages named by the metadata against pages delivered."""
    per = pages(spark, d).groupBy("document_id").agg(F.count_distinct("page_number").alias("found"), F.max("page_number").alias("top"))
    both = table(spark, d, "documents_meta").join(per, "document_id", "left").fillna(0, ["found"])
    return both.select("document_id", "page_count", "found", F.coalesce(F.col("found") != F.col("page_count"), F.lit(False)).alias("differs"), F.coalesce(F.col("top") - F.col("found"), F.lit(0)).alias("gaps"))


@query(f"""SELECT i.chunk_id, substr(trim(c.chunk_text), 1, 240) AS preview, length(c.chunk_text) > 240 AS cut FROM (SELECT DISTINCT unnest(list_transform(supporting_evidence, lambda x: x.chunk_id)) AS chunk_id FROM generation_results) i JOIN {_CHUNKS} c USING (chunk_id)""")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Chunks asked for by id, once each; unknown ids are absent."""
    ids = table(spark, d, "generation_results").select(F.explode("supporting_evidence.chunk_id").alias("chunk_id")).distinct()
    return chunks(spark, d).join(ids, "chunk_id", "left_semi").select("chunk_id", F.substring(F.trim("chunk_text"), 1, 240).alias("preview"), (F.length("chunk_text") > 240).alias("cut"))


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY token_count DESC, chunk_id) AS k FROM {_CHUNKS})
SELECT content_type, k AS place, chunk_id, token_count FROM s WHERE k <= 3""")
def largest_per_type(spark: SparkSession, d: str) -> DataFrame:
    """The three largest chunks of each content type."""
    w = W.partitionBy("content_type").orderBy(F.desc("token_count"), "chunk_id")
    return chunks(spark, d).withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 3").select("content_type", "place", "chunk_id", "token_count")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
m AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^\s*Recommendation\s+\d{1,3}\s*$') OR regexp_matches(line, '^\s*\d{1,2}\.\d{1,2}\.\d{1,2}(\.\d{1,2})?\s+\S') THEN 'recommendation'
  WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN 'heading' WHEN regexp_matches(line, '^\s*\d{1,2}(\.\d{1,2}){0,2}\.?\s+[A-Z][^\n]{4,90}$') AND NOT regexp_matches(line, '\.{4,}|(\.[ \t]){4,}|\bet al\b|doi:|Available at:|[;]|[,;:]\s*$|\.\s+[A-Z]')
    AND length(line) - length(replace(line, ',', '')) < 2 AND len(string_split(trim(line), ' ')) <= 13 THEN 'section' END AS kind, trim(line) AS label FROM l)
SELECT doc_id, line_no, kind, label FROM m WHERE kind IS NOT NULL""")
def anchors(spark: SparkSession, d: str) -> DataFrame:
    """Structural anchors among the lines of documents; the first kind that fits."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    line = F.col("line")
    recommendation = line.rlike(r"^\s*Recommendation\s+\d{1,3}\s*$") | line.rlike(r"^\s*\d{1,2}\.\d{1,2}\.\d{1,2}(\.\d{1,2})?\s+\S")
    shape = line.rlike(r"^\s*\d{1,2}(\.\d{1,2}){0,2}\.?\s+[A-Z][^\n]{4,90}$")
    refused = line.rlike(r"\.{4,}|(\.[ \t]){4,}|\bet al\b|doi:|Available at:|[;]|[,;:]\s*$|\.\s+[A-Z]") | (F.length("line") - F.length(F.replace("line", F.lit(","), F.lit(""))) >= 2) | (F.size(F.split(F.trim("line"), " ")) > 13)
    kind = F.when(recommendation, "recommendation").when(line.rlike(r"^#{1,6}\s+\S"), "heading").when(shape & ~refused, "section")
    return lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), kind.alias("kind"), F.trim("line").alias("label")).filter("kind IS NOT NULL")


def _page_texts(spark: SparkSession, d: str) -> DataFrame:
    """One text per page: that of its last run."""
    rows = table(spark, d, "pages_df").groupBy("document_id", "page_number").agg(F.max_by("raw_text", F.struct("page_key", "ingested_at")).alias("text"))
    return rows.select("document_id", "page_number", "text")


_OWN = r"""WITH p AS (SELECT document_id, page_number, arg_max(coalesce(raw_text, ''), page_key) AS t FROM pages_df GROUP BY ALL),
f AS (SELECT document_id, page_number, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1] AS l FROM p),
o AS (SELECT document_id, page_number, CASE WHEN regexp_matches(l, '^[A-Z]') AND NOT regexp_matches(l, '[.,;:?!-]$') AND length(l) <= 45 AND len(string_split(l, ' ')) <= 6 THEN l END AS own FROM f),
c AS (SELECT *, last_value(own IGNORE NULLS) OVER w AS title, last_value(CASE WHEN own IS NOT NULL THEN page_number END IGNORE NULLS) OVER w AS at_page FROM o WINDOW w AS (PARTITION BY document_id ORDER BY page_number ROWS UNBOUNDED PRECEDING))
SELECT document_id, page_number, CASE WHEN page_number - at_page <= 5 THEN title END AS section, CASE WHEN own IS NOT NULL THEN 'detected' WHEN page_number - at_page <= 5 THEN 'inherited' ELSE 'unknown' END AS section_source FROM c"""


@query(_OWN)
def section_state(spark: SparkSession, d: str) -> DataFrame:
    """The section each page is in, carried for up to five pages."""
    return S.carried_sections(_page_texts(spark, d)).drop("text")


@query()
def atomic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pages cut anew into chunks along their structure."""
    return S.atomic_chunks(_page_texts(spark, d))


@query()
def page_buffer_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pages cut anew into chunks by packing pages."""
    return S.page_buffer_chunks(S.carried_sections(_page_texts(spark, d)).withColumn("status", T.extraction_status(F.col("text"))))


_ANCHOR = rf"""regexp_matches(line, '{S.SECTION_LINE}') AND NOT regexp_matches(line, '{S.NOT_A_SECTION}') AND NOT regexp_matches(trim(regexp_extract(line, '{S.SECTION_LINE}', 2)), '{S.NOT_A_TITLE}')
  AND len(string_split_regex(trim(regexp_extract(line, '{S.SECTION_LINE}', 2)), '\s+')) <= 12"""


@query(rf"""WITH p AS (SELECT document_id, page_number, arg_max(raw_text, page_key || ingested_at) FILTER (raw_text IS NOT NULL) AS t FROM pages_df GROUP BY ALL),
l AS (SELECT document_id, page_number, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line_no FROM p WHERE t IS NOT NULL),
k AS (SELECT *, CASE WHEN regexp_matches(line, '{S.RECOMMENDATION_LINE}') THEN {{'kind': 'recommendation', 'label': regexp_extract(line, '{S.RECOMMENDATION_LINE}', 1)}} WHEN regexp_matches(line, '{S.RECOMMENDATION_ID}') THEN {{'kind': 'recommendation', 'label': regexp_extract(line, '{S.RECOMMENDATION_ID}', 1)}}
  WHEN {_ANCHOR} THEN {{'kind': 'section', 'label': regexp_extract(line, '{S.SECTION_LINE}', 1) || ' ' || trim(regexp_extract(line, '{S.SECTION_LINE}', 2))}} END AS anchor FROM l),
h AS (SELECT *, last_value(anchor.kind IGNORE NULLS) OVER w AS hard FROM k WINDOW w AS (PARTITION BY document_id ORDER BY page_number, line_no ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN anchor IS NOT NULL THEN {{'p': page_number, 'l': line_no, 'kind': anchor.kind, 'label': anchor.label}} WHEN line_no = 0 AND coalesce(hard, '') <> 'recommendation' THEN {{'p': page_number, 'l': line_no, 'kind': 'page', 'label': ''}} END AS own FROM h),
o AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number, line_no ROWS UNBOUNDED PRECEDING) AS s FROM b),
g AS (SELECT document_id, s.p AS page_start, s.l AS line_no, s.kind AS kind, s.label AS label, max(page_number) AS page_end, regexp_replace(string_agg(line, chr(10) ORDER BY page_number, line_no), '^[ 	

]+|[ 	

]+$', '', 'g') AS t FROM o GROUP BY ALL)
SELECT document_id, page_start, page_end, line_no::INT AS line_no, kind, label, length(t)::INT AS chars, md5(t) AS digest FROM g WHERE length(t) >= {S.LEAST_CHARS}""")
def structure_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans that atomic chunks are cut from, whole."""
    rows = S.spans(_page_texts(spark, d), precut=1 << 30)
    return rows.select("document_id", "page_start", "page_end", "line_no", "kind", "label", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query(f"""SELECT strategy, 0::BIGINT AS over_limit, 0::BIGINT AS empty, 0::BIGINT AS repeated_ids, 0::BIGINT AS words_lost FROM (VALUES ('atomic'), ('page_buffer')) t(strategy)""")
def chunk_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What chunks of either strategy must never do: exceed the limit of tokens, be empty, share an id, or lose a word of a
    span that is no shorter than the least (atomic: words of the spans against words of their chunks)."""
    texts = stored(S.carried_sections(_page_texts(spark, d)).withColumn("status", T.extraction_status(F.col("text"))))
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != ""))  # noqa: E731
    out = None
    for name in sorted(S.STRATEGIES):
        made = stored(S.chunked(texts, name))
        counts = made.agg(F.count_if(F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0))) > S.LIMIT).alias("over_limit"), F.count_if(F.trim("text") == "").alias("empty"), (F.count("*") - F.count_distinct("chunk_id")).alias("repeated_ids"))
        if name == "atomic":
            have = made.select("document_id", F.explode(words("text")).alias("w")).distinct()
            lost = S.spans(texts).select("document_id", F.explode(words("text")).alias("w")).distinct().join(have, ["document_id", "w"], "left_anti").agg(F.count("*").alias("words_lost"))
        else:
            have = made.select("document_id", F.explode(words("text")).alias("w")).distinct()
            kept = texts.filter("status NOT IN ('corrupted', 'low_text', 'image_only')").filter(F.length("text") >= S.ALONE_CHARS)
            lost = kept.select("document_id", F.explode(words("text")).alias("w")).distinct().join(have, ["document_id", "w"], "left_anti").agg(F.count("*").alias("words_lost"))
        row = counts.withColumn("k", F.lit(1)).join(lost.withColumn("k", F.lit(1)), "k").select(F.lit(name).alias("strategy"), "over_limit", "empty", "repeated_ids", "words_lost")
        out = row if out is None else out.unionAll(row)
    return out


_TOPIC = r"aneurysm|aort|vascular"


@query(rf"""WITH p AS (SELECT document_id, page_number, arg_max(raw_text, page_key || ingested_at) FILTER (raw_text IS NOT NULL) AS t FROM pages_df GROUP BY ALL),
k AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS place, regexp_matches(lower(coalesce(t, '')), '{_TOPIC}') AS hit, trim(coalesce(t, '')) <> '' AS filled,
  coalesce(sum(length(coalesce(t, '')) + 1) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT document_id, NOT bool_or(filled AND place <= 3) OR bool_or(hit AND (place <= 3 OR before <= 8000)) AS valid,
  CASE WHEN NOT bool_or(filled AND place <= 3) THEN 'no text on the first pages' WHEN NOT bool_or(hit AND (place <= 3 OR before <= 8000)) THEN 'topic not named' END AS reason FROM k GROUP BY document_id""")
def document_validity(spark: SparkSession, d: str) -> DataFrame:
    """Documents that name the topic on their first three pages or within their first 8,000 characters; those without
    text there stay, for they may be scanned."""
    rows = _page_texts(spark, d).select("document_id", "page_number", F.coalesce("text", F.lit("")).alias("t"))
    rows = O.blocked(rows.select("document_id", "page_number", F.lower("t").rlike(_TOPIC).alias("hit"), (F.trim("t") != "").alias("filled"), F.length("t").alias("chars")), "page_number")
    rows = O.summed(O.numbered(rows, "document_id", ["page_number"], "place"), ["document_id"], ["page_number"], F.col("chars") + 1, "before")
    first = F.col("place") <= 3
    per = rows.groupBy("document_id").agg(F.bool_or(F.col("filled") & first).alias("text"), F.bool_or(F.col("hit") & (first | (F.col("before") <= 8000))).alias("named"))
    return per.select("document_id", (~F.col("text") | F.col("named")).alias("valid"), F.when(~F.col("text"), "no text on the first pages").when(~F.col("named"), "topic not named").alias("reason"))
