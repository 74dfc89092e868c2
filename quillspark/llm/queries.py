"""Queries of the problems, by name: callables of a session and the folder of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import canonical, encoding, leaks, packing, pairs, repeated_lines, scans, splitting, tables
from quillspark.session import stored


def _typed_pages(spark: SparkSession, d: str) -> DataFrame:
    return tables.pages(spark, d).filter("extraction_library <> 'pytesseract'").select("page_key", "document_id", F.col("raw_text").alias("text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that come back on page after page of their document."""
    return repeated_lines.repeated_lines(_typed_pages(spark, d)).select("page_key", "line_no")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every page, once, without those lines."""
    return repeated_lines.clean_pages(_typed_pages(spark, d)).select("page_key", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records that look the same and are stored differently."""
    return canonical.look_alike_pairs(stored(canonical.same_looking(tables.records(spark, d))))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same as one row per record with its class, so that a class of any size is as many rows as it has records."""
    return canonical.classes(stored(canonical.same_looking(tables.records(spark, d))))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its text in the consistent form, once each."""
    rows = tables.records(spark, d).dropDuplicates(["table_name", "record_key"])
    return rows.select("table_name", "record_key", canonical.canonical_text(F.col("text")).alias("text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Unusable pairs of prompt and response, each with its defect."""
    return pairs.defects(spark.read.parquet(f"{d}/generation_results.parquet"), _documents(spark, d))


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = tables.pages(spark, d).filter("raw_text IS NOT NULL")
    scanned = rows.filter("extraction_library = 'pytesseract'").select("page_key", "document_id", "document_name", "page_number", F.col("raw_text").alias("text"))
    return scanned, rows.filter("extraction_library <> 'pytesseract'").select(F.col("raw_text").alias("text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Noisy lines of scanned pages."""
    return scans.noise(*_scanned(spark, d))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Scanned pages as continuous paragraphs."""
    return scans.repaired(*_scanned(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that contain wrongly decoded characters."""
    found = encoding.garbled_texts(tables.records(spark, d), ["table_name", "record_key"])
    return found.select("table_name", "record_key").distinct()


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    """The same records with their text restored where it can be."""
    found = encoding.garbled_texts(tables.records(spark, d), ["table_name", "record_key"])
    return found.dropDuplicates(["table_name", "record_key"])


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of its pieces where it exceeds the capacity."""
    sized = _documents(spark, d).select("doc_id", packing.token_count(F.col("text")).alias("n_tokens"))
    return packing.pack(stored(sized), "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: one row per group."""
    filled = p6_containers(spark, d).groupBy("group_no", "container_no").agg(F.sum("piece_tokens").alias("n"))
    return filled.groupBy("group_no").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), (F.sum("n") / (F.count("*") * packing.CAPACITY)).alias("fill"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the held-out items that leaked into them."""
    return leaks.leaks(_documents(spark, d), spark.read.parquet(f"{d}/heldout_items.parquet"))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every document beyond the limit."""
    return splitting.split_oversized(_documents(spark, d), "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_classes, p2_canonical, p3_found, p4_found, p4_repaired, p5_found, p5_restored, p6_containers, p6_fill, p7_found, p8_pieces)}
_LINES = """
WITH pages AS (
  SELECT page_key, any_value(document_id) AS document_id, any_value(raw_text) AS t FROM pages_df
  WHERE extraction_library <> 'pytesseract' AND trim(raw_text) <> '' GROUP BY page_key),
lines AS (
  SELECT page_key, document_id, unnest(string_split(t, chr(10))) AS raw,
    generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM pages),
folded AS (
  SELECT page_key, document_id, line_no, raw, regexp_replace(trim(regexp_replace(lower(raw),
    '[\\s\\x{0b}\\x{85}\\p{Z}]+', ' ', 'g')), '\\p{Nd}+', '0', 'g') AS line FROM lines),
many AS (
  SELECT document_id, line FROM folded JOIN (SELECT document_id, count(*) AS n FROM pages GROUP BY 1) USING (document_id)
  WHERE regexp_matches(line, '\\p{L}') GROUP BY document_id, line, n
  HAVING count(DISTINCT page_key) >= 5 AND count(DISTINCT page_key) * 5 >= n)
"""

SQL: dict[str, str] = {
    "p1_found": _LINES + "SELECT page_key, line_no::BIGINT AS line_no FROM folded JOIN many USING (document_id, line)",
    "p1_clean": _LINES + """, typed AS (SELECT page_key, any_value(raw_text) AS t FROM pages_df WHERE extraction_library <> 'pytesseract' GROUP BY page_key),
kept AS (SELECT page_key, string_agg(raw, chr(10) ORDER BY line_no) FILTER (m.line IS NULL) AS t FROM folded f LEFT JOIN many m USING (document_id, line) GROUP BY page_key)
SELECT page_key, CASE WHEN k.page_key IS NULL THEN typed.t ELSE coalesce(k.t, '') END AS text FROM typed LEFT JOIN kept k USING (page_key)""",
}
