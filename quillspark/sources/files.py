"""Files as rows: discovery with content digests, deduplication, and manifests of expected artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def discovered(spark: SparkSession, root: str, glob: str = "*", excluded: tuple[str, ...] = (), preferred: tuple[str, ...] = ()) -> DataFrame:
    """Files below ``root``: path, bytes, md5, sha256, place. Folders named in ``excluded`` are skipped; ``place`` is that of
    the first ``preferred`` folder that holds the file (their number for none), by which copies are chosen."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    for name in excluded:
        rows = rows.filter(~F.col("path").contains(f"/{name}/"))
    place = F.lit(len(preferred))
    for i, name in reversed(list(enumerate(preferred))):
        place = F.when(F.col("path").contains(f"/{name}/"), i).otherwise(place)
    return rows.select("path", F.col("length").alias("bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), place.alias("place"))


def without_copies(files: DataFrame) -> DataFrame:
    """``files`` with ``kept``: the first path of each content; the others name it as their reason."""
    w = W.partitionBy("md5").orderBy(*[c for c in ("place",) if c in files.columns], "path")
    first = F.first("path").over(w)
    return files.withColumn("kept", F.col("path") == first).withColumn("reason", F.when(F.col("path") != first, F.concat(F.lit("same content as "), first)))


def manifest(files: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected`` (name, sha256) against ``files``: ok, changed or MISSING."""
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("found"), "bytes")
    status = F.when(F.col("found").isNull(), "MISSING").when(F.col("found") == F.col("sha256"), "ok").otherwise("changed")
    return expected.join(there, "name", "left").select("name", "bytes", status.alias("status"))


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in or in place of those of the same key."""
    return old.join(new, key, "left_anti").unionByName(new)


def written(spark: SparkSession, root: str, expected: list[str]) -> DataFrame:
    """Tables below ``root`` against those ``expected``: name, files, bytes, status (ok, empty, missing, unexpected)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(~F.col("path").rlike(r"/[._][^/]*$"))
    base = root.rstrip("/").split("/")[-1]
    there = rows.select(F.regexp_extract("path", rf"/{base}/([^/]+)", 1).alias("name"), F.col("length").alias("n")).groupBy("name").agg(F.count("*").alias("files"), F.sum("n").alias("bytes"))
    wanted = spark.createDataFrame([(x, True) for x in expected], "name string, wanted boolean")
    both = wanted.join(there, "name", "full_outer").fillna(0, ["files", "bytes"])
    status = F.when(F.col("wanted").isNull(), "unexpected").when(F.col("files") == 0, "missing").when(F.col("bytes") == 0, "empty").otherwise("ok")
    return both.select("name", "files", "bytes", status.alias("status"))


def write_chunks(chunks: DataFrame, path: str, recreate: bool = False) -> None:
    """A chunk store: the chunks, and beside them one row on their quality (number, distinct ids, blank, most tokens)."""
    mode = "overwrite" if recreate else "errorifexists"
    chunks.write.mode(mode).parquet(f"{path}/chunks")
    again = chunks.sparkSession.read.parquet(f"{path}/chunks")
    text = F.coalesce("chunk_text", F.lit(""))
    quality = again.agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"), F.count_if(F.trim(text) == "").alias("blank"), F.max(F.length(text)).alias("most_chars"))
    quality.coalesce(1).write.mode(mode).json(f"{path}/quality")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a store; an error if an id repeats or their number isn't the stored one."""
    chunks = spark.read.parquet(f"{path}/chunks")
    stamp = spark.read.json(f"{path}/quality").first()
    if stamp["n"] != stamp["ids"] or chunks.count() != stamp["n"]:
        raise ValueError(f"the chunk store {path} doesn't hold the {stamp['n']} chunks of its stamp, once each")
    return chunks


def upserted(spark: SparkSession, path: str, new: DataFrame, key: str) -> DataFrame:
    """The table at ``path`` with the rows of ``new`` put in or in place of those with their key, written beside it and
    checked (every key once) before it is returned; the old table stays."""
    old = spark.read.parquet(path)
    out = f"{path.rstrip('/')}-next"
    merged(old, new, key).write.mode("errorifexists").parquet(out)
    table = spark.read.parquet(out)
    n, ids = table.agg(F.count("*"), F.count_distinct(key)).first()
    if n != ids:
        raise ValueError(f"{n - ids} rows repeat a {key}")
    return table


def frozen_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON artefacts as they are on file: path, sha256 of the bytes, and their text."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("json"))
