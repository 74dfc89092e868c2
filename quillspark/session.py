"""Session settings and the two ways the library cuts lineage or bounds a broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Rows and bytes up to which a relation may be broadcast. Beyond either the same join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000


#: Whether texts that lie in fewer parts than cores (one small file) are spread over the cores before they are worked on.
#: Only a session for a single node sets it; on a cluster parts are as large as ``spark.sql.files.maxPartitionBytes`` says.
SPREAD = "spark.quillspark.spreadSmallTexts"


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and single-node runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config(SPREAD, "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one, on a local master only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


#: Paths of the tables that this process has stored and not yet cleared.
_WRITTEN: list[str] = []


def _path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as Hadoop objects."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so later steps neither repeat
    its work nor depend on any one executor. The table goes with ``clear_stored`` or the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, fs = _path(spark, path)
    fs.deleteOnExit(at)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> int:
    """Delete the stored tables, once nothing that reads them is to run any more; how many they were."""
    n = len(_WRITTEN)
    while _WRITTEN:
        at, fs = _path(spark, _WRITTEN.pop())
        fs.delete(at, True)
    return n


def _bytes(name: str, kind: DataType) -> Column:
    """About how many bytes a column's value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 16
    return F.lit(8)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` (already stored, so counting is cheap) has few rows and few bytes."""
    each = sum((_bytes(f.name, f.dataType) for f in df.schema), F.lit(0))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(each.cast("long")), F.lit(0))).first()
    return n <= rows and total <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where ``is_small`` says so."""
    return F.broadcast(df) if is_small(df, rows, size) else df
