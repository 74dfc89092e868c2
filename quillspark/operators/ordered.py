"""Order-dependent columns over groups of any size.

A window over a whole group would put a group, however large, into one task. Here a group is cut into blocks
of an ordering number (pages); windows run inside blocks, and between blocks only one summary row per block is
carried. Results equal those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGES_PER_BLOCK = 64


def blocked(df: DataFrame, number: str, size: int = PAGES_PER_BLOCK) -> DataFrame:
    """``df`` with its ``block``; ``number`` must be the first thing the rows are ordered by."""
    return df.withColumn("block", F.floor(F.col(number) / size))


def numbered(df: DataFrame, group: str, order: list[str], name: str = "seq") -> DataFrame:
    """Row numbers from 1 within ``group``."""
    before = df.groupBy(group, "block").agg(F.count("*").alias("rows_in"))
    w = W.partitionBy(group).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offset = before.select(group, "block", F.coalesce(F.sum("rows_in").over(w), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy(group, "block").orderBy(*order))
    return df.withColumn(name, inside).join(offset, [group, "block"]).withColumn(name, (F.col(name) + F.col("offset")).cast("long")).drop("offset")


def summed(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` over the rows before each row of its ``group``."""
    df = df.withColumn("own_value", value.cast("long"))
    w = W.partitionBy(*group).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = df.groupBy(*group, "block").agg(F.sum("own_value").alias("sum_in")).select(*group, "block", F.coalesce(F.sum("sum_in").over(w), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("own_value").over(W.partitionBy(*group, "block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn(name, inside).join(before, [*group, "block"]).withColumn(name, F.col(name) + F.col("offset")).drop("own_value", "offset")


def carried(df: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that is not null, up to and with each row."""
    df = df.withColumn("own_value", value)
    last = df.filter("own_value IS NOT NULL").groupBy(group, "block").agg(F.max_by("own_value", F.struct(*order)).alias("last_value"))
    blocks = df.select(group, "block").distinct().join(last, [group, "block"], "left")
    w = W.partitionBy(group).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    earlier = blocks.select(group, "block", F.last("last_value", ignorenulls=True).over(w).alias("earlier"))
    inside = F.last("own_value", ignorenulls=True).over(W.partitionBy(group, "block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(name, inside).join(earlier, [group, "block"]).withColumn(name, F.coalesce(name, "earlier")).drop("own_value", "earlier")


def beside(df: DataFrame, group: str, order: list[str], value: Column, name: str, back: bool) -> DataFrame:
    """The value of the row before (``back``) or after each row; null at the ends."""
    df = df.withColumn("own_value", F.struct(value.alias("v")))
    pick = F.max_by if back else F.min_by
    edge = df.groupBy(group, "block").agg(pick("own_value", F.struct(*order)).alias("edge"))
    w = W.partitionBy(group).orderBy("block")
    other = edge.select(group, "block", (F.lag("edge") if back else F.lead("edge")).over(w).alias("other"))
    inside = (F.lag("own_value") if back else F.lead("own_value")).over(W.partitionBy(group, "block").orderBy(*order))
    return df.withColumn(name, inside).join(other, [group, "block"]).withColumn(name, F.coalesce(name, "other")["v"]).drop("own_value", "other")


def percentiles(df: DataFrame, group: str, value: str, wanted: dict[str, float], blocks: int = 1024) -> DataFrame:
    """Exact percentiles (linear between neighbours) of ``value`` per ``group``: group and a column per name in
    ``wanted``. Equal values are counted first and lie in blocks of their range, so that no group is one task."""
    per = df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ends = per.groupBy(group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    rows = per.join(ends, per[group].eqNullSafe(ends[group])).drop(ends[group]).withColumn("block", F.least(F.floor(share * blocks), F.lit(blocks - 1)))
    rows = summed(rows, [group], ["v"], F.col("n"), "before")
    at = lambda place: F.min(F.when(F.col("before") + F.col("n") > place, F.col("v")))
    aggs = []
    for name, p in wanted.items():
        place = (F.col("total") - 1) * p
        low, high = at(F.floor(place)), at(F.ceil(place))
        over, under = F.max(place - F.floor(place)), F.max(F.ceil(place) - place)
        aggs.append(F.when(low == high, low).otherwise(low * under + high * over).alias(name))
    return rows.groupBy(group).agg(*aggs)
