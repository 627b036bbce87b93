"""Numbers and running sums in a global order, without one task that sorts everything.

Rows are dealt by ranges of the order and sorted inside each; a range's offset is the sum over
the earlier ones, of which there is one row each.  The dealt rows are written once, so that
rows and offsets can't come from two different deals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


def _dealt(df: DataFrame, order: list[str]) -> DataFrame:
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialise(d.withColumn("_part", F.spark_partition_id()).withColumn("_i", inside), "ordered")


def _offsets(totals: DataFrame) -> DataFrame:
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Adds each row's number from 0 in the order of the columns."""
    d = _dealt(df, order)
    offsets = _offsets(d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")))
    return d.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_i")).drop("_part", "_i", "_before")


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows up to and with each."""
    d = _dealt(df.withColumn("_v", value), order)
    offsets = _offsets(d.groupBy("_part").agg(F.sum("_v").alias("_n")))
    own = F.sum("_v").over(Window.partitionBy("_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_i", "_before", "_own", "_v")
