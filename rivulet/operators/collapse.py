"""Last-wins collapse and its relatives (OP-AGG-1..7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITION = ("commit_lsn", "commit_idx")


def last_wins(changes: DataFrame, key: list[str], order: tuple[str, ...] = POSITION) -> DataFrame:
    """The last change of each key.  row_number() = 1 lets Spark keep one row a key in each map
    task before the shuffle, so a hot key costs a row per task."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return changes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def ordered_groups(changes: DataFrame, key: list[str], item: Column, position: str) -> DataFrame:
    """Groups numbered by first occurrence, items in source order.  A group's items make one
    array, so this is for groups that are bounded by a batch."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), item.alias("v")))), lambda x: x["v"])
    return changes.groupBy(*key).agg(F.min(position).alias("first_position"), items.alias("items"))


def ordered_items(changes: DataFrame, key: list[str], item: Column, position: str) -> DataFrame:
    """The same a row per item, for groups of any size: the key, first_position, position and item.
    Sorting by first_position, then position, gives the groups in order of first occurrence."""
    first = changes.groupBy(*key).agg(F.min(position).alias("first_position"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    on = same[0]
    for x in same[1:]:
        on = on & x
    items = changes.select(*key, F.col(position).alias("position"), item.alias("item"))
    return items.alias("c").join(first.alias("f"), on).select(*[F.col(f"c.{k}").alias(k) for k in key], "first_position", "position", "item")


def latest_view(records: DataFrame) -> DataFrame:
    """A destination's present documents: the last record of each id, less deletions."""
    return last_wins(records, ["destination", "document_id"]).where("not is_deletion")


def version_composite(versions: Column) -> Column:
    """Distinct versions, sorted, joined by +; none is null."""
    found = F.array_sort(F.collect_set(versions))
    return F.when(F.size(found) > 0, F.array_join(found, "+"))
