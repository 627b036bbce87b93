"""Snapshot scans: keyset pages, lookup-filtered scans, row re-reads, estimates (OP-SRC-9..13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered


def keyset_page(table: DataFrame, key: list[str], cursor: tuple | None, limit: int | None) -> DataFrame:
    """The next `limit` rows behind the cursor in key order: a tuple comparison, never an offset.
    A page of exactly `limit` rows may have more behind it; no limit gives all, in no order."""
    df = table
    if cursor is not None:
        df = df.where(F.struct(*key) > F.struct(*[F.lit(v).cast(table.schema[k].dataType).alias(k) for k, v in zip(key, cursor, strict=True)]))
    return df if limit is None else df.orderBy(*key).limit(limit)


#: Keys that are sampled to find ranges, for each range, and ranges at most: a table that isn't laid out by
#: its key is scanned once for each.
SAMPLED, RANGES = 128, 64


def key_ranges(table: DataFrame, key: list[str], size: int, most: int = RANGES) -> list[list[str]]:
    """Upper bounds (as text) that cut a table's key into ranges of about `size` rows, or of an equal share
    where that would make more than `most`; the last range has no bound.  They are found once, from the
    number of rows and a sample of keys, whose size is bounded; of a small table all keys are taken."""
    keys = table.select(*key)
    n = keys.count()
    want = min(most, -(-n // size))
    if want < 2:
        return []
    enough = SAMPLED * most
    some = keys if n <= enough else keys.sample(min(1.0, 1.5 * enough / n), seed=7)
    rows = some.orderBy(*key).limit(2 * enough).select(*[F.col(k).cast("string") for k in key]).collect()
    step = size if n <= enough and n <= size * most else len(rows) / want
    cuts = [list(rows[min(len(rows), round(step * k)) - 1]) for k in range(1, want) if round(step * k) <= len(rows)]
    return [c for k, c in enumerate(cuts) if not k or c != cuts[k - 1]]


def key_range(table: DataFrame, key: list[str], after: list | None, upto: list | None) -> DataFrame:
    """The rows behind `after` up to `upto` in key order, either may be open.  The first key column is
    compared by itself too, which files and row groups are pruned by."""

    def bound(values: list) -> list:
        return [F.lit(v).cast(table.schema[k].dataType).alias(k) for k, v in zip(key, values, strict=True)]

    df = table
    if after is not None:
        df = df.where((F.col(key[0]) >= bound(after)[0]) & (F.struct(*key) > F.struct(*bound(after))))
    if upto is not None:
        df = df.where((F.col(key[0]) <= bound(upto)[0]) & (F.struct(*key) <= F.struct(*bound(upto))))
    return df


def keyset_chunks(table: DataFrame, key: list[str], size: int) -> DataFrame:
    """Every row with the number of its page."""
    return numbered(table, key, "_number").withColumn("chunk", F.expr(f"_number div {size}")).drop("_number")


def lookup_scan(table: DataFrame, lookups: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows of `table` with a lookup tuple; nulls match nothing.  Spark broadcasts the tuples if
    they are few and deals both sides otherwise."""
    keys = lookups.select(*[F.col(b).alias(f"_{a}") for a, b in pairs]).dropna().distinct()
    cond = [F.col(a) == F.col(f"_{a}") for a, _ in pairs]
    return table.join(keys, cond, "left_semi")


def reselect(changes: DataFrame, current: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Insert and update rows with unavailable columns take the current row's values; where the
    row is gone the change is dropped."""
    now = current.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(c).alias(f"_now_{c}") for c in columns], F.lit(True).alias("_found"))
    joined = changes.join(now, [F.col(k) == F.col(f"_{k}") for k in key], "left")
    broken = (F.size("unavailable_cols") > 0) & F.col("action").isin("insert", "update")
    healed = {c: F.when(broken & F.array_contains("unavailable_cols", c), F.col(f"_now_{c}")).otherwise(F.col(c)) for c in columns}
    kept = joined.where(~broken | F.col("_found").isNotNull()).withColumn("healed", broken)
    return kept.withColumns(healed).drop(*[f"_{k}" for k in key], *[f"_now_{c}" for c in columns], "_found")


def row_estimate(table: DataFrame) -> DataFrame:
    """Row counts come from the Parquet footers (a count without columns reads nothing else)."""
    return table.agg(F.count(F.lit(1)).alias("estimated_rows"))
