"""Dependent fan-out: changes of one table re-emit rows of another (OP-JOIN-1..10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import lookup_hash
from ..model import Binding
from .collapse import POSITION


def lookup_keys(changes: DataFrame, binding: Binding) -> DataFrame:
    """Distinct lookup tuples of the changes: an update that re-points gives the old and the new
    one, a delete the old one; tuples with a null match nothing."""
    image = lambda side: F.struct(*[F.col(side).getField(d).alias(p) for d, p in binding.pairs])
    none = F.lit(None).cast(changes.select(image("new").alias("x")).schema["x"].dataType)
    new = F.when((F.col("action") != "delete") & F.col("new").isNotNull(), image("new")).otherwise(none)
    old = F.when(F.col("action").isin("update", "delete") & F.col("old").isNotNull(), image("old")).otherwise(none)
    tuples = changes.select(F.explode(F.array(new, old)).alias("k")).where("k is not null").select("k.*")
    return tuples.dropna().distinct()


def matching_rows(primary: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the primary table that a lookup tuple names, each once.  Spark broadcasts few
    tuples by their size and deals both sides otherwise."""
    return primary.join(keys, keys.columns, "left_semi")


def stamped(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows as updates at the position of the last contributing change (one row, broadcast)."""
    last = changes.agg(F.max(F.struct(*POSITION)).alias("p"))
    rows = rows.withColumn("action", F.lit("update"))
    return rows.crossJoin(F.broadcast(last)).select(*rows.columns, *[F.col("p").getField(c).alias(c) for c in POSITION])


def synthetic_updates(primary: DataFrame, keys: DataFrame, changes: DataFrame) -> DataFrame:
    """Updates without an old image of the rows that the lookups name."""
    return stamped(matching_rows(primary, keys), changes)


def live_wins(synthetic: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Without those whose row changed itself in the batch."""
    return synthetic.join(live.select(*key).distinct(), key, "left_anti")


def first_page(rows: DataFrame, key: list[str], size: int) -> tuple[DataFrame, DataFrame]:
    """The rows sent at once, in key order, and whether the scope must be queued as well."""
    page = rows.orderBy(*key).limit(size)
    return page, rows.agg((F.count(F.lit(1)) > size).alias("queued"))


def chunk_jobs(positions: DataFrame, table: str, columns: list[str], size: int) -> DataFrame:
    """Queue rows for distinct tuples (columns, first position) in chunks of `size` by first
    occurrence, with the hash that lets equal sets be one job.

    Ranks are by ranges of the position: sorted in parallel, offset by the earlier counts."""
    from ..sources.snapshot import keyset_chunks

    numbered = keyset_chunks(positions, ["first_position", *columns], size)
    item = F.to_json(F.array(*columns))
    jobs = numbered.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_keys"), F.collect_list(item).alias("tuples"))
    return jobs.select("chunk", "n_keys", lookup_hash(table, columns, F.col("tuples")).alias("lookup_hash"))


def write_chunks(keys: DataFrame, table: str, size: int, path: str) -> list[tuple[int, str]]:
    """Write distinct lookup tuples in chunks of `size` in their order, a folder chunk=N each, and
    give each chunk's number and hash, which depend on the tuples alone."""
    from ..sources.snapshot import keyset_chunks

    columns = keys.columns
    keyset_chunks(keys, columns, size).write.partitionBy("chunk").parquet(path)
    rows = keys.sparkSession.read.parquet(path)
    jobs = rows.groupBy("chunk").agg(F.collect_list(F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))).alias("tuples"))
    return [(r["chunk"], r["h"]) for r in jobs.select("chunk", lookup_hash(table, columns, F.col("tuples")).alias("h")).orderBy("chunk").collect()]


def decide(keys: DataFrame, most: int) -> DataFrame:
    """More keys than `most` ask for the whole table instead of a scope."""
    n = keys.agg(F.count(F.lit(1)).alias("n_keys"))
    return n.withColumn("decision", F.when(F.col("n_keys") > most, "backfill_table").otherwise("scope"))


def distinct_in_order(changes: DataFrame, columns: list[str]) -> DataFrame:
    return changes.groupBy(*columns).agg(F.min("seq").alias("first_position"))


def ranked(rows: DataFrame, key: list[str], per: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*key)))
