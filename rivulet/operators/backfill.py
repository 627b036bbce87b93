"""Backfill: windows, decisions, state (OP-BF-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minus_live(chunks: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Chunk rows (low_pos, high_pos) whose key had no live change strictly inside the window.

    First the windows with a live change are found, by a join on the key with the positions as a
    condition: an inner join, whose hot keys Spark can split, and whose hits are reduced to one
    row a key and window where they arise.  Those leave the chunks."""
    window = ["low_pos", "high_pos"]
    seen = live.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("pos").alias("_pos"))
    cond = [chunks[k] == seen[f"_{k}"] for k in key]
    inside = (F.col("_pos") > F.col("low_pos")) & (F.col("_pos") < F.col("high_pos"))
    hit = chunks.join(seen, [*cond, inside]).select(*key, *window).distinct()
    return chunks.join(hit, [*key, *window], "left_anti").select(chunks.columns)


def decision(status: Column, version: Column, declared: Column, automatic: Column, purge_marked: Column, purge_on_version: Column) -> Column:
    """What the scheduler does with a table: fresh, fresh_purge, resume or skip."""
    fresh = lambda purge: F.when(F.coalesce(purge, F.lit(False)), "fresh_purge").otherwise("fresh")
    return (
        F.when(status.isNull(), F.when(automatic, "fresh").otherwise("skip"))
        .when(status == "requested", fresh(purge_marked))
        .when(status == "in_progress", "resume")
        .when((status == "completed") & automatic & ~version.eqNullSafe(declared), fresh(purge_marked | purge_on_version))
        .otherwise("skip")
    )


def requested(state: DataFrame, requests: DataFrame) -> DataFrame:
    """State rows after requests (table, purge): the purge mark is sticky, cursor and attempts
    start anew; tables without a request stay as they are."""
    r = requests.groupBy("table").agg(F.max("purge").alias("_purge"))
    j = state.join(r, "table", "full_outer")
    asked = F.col("_purge").isNotNull()
    return j.select(
        "table", F.when(asked, "requested").otherwise(F.col("status")).alias("status"), "version",
        F.when(asked, F.coalesce("purge", F.lit(False)) | F.col("_purge")).otherwise(F.col("purge")).alias("purge"),
        F.when(~asked, F.col("cursor")).alias("cursor"), F.when(asked, 0).otherwise(F.col("attempts")).alias("attempts"),
    )


def cancelled(state: DataFrame, tables: list[str]) -> DataFrame:
    """Only what is still requested can be cancelled."""
    hit = F.col("table").isin(tables) & (F.col("status") == "requested")
    return state.withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status")))


def due(queue: DataFrame, now: Column) -> DataFrame:
    return queue.where(F.col("status").isin("requested", "in_progress") & (F.col("next_attempt_at") <= now)).orderBy("next_attempt_at", "requested_at")


def purge_targets(tables: DataFrame) -> DataFrame:
    """Distinct (sink, destination) to empty before a fresh run; scoped destinations and sinks
    without purge are skipped."""
    return tables.where("supports_purge and destination is not null").select("sink", "destination").distinct()
