"""Transactions without an end, kept until it comes (OP-SRC-2..4).

Each batch appends its records of open transactions once, as a segment of its own; a manifest for each
batch says how many records of which transaction each segment has.  When a transaction commits, its
records are read from its segments alone and counted against the manifest; of one that aborts nothing is
read.  So a transaction that stays open for k batches is written once, not k times.

A batch that comes again starts from the manifest of the batch before it.  Segments that neither the
batch's own manifest nor the one before names are deleted."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Files, discard, materialise


class LostSegment(RuntimeError):
    """What was kept of a transaction isn't all there; delivering the rest would lose changes."""


class TransactionSpill:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path, Files(spark)

    def _number(self, name: str) -> int:
        return int(name.removesuffix(".json"))

    def manifest(self, batch_id: int) -> dict[int, dict[int, int]]:
        """By open transaction: the number of its records in each segment, after a batch (or the last one before)."""
        numbers = sorted(n for n in map(self._number, (x for x in self.files.names(f"{self.path}/manifests") if x.endswith(".json"))) if n <= batch_id)
        if not numbers:
            return {}
        found = json.loads(self.files.read(f"{self.path}/manifests/{numbers[-1]}.json"))
        return {int(x): {int(s): n for s, n in segments.items()} for x, segments in found.items()}

    def whole(self, raw: DataFrame, batch_id: int, written: list[DataFrame]) -> DataFrame:
        """All records of the transactions that end in the batch `raw` (a written frame), what earlier batches kept of
        them included; records of the others are kept.  Frames in `written` are the caller's to delete."""
        before = self.manifest(batch_id - 1)
        ends = raw.where("kind in ('commit', 'abort')").select("xid", (F.col("kind") == "commit").alias("committed")).distinct()
        # the manifest names every open transaction, so those of the batch are few: all others' rows stay where they are
        states = raw.groupBy("xid").agg(F.bool_or(F.col("kind").isin("commit", "abort")).alias("ended"))
        opened = [(r["xid"],) for r in states.where("xid is null or not ended").select("xid").collect()]
        if (None,) in opened:
            raise ValueError("protocol records without a transaction")
        waiting = F.broadcast(self.spark.createDataFrame(opened, "xid long"))
        now = raw.join(waiting, "xid", "left_anti").select(raw.columns)
        after = dict(before)
        closing: dict[int, bool] = {}
        if before:
            known = self.spark.createDataFrame([(x,) for x in before], "xid long")
            closing = {r["xid"]: r["committed"] for r in ends.join(F.broadcast(known), "xid").collect()}  # a row for each open transaction at most
            for x in closing:
                del after[x]
        if wanted := {x: before[x] for x, committed in closing.items() if committed}:
            written.append(self._read(raw, wanted))
            now = now.unionByName(written[-1])
        for x, n in self._append(raw.join(waiting, "xid", "left_semi").select(raw.columns), batch_id).items():
            after[x] = after.get(x, {}) | {batch_id: n}
        self.files.write(f"{self.path}/manifests/{batch_id}.json", json.dumps(after))
        self._clean(batch_id, before, after)
        return now

    def _append(self, rows: DataFrame, batch_id: int) -> dict[int, int]:
        """Write the batch's segment, sorted so that a transaction's records lie together; the numbers of its records."""
        target = f"{self.path}/segments/{batch_id}"
        rows.repartitionByRange("xid", "seq").sortWithinPartitions("xid", "seq").write.mode("overwrite").parquet(target)
        counts = self.spark.read.schema(rows.schema).parquet(target).groupBy("xid").count().collect()
        if not counts:
            self.files.delete(target)
        return {r["xid"]: r["count"] for r in counts}

    def _read(self, raw: DataFrame, wanted: dict[int, dict[int, int]]) -> DataFrame:
        segments = sorted({s for x in wanted.values() for s in x})
        lost = [s for s in segments if not self.files.exists(f"{self.path}/segments/{s}/_SUCCESS")]
        if lost:
            raise LostSegment(f"segments {lost} of open transactions are gone")
        names = self.spark.createDataFrame([(x,) for x in wanted], "xid long")
        rows = self.spark.read.schema(raw.schema).parquet(*[f"{self.path}/segments/{s}" for s in segments])
        lowest, highest = min(wanted), max(wanted)  # row groups of other transactions are skipped
        rows = materialise(rows.where(F.col("xid").between(lowest, highest)).join(F.broadcast(names), "xid", "left_semi").select(raw.columns), "spilled")
        counts = {r["xid"]: r["count"] for r in rows.groupBy("xid").count().collect()}
        for x, parts in wanted.items():
            if counts.get(x, 0) != sum(parts.values()):
                discard(rows)
                raise LostSegment(f"transaction {x}: {counts.get(x, 0)} of {sum(parts.values())} records are there")
        return rows

    def _clean(self, batch_id: int, *manifests: dict[int, dict[int, int]]) -> None:
        named = {s for m in manifests for x in m.values() for s in x}
        for s in map(int, self.files.names(f"{self.path}/segments")):
            if s not in named and s < batch_id:
                self.files.delete(f"{self.path}/segments/{s}")
        for n in self.files.names(f"{self.path}/manifests"):
            if n.endswith(".json") and self._number(n) < batch_id - 1:
                self.files.delete(f"{self.path}/manifests/{n}")
