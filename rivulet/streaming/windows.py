"""Backfill windows bounded by tokens of the log (OP-SRC-8, OP-BF-1, OP-BF-2).

A reader writes a low token to the log, reads a chunk of rows, keeps it here, and writes a high token.
When the log's own stream passes the high token, the chunk is due: less the keys that a change between
the two tokens had.  Several windows of one table, and of several tables, may be open at once.

State is kept for each batch in a manifest (open windows and the segments of keys seen meanwhile) and
in segments of keys, each written once; a batch that comes again starts from the manifest before it, so
a restart loses no window and closes none twice.  Keys are kept only while some window is open."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.backfill import minus_live
from ..storage import Files, materialise

#: Behind all positions.
MOST = (1 << 63) - 1


class TokenWindows:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path, Files(spark)

    # ---- the reader's side

    def keep(self, token: str, table: str, rows: DataFrame) -> None:
        """A chunk of a table's rows (with doc_key), read after the low token was written and before the high
        one is; it is there whole, or not at all, before the high token may be written."""
        rows.write.mode("overwrite").parquet(f"{self.path}/chunks/{token}")
        self.files.write(f"{self.path}/tokens/{token}.json", json.dumps({"table": table}))

    # ---- the stream's side

    def manifest(self, batch_id: int) -> dict:
        """Open windows by token, and segments of keys by batch, after a batch or the last one before it."""
        numbers = sorted(n for n in (int(x.removesuffix(".json")) for x in self.files.names(f"{self.path}/manifests") if x.endswith(".json")) if n <= batch_id)
        return json.loads(self.files.read(f"{self.path}/manifests/{numbers[-1]}.json")) if numbers else {"open": {}, "segments": []}

    def passed(self, markers: DataFrame, keys: DataFrame, batch_id: int, behind: bool = False) -> dict[str, tuple[str, DataFrame]]:
        """What is due after a batch: by token, the table and the chunk's rows that no change in the window had.
        With `behind` they are delivered behind the whole batch, so its changes after the high token count too.

        `markers` are the batch's (kind, seq, token), `keys` its changes' (table, doc_key, pos), positions of
        the same order.  A high token without its low one or without a chunk closes nothing; a window
        whose token comes low again begins there."""
        before = self.manifest(batch_id - 1)
        found = markers.where("kind in ('watermark_low', 'watermark_high') and token is not null").select("kind", "seq", "token").collect()  # two for each chunk
        open_, closing = dict(before["open"]), {}
        for r in sorted(found, key=lambda r: r["seq"]):
            if r["kind"] == "watermark_low":
                open_[r["token"]] = r["seq"]
            elif r["token"] in open_:
                closing[r["token"]] = (open_.pop(r["token"]), r["seq"])
        segments = list(before["segments"])
        seen = None
        if open_ or closing:
            low = min([*open_.values(), *(a for a, _ in closing.values())])
            target = f"{self.path}/keys/{batch_id}"
            own = keys.where(F.col("pos") > low).groupBy("table", "doc_key", "pos").agg(F.lit(1).alias("one")).drop("one")
            own.write.mode("overwrite").parquet(target)
            segments.append(batch_id)
            seen = self.spark.read.schema(own.schema).parquet(*[f"{self.path}/keys/{s}" for s in segments])
        due = {}
        for token, (low, high) in closing.items():
            told = self.files.read(f"{self.path}/tokens/{token}.json")
            if told is None:
                continue
            table = json.loads(told)["table"]
            rows = self.spark.read.parquet(f"{self.path}/chunks/{token}")
            end = MOST if behind else high
            live = seen.where((F.col("table") == table) & (F.col("pos") > low) & (F.col("pos") < end)).select("doc_key", "pos")
            bounded = rows.withColumns({"low_pos": F.lit(low).cast("long"), "high_pos": F.lit(end).cast("long")})
            due[token] = (table, materialise(minus_live(bounded, live, ["doc_key"]).drop("low_pos", "high_pos"), "window"))
        after = {"open": open_, "segments": segments if open_ else []}
        self.files.write(f"{self.path}/manifests/{batch_id}.json", json.dumps(after))
        self._clean(batch_id, before, after)
        return due

    def done(self, token: str) -> None:
        """What a token kept isn't needed once its rows are delivered and the batch can't come again."""
        self.files.delete(f"{self.path}/chunks/{token}")
        self.files.delete(f"{self.path}/tokens/{token}.json")

    def _clean(self, batch_id: int, *manifests: dict) -> None:
        named = {s for m in manifests for s in m["segments"]} | {batch_id}
        for s in map(int, self.files.names(f"{self.path}/keys")):
            if s not in named and s < batch_id:
                self.files.delete(f"{self.path}/keys/{s}")
        for n in self.files.names(f"{self.path}/manifests"):
            if n.endswith(".json") and int(n.removesuffix(".json")) < batch_id - 1:
                self.files.delete(f"{self.path}/manifests/{n}")
