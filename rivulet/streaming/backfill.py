"""Running backfills: whole tables and queued scopes (OP-BF-1..9, OP-JOIN-9..10).

A run cuts the table's key into ranges once, from a sample, and keeps them with its cursor.  A step
reads one range and writes it once; then, while the engine delivers nothing else, it is cleared of
keys that changed live since before it was read, routed and delivered as one batch.  So live always
wins: a change that came before is left out of the range, one that comes after overwrites it.
Only then is the cursor saved, so a lost driver repeats one range at most and sinks, which
upsert by id, converge.  Each run numbers its batches on its own (see sinks.dispatch.Batch).  Queued
scopes keep their cursor in their row of the queue and go on behind it as well.

A range has backfill_chunk * chunks_per_step rows, or a 64th of the table if that is more, so a table
that isn't laid out by its key isn't scanned too often.  With chunks_per_step=None the rest of the
table is one step; live batches wait for its delivery."""

from __future__ import annotations

import time
import uuid
from itertools import count
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical_id, rendered
from ..model import TableSpec
from ..operators.backfill import minus_live
from ..operators.route import route
from ..plans.control import StateStore, decode_ranges, encode_ranges
from ..sinks.dispatch import Batch, dispatch
from ..sources.snapshot import key_range, key_ranges, lookup_scan
from ..storage import Files, discard, materialise
from .driver import Engine


def backoff(attempts: int) -> float:
    return min(5.0 * 2 ** min(attempts, 16), 300.0)


@dataclass
class Backfiller:
    engine: Engine
    state: StateStore
    #: Present rows of each table.
    tables: dict[str, Callable[[], DataFrame]]
    #: Live changes (key columns, pos) between two positions, or None, and the present position;
    #: by default what the engine itself has delivered.
    live: Callable[[int, int], DataFrame | None] | None = None
    position: Callable[[], int] | None = None
    chunks_per_step: int | None = 64
    clock: Callable[[], float] = time.time

    def decide(self, table: str, declared: str | None, automatic: bool = True, purge_on_version: bool = False) -> str:
        """fresh, fresh_purge, resume or skip; the rule of operators.backfill.decision for one row."""
        row = self.state.load("backfill").get(table)
        if row is None or row.get("status") is None:
            return "fresh" if automatic else "skip"
        fresh = lambda purge: "fresh_purge" if purge else "fresh"
        if row["status"] == "requested":
            return fresh(row.get("purge"))
        if row["status"] == "in_progress":
            return "resume"
        if row["status"] == "completed" and automatic and row.get("version") != declared:
            return fresh(row.get("purge") or purge_on_version)
        return "skip"

    def version(self, table: str) -> str | None:
        found = sorted({m.version for m in self.engine.model.mappings if m.table == table and m.version})
        return "+".join(found) or None

    def run_due(self, now: float | None = None) -> dict[str, str]:
        """Every table that is due; one that fails backs off alone and the others go on."""
        now = self.clock() if now is None else now
        done: dict[str, str] = {}
        if not self.engine.proceed():
            return done
        for table in self.engine.model.tables:
            row = self.state.load("backfill").get(table, {})
            step = self.decide(table, self.version(table))
            if step == "skip" or row.get("next_attempt_at", 0) > now or table not in self.tables:
                continue
            try:
                self.run(table, step)
                done[table] = step
            except Exception as e:  # noqa: BLE001
                self.state.update("backfill", lambda rows: rows.update({table: self._failed(rows.get(table, {"status": "in_progress"}), now, e)}))  # noqa: B023
                done[table] = "failed"
        return done

    def _failed(self, row: dict, now: float, error: Exception) -> dict:
        n = row.get("attempts", 0) + 1
        return row | {"attempts": n, "next_attempt_at": now + backoff(n - 1), "last_error": str(error)[:500]}

    def run(self, table: str, step: str = "fresh") -> int:
        spec = self.engine.model.tables[table]
        row = self.state.load("backfill").get(table, {})
        progress = decode_ranges(row.get("cursor"), list(spec.primary_key)) if step == "resume" else None
        if step == "fresh_purge":
            self.purge(table)
        copied = row.get("rows_copied", 0) if progress else 0
        begin = {"status": "in_progress", "cursor": row.get("cursor") if progress else None, "purge": False, "rows_copied": copied}
        self.state.update("backfill", lambda rows: rows.update({table: rows.get(table, {}) | begin}))
        copied = self._ranges(spec, self.tables[table](), f"backfill:{table}", progress, copied, lambda c, n: self.state.save_progress(table, c, n))
        # a request that came meanwhile stays
        self.state.save_progress(table, None, copied, status="completed", version=self.version(table), attempts=0)
        return copied

    def _ranges(self, spec: TableSpec, source: DataFrame, scope: str, progress: dict | None, copied: int, saved: Callable[[str, int], bool]) -> int:
        """Deliver the ranges that `progress` hasn't done; `saved` keeps the cursor after each and says
        whether to go on."""
        key, run_id, numbers = list(spec.primary_key), uuid.uuid4().hex, count()
        progress = progress or {"ranges": None, "done": 0, "after": None}
        behind, ranges = progress["after"], progress["ranges"]
        if ranges is None:
            rest = key_range(source, key, behind, None)
            ranges = key_ranges(rest, key, self.engine.options.backfill_chunk * self.chunks_per_step) if self.chunks_per_step else []
        with self.engine.watch():
            for k in range(progress["done"], len(ranges) + 1):
                after, upto = ranges[k - 1] if k else behind, ranges[k] if k < len(ranges) else None
                copied += self._step(spec, source, after, upto, Batch(next(numbers), scope, run_id))
                if not saved(encode_ranges(key, ranges, k + 1, behind), copied):
                    break
        return copied

    def _step(self, spec: TableSpec, source: DataFrame, after: list | None, upto: list | None, batch: Batch) -> int:
        """Read, clear, route and deliver one range; how many rows it has."""
        key, position = list(spec.primary_key), self.position or self.engine.position
        mappings = [m for m in self.engine.model.mappings if m.table == spec.qualified]
        low, began = position(), time.monotonic()
        page = materialise(key_range(source, key, after, upto), "page")
        try:
            n = page.count()
            if n:
                with self.engine.lock:
                    # the engine's own positions are batches: the last delivered one counts
                    high = position() if self.position else position() + 1
                    seen = self.live(low, high) if self.live else self.engine.live(spec, low, high)
                    rows = page if seen is None else minus_live(page.withColumns({"low_pos": F.lit(low), "high_pos": F.lit(high)}), seen, key).drop("low_pos", "high_pos")
                    records = materialise(route(self.reads(spec, rows, batch.run), mappings, self.engine.sink_defaults), "records")
                    try:
                        dispatch(records, self.engine.sinks, batch, self.engine.options)
                    finally:
                        discard(records)
                self.engine.totals["backfill.rows"] += n
            self.engine.seconds["backfill.chunk.duration"].add(time.monotonic() - began)
            return n
        finally:
            discard(page)

    def reads(self, spec: TableSpec, rows: DataFrame, run_id: str) -> DataFrame:
        """Snapshot rows as read events: position 0, no time, the run's id."""
        spec = self.engine.spec(spec.qualified)
        kinds = {f.name: f.dataType for f in spec.columns.fields}
        ident = canonical_id(*[rendered(F.col(k), kinds[k]) for k in spec.primary_key])
        return rows.select(
            F.lit(spec.schema).alias("schema"), F.lit(spec.table).alias("table"), F.lit("read").alias("action"), F.lit(None).cast("timestamp_ntz").alias("commit_ts"), F.lit(0).cast("bigint").alias("commit_lsn"),
            F.lit(0).alias("commit_idx"), F.struct(*[F.col(n) for n in kinds]).alias("record"), ident.alias("doc_key"), F.lit(run_id).alias("backfill_run_id"),
        )

    def purge(self, table: str) -> None:
        """Empty the table's fixed destinations; scoped ones and sinks without purge are skipped."""
        for m in self.engine.model.mappings:
            target = m.destination or self.engine.sink_defaults.get(m.sink)
            if m.table == table and target and not m.scoped_destination:
                for s in (s for s in self.engine.sinks if s.name == m.sink and hasattr(s, "purge")):
                    s.purge(target)

    def drain_fanout(self) -> dict[str, str]:
        """Run queued scopes, due ones by their time; a job of an unknown table waits, one that
        fails backs off and then goes on behind the ranges it has done, one that was triggered again
        while it ran stays and begins anew."""
        done: dict[str, str] = {}
        if not self.engine.proceed():
            return done
        jobs = sorted(self.state.load("fanout").items(), key=lambda x: (x[1].get("next_attempt_at", 0), x[1].get("requested_at", 0)))
        for name, job in jobs:
            if job["table"] not in self.tables or job.get("next_attempt_at", 0) > self.clock():
                done[name] = "deferred"
                continue
            spec = self.engine.model.tables[job["table"]]
            if self.state.update("fanout", lambda rows: name in rows and bool(rows[name].update(status="in_progress") or True)) is False:  # noqa: B023
                continue
            job = self.state.load("fanout")[name]
            try:
                names = job["columns"]
                rows = lookup_scan(self.tables[job["table"]](), self._lookups(job), [(c, f"v{i}") for i, c in enumerate(names)])
                progress = decode_ranges(job.get("cursor"), list(spec.primary_key))
                self._ranges(spec, rows, f"fanout:{name}", progress, job.get("rows_copied", 0) if progress else 0, lambda c, n: self._kept(name, c, n))  # noqa: B023
            except Exception as e:  # noqa: BLE001
                self.state.update("fanout", lambda rows: rows.update({name: self._failed(rows[name], self.clock(), e) | {"status": "requested"}}))  # noqa: B023
                done[name] = "failed"
                continue
            gone = self.state.update("fanout", lambda rows: rows.get(name, {}).get("status") == "in_progress" and bool(rows.pop(name)))  # noqa: B023
            if gone and "path" in job:
                Files(self.engine.spark).delete(job["path"])
            for s in self.engine.sinks:
                getattr(s, "forget", lambda scope: None)(f"fanout:{name}")
            done[name] = "done"
        self.engine.totals["fanout.queue.depth"] = len(self.state.load("fanout"))
        return done

    def _kept(self, name: str, cursor: str, copied: int) -> bool:
        """Keep a scope's cursor; one that was triggered again meanwhile begins anew, so this run is over."""

        def change(rows: dict[str, dict]) -> bool:
            if rows.get(name, {}).get("status") != "in_progress":
                return False
            rows[name] |= {"cursor": cursor, "rows_copied": copied}
            return True

        return self.state.update("fanout", change)

    def _lookups(self, job: dict) -> DataFrame:
        spark, names = self.engine.spark, job["columns"]
        if "path" in job:
            return spark.read.parquet(job["path"]).select(*[F.col(c).alias(f"v{i}") for i, c in enumerate(names)])
        return spark.createDataFrame([tuple(v) for v in job["values"]], [f"v{i}" for i in range(len(names))])
