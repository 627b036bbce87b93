"""Live mode: the change log as a stream of micro-batches (§2.12 of the survey).

A batch is assembled to committed transactions (records of aborted ones, and what savepoints
rolled back, go; transactions without an end wait for the next batch), collapsed, routed,
joined by its fan-out and delivered to all sinks before Spark's commit log moves on; a failure
redelivers the batch whole, and sinks apply a batch once."""

from __future__ import annotations

import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import metrics
from ..model import Binding, Model, Options, TableSpec
from ..operators import assemble, fanout
from ..operators.materialise import healed, with_record
from ..operators.route import route
from ..plans.control import ControlClient, StateStore
from ..sinks.dispatch import Batch, DeliveryError, Sink, dispatch
from ..sources.changelog import only_modelled
from ..storage import Files, discard, materialise
from .spill import TransactionSpill
from .windows import TokenWindows

EVENT = ["schema", "table", "action", "commit_ts", "commit_lsn", "commit_idx", "record", "doc_key"]
#: Slices of one micro-batch are numbered below this.
SLICES = 1_000_000


class Suspended(RuntimeError):
    """The control row doesn't let the engine go on; the batch isn't acknowledged."""


@dataclass
class Engine:
    spark: SparkSession
    model: Model
    sinks: list[Sink]
    #: Present rows of the tables that fan-out re-emits and unavailable columns are read from, by qualified name.
    current: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    sink_defaults: dict[str, str] = field(default_factory=dict)
    options: Options = field(default_factory=Options)
    #: Where fan-out that is too large for a batch and whole-table backfills are queued; without it all is sent inline.
    state: StateStore | None = None
    #: A shared folder for transactions that have no end yet and for queued lookups; without it such transactions are an error.
    work: str | None = None
    control: ControlClient | None = None
    #: Configuration's wish to be suspended.
    suspend: bool = False
    #: Count what is received and delivered and how late; the numbers come along with the batch's own jobs.
    measure: bool = False
    #: Where the log has a hole, its repair by backfills deletes what the tables don't have any more.
    purge_on_gap: bool = False
    #: Deliver a batch in greedy slices of whole transactions within the limits of the options.
    slice_batches: bool = False
    #: Chunks that wait for their high token in the log; those whose window a batch closes are delivered behind it.
    windows: TokenWindows | None = None

    def __post_init__(self) -> None:
        self.lock = threading.RLock()
        self.run = ""
        self.totals: dict[str, float] = defaultdict(float)
        self.seconds: dict[str, metrics.Histogram] = defaultdict(metrics.Histogram)
        self._accepted: dict[str, float] = {}
        self._watchers, self._delivered = 0, 0
        self._seen: list[tuple[int, dict[str, DataFrame]]] = []
        self._open = False
        self._closed: dict[int, list[str]] = {}

    # ---- sinks' lives

    def open(self) -> Engine:
        """Tell sinks that a term begins, once."""
        if not self._open:
            self._open = True
            for s in self.sinks:
                getattr(s, "open", lambda: None)()
        return self

    def close(self) -> None:
        """Tell sinks that it is over; each is told, whatever another one raises."""
        errors = []
        if self._open:
            self._open = False
            for s in self.sinks:
                try:
                    getattr(s, "close", lambda: None)()
                except Exception as e:  # noqa: BLE001
                    errors.append(e)
        if errors:
            raise errors[0]

    def __enter__(self) -> Engine:
        return self.open()

    def __exit__(self, *_) -> None:
        self.close()

    def delivery_lag(self) -> dict[str, float]:
        """Seconds since each sink last took a live batch."""
        return {name: time.monotonic() - at for name, at in self._accepted.items()}

    # ---- what backfills ask

    def position(self) -> int:
        """How many live batches this engine has delivered."""
        return self._delivered

    @contextmanager
    def watch(self) -> Iterator[None]:
        """While it lasts, the keys of delivered batches are kept for live()."""
        with self.lock:
            self._watchers += 1
        try:
            yield
        finally:
            with self.lock:
                self._watchers -= 1
                if not self._watchers:
                    for _, tables in self._seen:
                        discard(*tables.values())
                    self._seen.clear()

    def live(self, spec: TableSpec, low: int, high: int) -> DataFrame | None:
        """(key columns, pos) of changes that were delivered between two positions."""
        found = [t[spec.qualified].withColumn("pos", F.lit(n)) for n, t in self._seen if low < n < high and spec.qualified in t]
        return reduce(DataFrame.unionByName, found) if found else None

    def spec(self, name: str) -> TableSpec:
        """The table with the columns that its mappings and bindings ask for, or with all of them
        where a list would break identity or the control row says widened."""
        full = self.model.tables[name]
        chosen, _ = self.model.published_columns(name)
        if chosen is None or (self.control is not None and self.control.row().get("widened")):
            return full
        return replace(full, columns=T.StructType([f for f in full.columns.fields if f.name in chosen]), non_null=tuple(c for c in full.non_null if c in chosen))

    def proceed(self) -> bool:
        return self.control is None or self.control.gate(self.suspend) == "proceed"

    # ---- a batch

    def committed(self, log: DataFrame, batch_id: int) -> DataFrame:
        """The changes of committed transactions with their positions, written once.

        Rows that have a commit position are whole already; others are protocol records, which
        are assembled.  Those of transactions without an end are kept until it comes (see spill)."""
        gaps, seen = metrics.Observed(), metrics.Observed()
        changes = self._committed(gaps.over(log, F.count_if(F.col("kind") == "gap").alias("gaps")), log, batch_id, seen)
        try:
            if gaps.get()["gaps"]:
                self._repair()
            if self.measure:
                values = seen.get()
                self.totals["changes.received"] += values["received"]
                self.seconds["ingestion.lag"].merge(*metrics.lag_histogram(values))
        except Exception:
            discard(changes)
            raise
        return changes

    def _repair(self) -> None:
        """The log lacks rows: all tables that are mapped are asked for anew.  Asked again, as by a batch that
        comes again, they start over."""
        if self.state is None:
            raise ValueError("the log has a hole: give the engine a state store to ask for backfills")
        for table in sorted({m.table for m in self.model.mappings}):
            self.state.request_backfill(table, self.purge_on_gap)
        self.totals["gaps"] += 1

    def _committed(self, observed: DataFrame, log: DataFrame, batch_id: int, seen: metrics.Observed) -> DataFrame:
        def written_once(changes: DataFrame) -> DataFrame:
            if self.measure:
                changes = seen.over(changes, F.count(F.lit(1)).alias("received"), *metrics.lag_aggregates(F.current_timestamp()))
            return materialise(changes, "changes")

        ready = observed.where("kind = 'change' and commit_lsn is not null")
        if "xid" not in log.columns:
            if not log.where("kind = 'change' and commit_lsn is null").isEmpty():
                raise ValueError("changes without a commit position or a transaction")
            return written_once(ready)
        raw = log.where("commit_lsn is null and kind in ('change', 'sub_abort', 'commit', 'abort')")
        raw = materialise(raw, "raw")
        written = [raw]
        try:
            if self.work:
                ended = TransactionSpill(self.spark, f"{self.work}/open").whole(raw, batch_id, written)
            else:
                done = raw.where("kind in ('commit', 'abort')").select("xid").distinct()
                if not raw.join(done, "xid", "left_anti").isEmpty():
                    raise ValueError("transactions without an end: give the engine a work folder to keep them")
                ended = raw
            whole = assemble.assemble(ended).where("kind = 'change'")
            whole = whole.select(*[F.col(c).cast(log.schema[c].dataType).alias(c) for c in log.columns])
            return written_once(ready.unionByName(whole))
        finally:
            discard(*written)

    def events(self, changes: DataFrame) -> dict[str, DataFrame]:
        """Typed changes of each table; columns that never came are read from the present row."""
        changes = only_modelled(changes, list(self.model.tables))
        out = {}
        for name in self.model.tables:
            spec = self.spec(name)
            rows = with_record(changes.where((F.col("schema") == spec.schema) & (F.col("table") == spec.table)), spec)
            out[name] = healed(rows, spec, self.current[name]()) if name in self.current and "unavailable_cols" in rows.columns else rows
        return out

    def process(self, log: DataFrame, batch_id: int) -> dict[str, str]:
        """One batch, start to end; also the batch mode's entry."""
        if not self.proceed():
            raise Suspended(f"batch {batch_id}: {self.control.row()['state']}")
        with self.lock:
            changes = self.committed(log, batch_id)
            try:
                done = {}
                for number, part in self._slices(changes):
                    done = self._deliver(part, batch_id * SLICES + number if self.slice_batches else batch_id)
                if self.windows is not None:
                    self._close_windows(log, changes, batch_id)
                return done
            finally:
                discard(changes)

    def _close_windows(self, log: DataFrame, changes: DataFrame, batch_id: int) -> None:
        """Deliver the chunks whose windows this batch closes.  A batch that comes again closes them again,
        as the same deliveries; the chunks of the batch before can't come again and go."""
        keys = [rows.select(F.lit(name).alias("table"), "doc_key", F.col("commit_lsn").cast("long").alias("pos")) for name, rows in self.events(changes).items()]
        if not keys:
            return
        due = self.windows.passed(log, reduce(DataFrame.unionByName, keys), batch_id, behind=True)
        for token, (table, rows) in due.items():
            mappings = [m for m in self.model.mappings if m.table == table]
            records = materialise(route(rows, mappings, self.sink_defaults), "records")
            try:
                dispatch(records, self.sinks, Batch(0, f"window:{token}", self.run), self.options)
            finally:
                discard(records, rows)
        for token in self._closed.get(batch_id - 1, ()):
            self.windows.done(token)
        self._closed = {batch_id: list(due)}

    def _slices(self, changes: DataFrame) -> Iterator[tuple[int, DataFrame]]:
        if not self.slice_batches:
            yield 0, changes
            return
        sizes = changes.groupBy("commit_lsn").agg(F.count(F.lit(1)).alias("n_changes")).withColumn("boundary", F.lit(False))
        cut = materialise(assemble.batches(sizes, self.options.max_transactions, self.options.max_batch_size).select("commit_lsn", "batch"), "slices")
        try:
            for n in range((cut.agg(F.max("batch")).first()[0] + 1) if not cut.isEmpty() else 0):
                yield n, changes.join(cut.where(F.col("batch") == n).select("commit_lsn"), "commit_lsn", "left_semi")
        finally:
            discard(cut)

    def _deliver(self, changes: DataFrame, number: int) -> dict[str, str]:
        events = self.events(changes)
        parts: list[DataFrame] = []
        written: list[DataFrame] = []

        def once(rows: DataFrame) -> DataFrame:
            written.append(materialise(rows, "collapsed"))
            return written[-1]

        for name, rows in events.items():
            mappings = [m for m in self.model.mappings if m.table == name]
            if not mappings:
                continue
            every = rows.select(EVENT)
            for b in (b for b in self.model.bindings if b.primary == name and name in self.current):
                if (more := self._fanout(name, b, events, written)) is not None:
                    every = every.unionByName(more)
            parts.append(route(every, mappings, self.sink_defaults, once))
        if not parts:
            return {}
        records, sent = reduce(DataFrame.unionByName, parts), metrics.Observed()
        if self.measure:
            records = sent.over(records, *[F.count_if(F.col("sink") == s.name).alias(s.name) for s in self.sinks])
        records = materialise(records, "records")
        discard(*written)
        began = time.monotonic()
        try:
            done = dispatch(records, self.sinks, Batch(number, "live", self.run), self.options)
        except DeliveryError:
            self.totals["sink.delivery.failures"] += 1
            raise
        finally:
            self.totals["sink.delivery.duration"] += time.monotonic() - began
            self.seconds["sink.delivery.duration"].add(time.monotonic() - began)
            discard(records)
        self._accepted |= dict.fromkeys((s.name for s in self.sinks), time.monotonic())
        if self.measure:
            for name, n in sent.get().items():
                self.totals[f"sink.records.delivered.{name}"] += n
        self.totals["batches"] += 1
        self._delivered += 1
        if self._watchers:
            keys = {name: materialise(rows.select(*[F.col("record").getField(k).alias(k) for k in self.model.tables[name].primary_key]).distinct(), "live") for name, rows in events.items()}
            self._seen.append((self._delivered, keys))
        return done

    def _fanout(self, name: str, binding: Binding, events: dict[str, DataFrame], written: list[DataFrame]) -> DataFrame | None:
        """Updates of the rows that the batch's lookups name; None if all of them are queued.

        Without a state store every row is in the batch.  With one, more lookups than
        max_fanout_keys ask for the whole table, more than fanout_chunk are queued in chunks, and
        of fewer the first max_batch_size rows are in the batch; if there are more, the scope is
        queued as well and read again in full."""
        spec, source = self.spec(name), events[binding.dependent]
        keys = fanout.lookup_keys(source, binding)
        now = self.current[name]()
        if self.state is None:
            rows = fanout.matching_rows(now, keys)
        else:
            keys = materialise(keys, "lookups")
            written.append(keys)
            n = keys.count()
            if n > self.options.max_fanout_keys:
                self.state.request_backfill(name)
                return None
            if n > self.options.fanout_chunk:
                self._queue(name, keys)
                return None
            rows, more = fanout.first_page(fanout.matching_rows(now, keys), list(spec.primary_key), self.options.max_batch_size)
            if more.first()["queued"]:
                self._queue(name, keys)
        image = F.struct(*[f.name for f in spec.columns.fields])
        none = F.lit(None).cast(rows.select(image.alias("x")).schema["x"].dataType)
        stamped = fanout.stamped(rows, source)
        shaped = stamped.select(F.lit(spec.schema).alias("schema"), F.lit(spec.table).alias("table"), "action", F.lit(None).cast("timestamp_ntz").alias("commit_ts"), "commit_lsn", "commit_idx", image.alias("new"), none.alias("old"))
        return fanout.live_wins(with_record(shaped, spec).select(EVENT), events[name], ["doc_key"])

    def _queue(self, table: str, keys: DataFrame) -> None:
        """Queue lookups in chunks, each a folder of keys; equal chunks are one job."""
        if not self.work:
            raise ValueError("queued lookups need a work folder")
        path = f"{self.work}/lookups/{uuid.uuid4().hex}"
        for chunk, name in fanout.write_chunks(keys, table, self.options.fanout_chunk, path):
            self.state.enqueue_fanout(name, {"table": table, "columns": keys.columns, "path": f"{path}/chunk={chunk}", "requested_at": time.time()})

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Run the stream.  Batch numbers belong to the checkpoint, so its id is the run's."""
        files = Files(self.spark)
        files.create(f"{checkpoint}/rivulet-run", uuid.uuid4().hex)
        self.run = files.read(f"{checkpoint}/rivulet-run")
        self.work = self.work or f"{checkpoint}/rivulet-work"
        self.open()
        writer = stream.writeStream.foreachBatch(lambda df, i: self.process(df, i) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()
