"""The engine end to end: transactions, savepoints, missing columns, queues, backfills, suspension."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.model import Binding, Mapping, Model, Options, TableSpec
from rivulet.plans import deliveries
from rivulet.plans.control import ControlClient, StateStore, Throttled
from rivulet.plans.queries import QUERIES
from rivulet.sinks import CaptureSink, TableSink, VectorSink, tables
from rivulet.sources import changelog
from rivulet.storage import materialise
from rivulet.streaming.backfill import Backfiller
from rivulet.streaming.driver import Engine, Suspended
from rivulet.streaming.spill import TransactionSpill

TINY = "/root/testdata/sf0.001"
IMAGE = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("group", T.LongType())])
SPEC = TableSpec("app", "items", IMAGE, ("id",))
GROUPS = TableSpec("app", "groups", IMAGE, ("id",))


def raw(seq, kind, xid, sub=None, action=None, new=None, old=None, absent=(), table="items"):
    return {"kind": kind, "seq": seq, "xid": xid, "subxid": sub, "schema": "app", "table": table, "action": action, "new": new, "old": old, "unavailable_cols": list(absent)}


def log(spark, rows):
    schema = changelog.log_schema(IMAGE)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def engine(spark, sink, **more):
    model = Model()
    model.add(SPEC)
    model.add(GROUPS)
    model.map(Mapping("app.items", sink.name, lambda live: live.select("doc_key", F.col("record.name").alias("document")), destination="d"))
    model.bind(Binding("app.groups", "app.items", (("id", "group"),)))
    return Engine(spark, model, [sink], **more)


def protocol(rnd, n):
    """Raw records of interleaved transactions, and the documents that a plain fold leaves."""
    rows, open_, now, seq = [], {}, {}, 0
    for xid in range(1, n):
        open_[xid] = []
    live = list(open_)
    while live:
        seq += 1
        x = rnd.choice(live[:4])
        kept = open_[x]
        dice = rnd.random()
        if dice < 0.15:
            live.remove(x)
            if rnd.random() < 0.3:
                rows.append(raw(seq, "abort", x))
                continue
            rows.append(raw(seq, "commit", x))
            for _, key, name in kept:
                if name is None:
                    now.pop(key, None)
                else:
                    now[key] = name
        elif dice < 0.3:
            sub = rnd.choice([1, 2])
            rows.append(raw(seq, "sub_abort", x, sub))
            at = next((i for i, k in enumerate(kept) if k[0] == sub), None)
            if at is not None:
                del kept[at:]
        else:
            sub, key = rnd.choice([None, 1, 2]), rnd.randint(1, 12)
            name = None if rnd.random() < 0.2 else f"v{seq}"
            rows.append(raw(seq, "change", x, sub, "update" if name else "delete", (key, name, 0) if name else None, None if name else (key, None, None)))
            kept.append((sub, key, name))
    return rows, {str(k): v for k, v in now.items()}


@pytest.mark.parametrize("slices", [False, True])
def test_protocol_records_equal_a_fold(spark, tmp_path, slices):
    rows, want = protocol(random.Random(11 + slices), 25)
    sink = TableSink(spark, f"file://{tmp_path}/t")
    e = engine(spark, sink, work=f"file://{tmp_path}/work", slice_batches=slices, options=Options(max_transactions=3, max_batch_size=5))
    cuts = [0, len(rows) // 3, len(rows) // 2, len(rows)]
    for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        for _ in range(2 if n == 1 else 1):  # a batch that comes again changes nothing
            e.process(log(spark, rows[a:b]), n)
    assert {r["id"]: r["document"] for r in sink.read().collect()} == want


def test_open_transactions_are_written_once(spark, tmp_path):
    sink = TableSink(spark, f"file://{tmp_path}/t")
    e = engine(spark, sink, work=f"file://{tmp_path}/work")
    batches = 14
    for n in range(batches):  # transaction 1 is open over all; 100 + n ends two batches later, each third aborts
        rows = [raw(100 * n + 1, "change", 1, None, "insert", (n, f"long {n}", 0)), raw(100 * n + 2, "change", 100 + n, None, "insert", (1000 + n, "short", 0))]
        if n >= 2:
            rows.append(raw(100 * n + 3, "abort" if n % 3 == 0 else "commit", 98 + n))
        for _ in range(2 if n == 5 else 1):
            e.process(log(spark, rows), n)
    kept = {int(p.parent.name): spark.read.parquet(str(p.parent)).count() for p in (tmp_path / "work/open/segments").glob("*/_SUCCESS")}
    assert kept == {n: 2 for n in range(batches)}  # each record once, in its own batch's segment
    assert {r["id"] for r in sink.read().collect()} == {str(1000 + n - 2) for n in range(2, batches) if n % 3}
    # the manifest counts them
    from rivulet.streaming.spill import LostSegment, TransactionSpill

    manifest = TransactionSpill(spark, f"file://{tmp_path}/work/open").manifest(batches)
    assert manifest[1] == {n: 1 for n in range(batches)} and set(manifest) == {1, 100 + batches - 1, 100 + batches - 2}
    end = log(spark, [raw(99_999, "commit", 1)])
    gone = tmp_path / "work/open/segments/7"
    gone.rename(tmp_path / "aside")
    with pytest.raises(LostSegment, match="gone"):
        e.process(end, batches)
    (tmp_path / "aside").rename(gone)
    part = next(p for p in gone.glob("*.parquet") if spark.read.parquet(str(p)).where("xid = 1").count())
    part.rename(tmp_path / "part")
    with pytest.raises(LostSegment, match="13 of 14"):
        e.process(end, batches)
    (tmp_path / "part").rename(part)
    e.process(end, batches)
    e.process(end, batches)  # again
    got = {r["id"]: r["document"] for r in sink.read().collect()}
    assert all(got[str(n)] == f"long {n}" for n in range(batches))
    e.process(log(spark, [raw(100_000, "change", 7, None, "insert", (5, "x", 0))]), batches + 1)
    e.process(log(spark, []), batches + 2)
    assert len(list((tmp_path / "work/open/segments").glob("*"))) <= 3


def test_windows_by_tokens_across_restarts(spark, tmp_path):
    """Interleaved windows: a row that changed inside its window isn't overwritten by what the chunk read before."""
    from rivulet.streaming.windows import TokenWindows

    sink = TableSink(spark, f"file://{tmp_path}/t")
    snapshot = spark.createDataFrame([(i, f"old{i}", 0) for i in range(8)], IMAGE)

    def made():
        return engine(spark, sink, work=f"file://{tmp_path}/work", windows=TokenWindows(spark, f"file://{tmp_path}/windows"))

    def chunk(token, ids):
        e = made()
        fill = Backfiller(e, StateStore(spark, f"file://{tmp_path}/state"), {})
        e.windows.keep(token, "app.items", fill.reads(SPEC, snapshot.where(F.col("id").isin(ids)), "run"))

    mark = lambda seq, kind, token: raw(seq, kind, None) | {"token": token}
    change = lambda seq, key, name: [raw(seq, "change", seq, None, "update" if name else "delete", (key, name, 0) if name else None, None if name else (key, None, None)), raw(seq + 1, "commit", seq)]
    chunk("a", [0, 1, 2, 3])
    chunk("b", [4, 5, 6, 7])
    batches = [
        [mark(1, "watermark_low", "a"), *change(2, 1, "live1"), mark(4, "watermark_low", "b"), *change(5, 4, "live4")],
        [*change(10, 2, None), mark(12, "watermark_high", "a"), *change(13, 3, "late3"), mark(15, "watermark_high", "x")],
        [*change(20, 5, None), mark(22, "watermark_high", "b")],
        [*change(30, 6, "after6")],
    ]
    for n, rows in enumerate(batches):
        for _ in range(2 if n == 1 else 1):  # a batch that comes again closes no window twice
            made().process(log(spark, rows), n)
    # 3 changed behind the window's high token, in the batch that closed it
    want = {"0": "old0", "1": "live1", "3": "late3", "4": "live4", "6": "after6", "7": "old7"}
    assert {r["id"]: r["document"] for r in sink.read().collect()} == want
    assert TokenWindows(spark, f"file://{tmp_path}/windows").manifest(9) == {"open": {}, "segments": []}


def test_aborted_and_open_transactions_are_not_delivered(spark, tmp_path):
    sink = CaptureSink("docs")
    e = engine(spark, sink)
    e.process(log(spark, [raw(1, "change", 7, None, "insert", (1, "a", 0)), raw(2, "abort", 7)]), 0)
    assert sink.records == []
    with pytest.raises(ValueError, match="without an end"):
        e.process(log(spark, [raw(3, "change", 8, None, "insert", (1, "a", 0))]), 1)
    with pytest.raises(ValueError, match="without a commit position"):
        e.process(log(spark, [raw(3, "change", 8, None, "insert", (1, "a", 0))]).drop("xid"), 1)


def test_columns_that_never_came_are_read_again(spark, tmp_path):
    now = spark.createDataFrame([(1, "present", 7), (2, "two", 7)], IMAGE)
    sink = CaptureSink("docs")
    rows = [raw(1, "change", 1, None, "update", (1, None, 5), None, ["name"]), raw(2, "change", 1, None, "update", (9, None, 5), None, ["name"]), raw(3, "change", 1, None, "update", (2, "own", 5)), raw(4, "commit", 1)]
    engine(spark, sink, current={"app.items": lambda: now}).process(log(spark, rows), 0)
    assert {k[1]: v for k, v in sink.latest().items()} == {"1": "present", "2": "own"} and len(sink.records) == 2


def fanout_log(spark, ids):
    rows = [raw(n, "change", 1, None, "update", (i, "g", 0), (i, "f", 0), table="groups") for n, i in enumerate(ids)]
    return log(spark, [*rows, raw(10_000, "commit", 1)])


def test_large_fanout_is_queued(spark, tmp_path):
    now = spark.range(60).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 10).alias("group"))
    sink = CaptureSink("docs")
    state = StateStore(spark, f"file://{tmp_path}/state")
    options = Options(max_batch_size=4, fanout_chunk=3, max_fanout_keys=6)
    e = engine(spark, sink, current={"app.items": lambda: now}, state=state, work=f"file://{tmp_path}/work", options=options)
    fill = Backfiller(e, state, {"app.items": lambda: now})
    ids = lambda: {int(r["document_id"]) for r in sink.records}
    e.process(fanout_log(spark, [1]), 0)  # six rows: a page now, all of them later
    assert ids() == {1, 11, 21, 31} and len(state.load("fanout")) == 1
    e.process(fanout_log(spark, [1]), 1)
    assert len(state.load("fanout")) == 1  # the same lookups are one job
    assert set(fill.drain_fanout().values()) == {"done"} and ids() == {i for i in range(60) if i % 10 == 1} and state.load("fanout") == {}
    sink.records.clear()
    e.process(fanout_log(spark, [2, 3, 4, 5, 6]), 2)  # two chunks and no page
    assert ids() == set() and len(state.load("fanout")) == 2
    fill.drain_fanout()
    assert ids() == {i for i in range(60) if i % 10 in (2, 3, 4, 5, 6)}
    e.process(fanout_log(spark, range(7)), 3)  # too many: the whole table
    assert state.load("backfill")["app.items"]["status"] == "requested" and state.load("fanout") == {}


def test_live_wins_over_backfills_of_one_table_sink(spark, tmp_path):
    """Live batches, a backfill with live changes in the middle, a lost run and its resumption, live again."""
    rows = {i: f"old{i}" for i in range(40)}
    sink = TableSink(spark, f"file://{tmp_path}/t")
    e = engine(spark, sink, options=Options(backfill_chunk=5))
    state = StateStore(spark, f"file://{tmp_path}/state")
    batch = iter(range(100))
    snapshot = spark.createDataFrame([(i, n, 0) for i, n in rows.items()], IMAGE)  # as it was before the live changes

    def live(key, name):
        n = next(batch)
        change = raw(n * 2, "change", n, None, "update" if name else "delete", (key, name, 0) if name else None, None if name else (key, None, None))
        e.process(log(spark, [change, raw(n * 2 + 1, "commit", n)]), n)

    def between(*changes):
        def reading():
            if todo:
                step()
            return snapshot

        todo = list(changes)

        def step():
            while todo:
                live(*todo.pop())

        return reading

    for i in range(5):
        live(100 + i, f"live{i}")
    # the changes come after the window opens and before its rows are delivered
    fill = Backfiller(e, state, {"app.items": between()}, chunks_per_step=2)
    deliver, steps = sink.deliver, []

    def watched(records, b):
        if b.scope.startswith("backfill"):
            steps.append(b)
            if len(steps) == 3:
                return "permanent"
        return deliver(records, b)

    sink.deliver = watched
    position = e.position

    def opens():
        at = position()
        if not steps and at == 5:
            live(3, "live wins")
            live(4, None)
            return at
        return at

    e.position = opens
    assert fill.run_due() == {"app.items": "failed"}
    assert state.load("backfill")["app.items"]["rows_copied"] == 20
    again = Backfiller(e, state, {"app.items": lambda: snapshot}, chunks_per_step=2)
    again.run("app.items", "resume")
    assert state.load("backfill")["app.items"] | {"status": "completed", "rows_copied": 40} == state.load("backfill")["app.items"]
    live(7, "after")
    restarted = TableSink(spark, f"file://{tmp_path}/t")
    want = {str(i): n for i, n in rows.items()} | {str(100 + i): f"live{i}" for i in range(5)} | {"3": "live wins", "7": "after"}
    del want["4"]
    assert {r["id"]: r["document"] for r in restarted.read().collect()} == want


def test_suspension_holds_batches_and_backfills(spark, tmp_path):
    state = StateStore(spark, f"file://{tmp_path}/state")
    control = ControlClient(state)
    sink = CaptureSink("docs")
    e = engine(spark, sink, control=control)
    fill = Backfiller(e, state, {"app.items": lambda: spark.createDataFrame([(1, "a", 0)], IMAGE)})
    rows = log(spark, [raw(1, "change", 1, None, "insert", (5, "x", 0)), raw(2, "commit", 1)])
    control.suspend()
    with pytest.raises(Suspended):
        e.process(rows, 0)
    assert fill.run_due() == {} and fill.drain_fanout() == {} and sink.records == []
    control.resume()
    e.process(rows, 0)
    assert fill.run_due() == {"app.items": "fresh"} and len(sink.latest()) == 2
    assert [r["state"] for r in control.status()] == ["running", "completed"]


def test_columns_nobody_asked_for_come_only_when_widened(spark, tmp_path):
    control = ControlClient(StateStore(spark, f"file://{tmp_path}/state"))
    seen = []

    def transform(live):
        seen.append(live.schema["record"].dataType.fieldNames())
        return live.select("doc_key", F.col("record.name").alias("document"))

    model = Model()
    model.add(SPEC)
    model.map(Mapping("app.items", "docs", transform, destination="d", consumes=("name",)))
    sink = CaptureSink("docs")
    e = Engine(spark, model, [sink], control=control, measure=True)
    rows = log(spark, [raw(1, "change", 1, None, "insert", (5, "x", 0)), raw(2, "change", 1, None, "insert", (6, "y", 0)), raw(3, "commit", 1)])
    e.process(rows, 0)
    control.widen()
    e.process(rows, 1)
    assert seen == [["id", "name"], ["id", "name", "group"]] and len(sink.latest()) == 2
    assert e.totals["changes.received"] == 4 and e.totals["sink.records.delivered.docs"] == 4


def test_sinks_are_opened_and_closed_once(spark):
    told = []

    class Told(CaptureSink):
        def open(self):
            told.append("open")

        def close(self):
            told.append("close")
            raise RuntimeError("late")

    with pytest.raises(RuntimeError, match="late"), engine(spark, Told("docs")) as e:
        e.open()
    e.close()
    assert told == ["open", "close"]


def test_no_update_of_the_state_is_lost(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    stores = [StateStore(spark, f"file://{tmp_path}/state") for _ in range(4)]

    def add(k):
        for _ in range(10):
            stores[k].update("n", lambda rows: rows.update({"all": rows.get("all", 0) + 1}))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(4)))
    assert stores[0].load("n") == {"all": 40}
    stores[0].request_backfill("t")
    assert not stores[1].save_progress("t", "c", 1)  # loses to the request


def test_throttled_checkpoint():
    now, saved = [0.0], []

    def save(p):
        if p == 2:
            raise OSError
        saved.append(p)

    t = Throttled(save, 5.0, lambda: now[0])
    assert t.save(1) and not t.save(5)
    now[0] = 6.0
    with pytest.raises(OSError):
        t.save(2)
    assert t.save(3) and saved == [1, 3]


def test_files_of_a_log_hold_so_many_records_at_any_length(spark, duck, monkeypatch):
    monkeypatch.setattr(deliveries, "FILE_ROWS", 100)
    files, streamed = {}, changelog.stream_log

    def stream_log(session, path, *rest):
        files.update({r["f"]: r["n"] for r in session.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()})
        return streamed(session, path, *rest)

    monkeypatch.setattr(changelog, "stream_log", stream_log)
    got = QUERIES["engine_stream"](spark, TINY).collect()
    assert sum(files.values()) > 500 and max(files.values()) <= 200, files
    assert sorted(map(tuple, got)) == sorted(duck.execute(deliveries.LAST_USERS).fetchall())


def test_documents_of_a_vector_sink_are_dealt_once(spark, tmp_path, monkeypatch):
    """Only the batch's and the stored rows are dealt by key, and a repeat writes nothing."""
    sink = VectorSink(spark, f"file://{tmp_path}/v", 1, lambda ts: [[float(len(t))] for t in ts], "text")
    docs = spark.range(40).select(F.lit("d").alias("destination"), F.col("id").cast("string").alias("document_id"), F.to_json(F.struct(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))).alias("document"))
    batch = lambda gone: docs.withColumn("is_deletion", gone).withColumn("document", F.when(~gone, F.col("document"))).withColumns({"commit_lsn": F.lit(1), "commit_idx": F.lit(0)})
    sink.deliver(batch(F.lit(False)), 0)
    dealt, written, keep = [], [], tables.materialise

    def watched(df, name):
        dealt.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        written.append(keep(df, name))
        return written[-1]

    monkeypatch.setattr(tables, "materialise", watched)
    out = sink.records(batch(F.col("document_id") == "7"), [])
    dealt.append(out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
    assert sum(dealt) <= 4, dealt
    assert [f.count() for f in written] == [1] and [(r["id"], r["is_deletion"]) for r in out.collect()] == [("7", True)]
    assert {r["id"]: r["embedding"] and list(r["embedding"]) for r in sink.read().collect()} == {str(i): [float(i)] if i else None for i in range(40)}


def test_rows_of_ended_transactions_are_not_dealt_anew(spark, tmp_path):
    """Which transactions stay open is found by their numbers; rows meet the few open ones by broadcast."""
    rows = log(spark, [raw(2 * i, "change", i // 2, action="insert") for i in range(40)] + [raw(2 * i + 1, "commit", i // 2) for i in range(1, 38, 2)])
    kept = materialise(rows, "raw")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        now = TransactionSpill(spark, f"file://{tmp_path}/open").whole(kept, 0, [])
        assert "SortMergeJoin" not in now._jdf.queryExecution().executedPlan().toString()
        assert {r["xid"] for r in now.collect()} == set(range(19))
        assert TransactionSpill(spark, f"file://{tmp_path}/open").manifest(0) == {19: {0: 2}}
        with pytest.raises(ValueError, match="without a transaction"):
            TransactionSpill(spark, f"file://{tmp_path}/none").whole(materialise(log(spark, [raw(1, "change", None)]), "raw"), 0, [])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
