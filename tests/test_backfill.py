import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet import metrics
from rivulet.model import Mapping, Model, Options, TableSpec
from rivulet.plans.control import ControlClient, StateStore
from rivulet.sinks import CaptureSink
from rivulet.streaming.backfill import Backfiller, backoff
from rivulet.streaming.driver import Engine

IMAGE = T.StructType([T.StructField("id", T.LongType()), T.StructField("g", T.LongType())])


@pytest.fixture
def made(spark, tmp_path):
    model = Model()
    model.add(TableSpec("app", "a", IMAGE, ("id",)))
    model.add(TableSpec("app", "b", IMAGE, ("id",)))
    for t in ("a", "b"):
        model.map(Mapping(f"app.{t}", "docs", lambda live: live.select("doc_key", F.col("record.g").alias("document")), destination=t, version="v1"))
    sink = CaptureSink("docs")
    rows = spark.range(25).select("id", (F.col("id") % 3).alias("g"))
    engine = Engine(spark, model, [sink], options=Options(backfill_chunk=5))
    fill = Backfiller(engine, StateStore(spark, f"file://{tmp_path}/state"), {"app.a": lambda: rows, "app.b": lambda: 1 / 0}, chunks_per_step=2, clock=lambda: 100.0)
    return fill, sink


def test_runs_decide_fail_alone_and_complete(made):
    fill, sink = made
    assert fill.run_due() == {"app.a": "fresh", "app.b": "failed"}
    assert len(sink.latest()) == 25 and all(r["is_backfill"] and r["action"] == "read" for r in sink.records)
    state = fill.state.load("backfill")
    assert state["app.a"]["status"] == "completed" and state["app.a"]["rows_copied"] == 25
    assert state["app.b"]["next_attempt_at"] == 105.0 and fill.run_due() == {}
    fill.state.request_backfill("app.a", purge=True)
    assert fill.decide("app.a", "v1") == "fresh_purge" and fill.decide("app.a", "v2") == "fresh_purge"
    sink.records.append(sink.records[0] | {"document_id": "stale"})
    fill.run("app.a", "fresh_purge")
    assert len(sink.latest()) == 25
    assert fill.decide("app.a", "v1") == "skip" and fill.decide("app.a", "v2") == "fresh"
    assert [backoff(n) for n in (0, 1, 6, 99)] == [5, 10, 300, 300]


def test_resume_goes_on_from_the_cursor(made):
    fill, sink = made
    ok, n = sink.deliver, []
    sink.deliver = lambda r, b: n.append(b) or (ok(r, b) if len(n) < 2 else "permanent")
    assert fill.run_due()["app.a"] == "failed"
    sink.deliver = ok
    assert fill.state.load("backfill")["app.a"]["rows_copied"] == 10 and fill.decide("app.a", "v1") == "resume"
    fill.run("app.a", "resume")
    assert sorted(int(r["document_id"]) for r in sink.records) == list(range(25))
    assert len({r["backfill_run_id"] for r in sink.records}) == 2


def test_ranges_cover_every_key_once(spark, tmp_path):
    from rivulet.sources.snapshot import key_range, key_ranges

    rows = spark.range(3000).select((F.col("id") % 7).cast("int").alias("a"), F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("b"), "id")
    for size, most in ((100, 64), (100, 8), (10_000, 64)):
        cuts = key_ranges(rows, ["a", "b"], size, most)
        assert len(cuts) == (min(most, -(-3000 // size)) - 1)
        parts = [key_range(rows, ["a", "b"], a, b).select("id") for a, b in zip([None, *cuts], [*cuts, None], strict=True)]
        sizes = [p.count() for p in parts]
        assert sum(sizes) == 3000 and (most == 8 or max(sizes) <= max(size, 3000 if size > 3000 else size))
        plan = parts[len(parts) // 2]._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "Sort" not in plan
    large = spark.range(1_000_000)
    cuts = key_ranges(large, ["id"], 1000)
    sizes = [key_range(large, ["id"], a, b).count() for a, b in zip([None, *cuts], [*cuts, None], strict=True)]
    assert len(sizes) == 64 and sum(sizes) == 1_000_000 and max(sizes) < 4 * 1_000_000 / 64
    # a table laid out by its key: each file is read by the ranges that touch it alone
    spark.range(10_000).repartitionByRange(10, "id").sortWithinPartitions("id").write.option("parquet.block.size", 1 << 14).parquet(f"{tmp_path}/sorted")
    table = spark.read.parquet(f"{tmp_path}/sorted")
    opened = 0
    cuts = key_ranges(table, ["id"], 1000)
    for a, b in zip([None, *cuts], [*cuts, None], strict=True):
        plan = key_range(table, ["id"], a, b)
        assert a is None or "GreaterThanOrEqual(id" in plan._jdf.queryExecution().executedPlan().toString()
        opened += plan.select(F.input_file_name().alias("f")).distinct().count()
    assert opened <= 20


def test_a_scope_that_breaks_off_goes_on(made):
    fill, sink = made
    fill.chunks_per_step = 1
    fill.state.enqueue_fanout("h", {"table": "app.a", "columns": ["g"], "values": [[0], [1], [2]]})
    ok, n = sink.deliver, []
    sink.deliver = lambda r, b: n.append(b) or (ok(r, b) if len(n) < 3 else "permanent")
    assert fill.drain_fanout() == {"h": "failed"}
    row = fill.state.load("fanout")["h"]
    assert row["status"] == "requested" and row["rows_copied"] == 10 and row["attempts"] == 1
    sink.deliver = ok
    fill.clock = lambda: 1000.0
    read = []
    step = fill._step
    fill._step = lambda *a: read.append(step(*a)) or read[-1]
    assert fill.drain_fanout() == {"h": "done"} and fill.state.load("fanout") == {}
    assert sum(read) == 15 and sorted(int(r["document_id"]) for r in sink.records) == list(range(25))
    # triggered again while it runs: it stays, from the start
    fill.state.enqueue_fanout("h", {"table": "app.a", "columns": ["g"], "values": [[0]]})
    sink.deliver = lambda r, b: fill.state.enqueue_fanout("h", {"table": "app.a", "columns": ["g"], "values": [[0]]}) or ok(r, b)
    fill.drain_fanout()
    assert fill.state.load("fanout")["h"]["status"] == "requested" and fill.state.load("fanout")["h"]["cursor"] is None


@pytest.mark.parametrize("step", [2, None])
def test_live_wins(spark, made, step):
    fill, sink = made
    fill.chunks_per_step = step
    at = iter(range(0, 100, 10))
    fill.position = lambda: next(at)
    fill.live = lambda low, high: spark.createDataFrame([(3, low + 1), (4, high), (5, low)], "id long, pos long")
    fill.run("app.a")
    assert {str(i) for i in range(25)} - {r["document_id"] for r in sink.records} == {"3"}


def test_queued_scopes(made):
    fill, sink = made
    fill.state.enqueue_fanout("h1", {"table": "app.a", "columns": ["g"], "values": [[1], [2]]})
    fill.state.enqueue_fanout("h2", {"table": "app.none", "columns": ["g"], "values": [[1]]})
    fill.state.enqueue_fanout("h3", {"table": "app.b", "columns": ["g"], "values": [[1]]})
    assert fill.drain_fanout() == {"h1": "done", "h2": "deferred", "h3": "failed"}
    assert {int(r["document_id"]) % 3 for r in sink.records} == {1, 2}
    assert set(fill.state.load("fanout")) == {"h2", "h3"}


def test_control_client(made):
    state, now = made[0].state, [0.0]
    c = ControlClient(state, lambda: now[0])
    stopped = []
    assert c.gate(False) == "proceed" and c.widen()["widened"]
    assert c.suspend(reason="upgrade")["state"] == "suspend_requested" and c.gate(False) == "finalize"
    with pytest.raises(RuntimeError):
        c.widen(False)
    assert c.finalise(lambda: stopped.append(1))["state"] == "suspended" and stopped == [1]
    assert c.gate(False) == "idle" and c.resume()["state"] == "running"
    assert c.gate(True) == "finalize" and c.row()["origin"] == "configuration"
    now[0] = 30.0
    assert c.gate(False) == "finalize"
    now[0] = 61.0
    assert c.gate(False) == "proceed" and c.row()["state"] == "running"
    with pytest.raises(TimeoutError):
        c.wait(lambda r: r["state"] == "suspended", 1.0, sleep=lambda s: now.__setitem__(0, now[0] + s))


def test_metrics(spark):
    from rivulet.plans.queries import _user_records, users

    d = "/root/testdata/sf0.001"
    e = users(spark, d)
    assert metrics.received(e).agg(F.sum("changes_received")).first()[0] == e.count()
    row = metrics.lag(e, F.lit("2030-01-01")).first()
    assert 0 < row["p50"] <= row["p95"] <= row["max"]
    assert metrics.delivered(_user_records(spark, d)).first()["records_delivered"] == e.select("doc_key").distinct().count()
