"""The log as a stream of positions, its holes, and metrics that need no jobs of their own."""

import tempfile
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet import metrics
from rivulet.model import Mapping, Model, TableSpec
from rivulet.plans.control import StateStore
from rivulet.sinks import CaptureSink
from rivulet.sources import changelog
from rivulet.sources.positions import Hole, LogReader, RetentionHole, Segment, append_segments, stream_positions, trim_segments
from rivulet.streaming.driver import Engine

IMAGE = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
SCHEMA = changelog.log_schema(IMAGE)


def changes(spark, positions, table="items"):
    rows = [{"kind": "change", "commit_lsn": Decimal(p), "commit_idx": 0, "schema": "app", "table": table, "action": "insert", "new": (p % 1000, f"n{p}")} for p in positions]
    return spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA) for r in rows], SCHEMA)


def engine(spark, **more):
    model = Model()
    model.add(TableSpec("app", "items", IMAGE, ("id",)))
    model.map(Mapping("app.items", "docs", lambda live: live.select("doc_key", F.col("record.name").alias("document")), destination="d"))
    return Engine(spark, model, [CaptureSink("docs")], **more)


@pytest.fixture
def path():
    return "file://" + tempfile.mkdtemp(prefix="rivulet-log-")


def reader(path, **options):
    return LogReader(SCHEMA, {"path": path} | options)


def positions(r, start, end):
    """Positions of the rows between two offsets, in order of the partitions; holes as pairs."""
    out = []
    for p in r.partitions({"position": str(start)}, {"position": str(end)}):
        found = pa.Table.from_batches(list(r.read(p)), pa.schema(list(r.read(p))[0].schema)) if list(r.read(p)) else None
        out += [(p.after, p.last)] if isinstance(p, Hole) else [int(x) for x in found["commit_lsn"].to_pylist()] if found is not None else []
    return out


def test_segments_follow_each_other(spark, path):
    assert reader(path).initialOffset() == reader(path).latestOffset() == {"position": "0"}
    assert reader(path).partitions({"position": "0"}, {"position": "0"}) == []
    assert append_segments(changes(spark, [3, 5, 5, 9]), path, 3) == (0, 9)
    assert append_segments(changes(spark, [12, 2**63 + 5]), path) == (9, 2**63 + 5)
    assert append_segments(changes(spark, []), path) == (2**63 + 5, 2**63 + 5)
    r = reader(path)
    assert r.initialOffset() == {"position": "0"} and r.latestOffset() == {"position": str(2**63 + 5)}
    assert positions(r, 0, 2**63 + 5) == [3, 5, 5, 9, 12, 2**63 + 5]
    assert positions(r, 5, 12) == [9, 12] and positions(r, 4, 7) == [5, 5] and positions(r, 12, 12) == []
    assert reader(path, startingPosition="9").initialOffset() == {"position": "9"}


def test_appends_are_whole_and_ordered(spark, path):
    append_segments(changes(spark, [4]), path)
    for wrong in ([4], [2, 8]):
        with pytest.raises(ValueError, match="has already"):
            append_segments(changes(spark, wrong), path)
    with pytest.raises(ValueError, match="without a position"):
        append_segments(changes(spark, [8]), path, position=F.lit(None))
    assert positions(reader(path), 0, 4) == [4]


def test_holes_are_found(spark, path):
    for part in ([1, 2], [3, 4], [5, 6]):
        append_segments(changes(spark, part), path)
    assert trim_segments(spark, path, 3) == 1
    assert reader(path).initialOffset() == {"position": "2"}
    assert positions(reader(path), 2, 6) == [3, 4, 5, 6]
    with pytest.raises(RetentionHole, match="behind 1 up to 2"):
        reader(path).partitions({"position": "1"}, {"position": "6"})
    assert positions(reader(path, onHole="snapshot"), 1, 6) == [(1, 2), 3, 4, 5, 6]
    assert trim_segments(spark, path, 100) == 1 and trim_segments(spark, path, 100) == 0
    assert positions(reader(path, onHole="snapshot"), 0, 3) == [(0, 3)]
    with pytest.raises(RetentionHole, match="made anew"):
        reader(path).partitions({"position": "7"}, {"position": "6"})
    with pytest.raises(ValueError, match="onHole"):
        reader(path, onHole="skip")


def test_lost_rows_are_an_error(spark, path):
    append_segments(changes(spark, [1, 2]), path, 1)
    (p,) = reader(path).partitions({"position": "0"}, {"position": "2"})
    with pytest.raises(RuntimeError, match="not the 3"):
        list(reader(path).read(Segment(p.file, 3, p.after, p.last)))


def test_columns_by_name(spark, path):
    append_segments(changes(spark, [1]).drop("token", "old").withColumn("more", F.lit(1)), path)
    (row,) = stream_rows(spark, path)
    assert row["token"] is None and row["old"] is None and row["new"] == (1, "n1") and "more" not in row.asDict()


def stream_rows(spark, path):
    out = []
    q = stream_positions(spark, path, IMAGE).writeStream.foreachBatch(lambda df, i: out.extend(df.collect())).trigger(availableNow=True)
    q.option("checkpointLocation", tempfile.mkdtemp(prefix="rivulet-cp-")).start().awaitTermination()
    return out


def test_runs_go_on_at_their_position_and_holes_stop_them(spark, path):
    checkpoint = "file://" + tempfile.mkdtemp(prefix="rivulet-cp-")
    counters = metrics.Counters()
    spark.streams.addListener(counters)
    try:
        e = engine(spark)
        for part in ([1, 2], [3]):
            append_segments(changes(spark, part), path)
            e.start(stream_positions(spark, path, IMAGE), checkpoint).awaitTermination()
            trim_segments(spark, path, 3)
        assert [r["commit_lsn"] for r in e.sinks[0].records] == [1, 2, 3]
        for part in ([4], [5]):
            append_segments(changes(spark, part), path)
        trim_segments(spark, path, 4)
        with pytest.raises(Exception, match="behind 3 up to 4"):
            e.start(stream_positions(spark, path, IMAGE), checkpoint).awaitTermination()
        with pytest.raises(Exception, match="state store"):
            e.start(stream_positions(spark, path, IMAGE, on_hole="snapshot"), checkpoint).awaitTermination()
        assert len(e.sinks[0].records) == 3
        state = StateStore(spark, "file://" + tempfile.mkdtemp(prefix="rivulet-state-"))
        e = engine(spark, state=state, purge_on_gap=True)
        e.start(stream_positions(spark, path, IMAGE, on_hole="snapshot"), checkpoint).awaitTermination()
        row = state.load("backfill")["app.items"]
        assert row["status"] == "requested" and row["purge"] and e.totals["gaps"] == 1
        assert [r["commit_lsn"] for r in e.sinks[0].records] == [5]
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(counters)
    assert counters.gauges == {"log.position": 5, "log.behind": 0} and counters.totals["failures"] == 2
    assert counters.seconds["triggerExecution"].count == counters.totals["batches"] >= 3


def test_metrics_need_no_jobs(spark):
    def jobs(**more):
        group = f"metrics-{more}"
        spark.sparkContext.setJobGroup(group, group)
        e = engine(spark, **more)
        try:
            e.process(changes(spark, range(1, 40)), 0)
            return e, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    plain, measured = jobs(), jobs(measure=True)
    assert plain[1] == measured[1] > 0
    e = measured[0]
    assert e.totals["changes.received"] == e.totals["sink.records.delivered.docs"] == 39
    assert e.seconds["ingestion.lag"].count == 0 and e.seconds["sink.delivery.duration"].count == 1
    assert set(e.delivery_lag()) == {"docs"}


def test_empty_batches_are_measured(spark):
    e = engine(spark, measure=True)
    e.process(changes(spark, []), 0)
    e.process(changes(spark, [1]).where("false"), 1)
    assert e.totals["changes.received"] == 0 and e.totals["batches"] == 2


def test_lag_of_commits(spark):
    e = engine(spark, measure=True)
    rows = changes(spark, range(1, 6)).withColumn("commit_ts", F.expr("cast(current_timestamp() - make_interval(0, 0, 0, 0, 0, 0, (commit_lsn - 1) * 100) as timestamp_ntz)"))
    e.process(rows.withColumn("commit_ts", F.when(F.col("commit_lsn") < 5, F.col("commit_ts"))), 0)
    lag = e.seconds["ingestion.lag"]
    assert lag.count == 4 and 600 <= lag.total < 700 and 300 <= lag.greatest < 330
    assert lag.quantile(0.5) == 300 and lag.quantile(1) == lag.greatest


def test_histograms():
    h = metrics.Histogram()
    assert h.count == 0 and h.quantile(0.5) == 0
    for x in (0.005, 0.01, 0.2, 90_000):
        h.add(x)
    assert h.counts[0] == 2 and h.counts[3] == 1 and h.counts[-1] == 1
    assert (h.quantile(0.5), h.quantile(0.75), h.quantile(1.0)) == (0.01, 0.5, 90_000)
