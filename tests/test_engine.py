import random

import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.model import Binding, Mapping, Model, Options, TableSpec
from rivulet.operators import assemble, collapse, fanout, materialise, route
from rivulet.plans.queries import QUERIES
from rivulet.sinks import Batch, CaptureSink, DelegateSink, DeliveryError, TableSink, dispatch
from rivulet.sinks.tables import embed
from rivulet.sources import changelog
from rivulet.streaming.driver import Engine

IMAGE = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("group", T.LongType())])
SPEC = TableSpec("app", "items", IMAGE, ("id",))
GROUPS = TableSpec("app", "groups", IMAGE, ("id",))


def change(lsn, idx, action, new=None, old=None, table="items", absent=()):
    return {"kind": "change", "seq": lsn * 10 + idx, "commit_lsn": lsn, "commit_idx": idx, "schema": "app", "table": table, "action": action, "new": new, "old": old, "unavailable_cols": list(absent)}


def log(spark, rows):
    schema = changelog.log_schema(IMAGE)
    from decimal import Decimal

    full = [tuple(Decimal(r["commit_lsn"]) if f.name == "commit_lsn" else r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(full, schema)


def to_name(live):
    return live.where("record.name is null or record.name != 'skip'").select("doc_key", F.col("record.name").alias("document"))


DOCS = Mapping("app.items", "docs", to_name, destination="d")


def records(spark, rows, mapping=DOCS):
    out = route.route(materialise.with_record(log(spark, rows), SPEC), [mapping]).collect()
    return {r["document_id"]: (r["is_deletion"], r["document"], int(r["commit_lsn"]), r["commit_idx"]) for r in out}


def test_last_change_wins_and_deletes_bypass(spark):
    rows = [change(1, 0, "insert", (1, "a", 0)), change(1, 1, "update", (1, "b", 0), (1, "a", 0)), change(2, 0, "insert", (2, "x", 0)), change(3, 0, "delete", None, (2, None, None)), change(3, 1, "insert", (3, "skip", 0)), change(3, 2, "insert", (4, None, 0))]
    assert records(spark, rows) == {"1": (False, "b", 1, 1), "2": (True, None, 3, 0), "3": (True, None, 3, 1), "4": (True, None, 3, 2)}


def test_custom_ids_collapse_again_and_may_move(spark):
    m = Mapping("app.items", "docs", to_name, destination="d", keyed_by=lambda r: F.col(f"{r}.group"))
    rows = [change(1, 0, "insert", (1, "a", 7)), change(1, 1, "insert", (2, "b", 7)), change(2, 0, "delete", None, (1, "a", 7))]
    assert records(spark, rows, m) == {"7": (True, None, 2, 0)}


def test_a_delete_without_the_custom_id_is_an_error(spark):
    m = Mapping("app.items", "docs", to_name, destination="d", keyed_by=lambda r: F.col(f"{r}.group"))
    with pytest.raises(Exception, match="full old image"):
        records(spark, [change(1, 0, "delete", None, (1, None, None))], m)


def test_null_keys_halt_and_unknown_tables_are_skipped(spark):
    with pytest.raises(Exception, match="null in the key"):
        records(spark, [change(1, 0, "insert", (None, "a", 0))])
    other = log(spark, [change(1, 0, "insert", (1, "a", 0), table="other")])
    assert changelog.only_modelled(other, ["app.items"]).count() == 0


def test_absent_is_not_null(spark):
    rows = [change(1, 0, "update", (1, None, 5), (1, "kept", 5), absent=["name"]), change(1, 1, "update", (2, None, 5), (2, "gone", 5)), change(1, 2, "update", (3, None, 5), None, absent=["name"])]
    e = {r["doc_key"]: (r["record"]["name"], r["unavailable_cols"]) for r in materialise.with_record(log(spark, rows), SPEC).collect()}
    assert e == {"1": ("kept", []), "2": (None, []), "3": (None, ["name"])}


def test_savepoints_apply_in_order(spark):
    def rec(seq, kind, sub=None, xid=1):
        return (kind, seq, xid, sub)

    # 2's rollback takes 3's rows with it, so 3's own rollback is a no-op; later rows stay
    rows = [rec(1, "change"), rec(2, "change", 2), rec(3, "change", 3), rec(4, "change"), rec(5, "sub_abort", 2), rec(6, "change"), rec(7, "sub_abort", 3), rec(8, "change", 3), rec(9, "commit"), rec(10, "change", None, 2), rec(11, "abort", None, 2), rec(12, "change", None, 3)]
    df = spark.createDataFrame(rows, "kind string, seq long, xid long, subxid long")
    assert sorted(r["seq"] for r in assemble.surviving(df).collect()) == [1, 6, 8]
    got = sorted((r["seq"], r["commit_lsn"], r["commit_idx"]) for r in assemble.assemble(df).collect())
    assert got == [(1, 9, 0), (6, 9, 1), (8, 9, 2)]


def test_savepoints_against_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["change"] * 6 + ["sub_abort"]), i, rnd.randint(1, 20), rnd.choice([None, 1, 2, 3])) for i in range(1500)]
    rows += [(rnd.choice(["commit", "commit", "abort"]), 2000 + x, x, None) for x in range(1, 21)]
    done, keep = {x for k, _, x, _ in rows if k == "commit"}, {}
    for k, seq, x, sub in rows:
        kept = keep.setdefault(x, [])
        if k == "change":
            kept.append((seq, sub))
        elif k == "sub_abort" and sub is not None:
            at = next((i for i, (_, s) in enumerate(kept) if s == sub), None)
            if at is not None:
                del kept[at:]
    want = sorted(seq for x, kept in keep.items() if x in done for seq, _ in kept)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "kind string, seq long, xid long, subxid long")
        assert sorted(r["seq"] for r in assemble.surviving(df).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("block", [assemble.BLOCK, 10, 13, 199])
def test_greedy_batches(spark, monkeypatch, block):
    monkeypatch.setattr(assemble, "BLOCK", block)
    rnd = random.Random(4)
    txns = [(i, rnd.randint(0, 9), rnd.random() < 0.1) for i in range(200)]
    want, batch, n, size, solo = [], -1, 99, 99, True
    for _, c, b in txns:
        if b or solo or n >= 5 or size >= 12:
            batch, n, size = batch + 1, 0, 0
        n, size, solo = n + 1, size + c, b
        want.append(batch)
    df = spark.createDataFrame(txns, "commit_lsn long, n_changes long, boundary boolean")
    got = [r["batch"] for r in assemble.batches(df, 5, 12).orderBy("commit_lsn").collect()]
    assert got == want


def test_slicing_does_not_change_documents(spark):
    rnd = random.Random(9)
    rows = [change(i + 1, 0, a := rnd.choice(["insert", "update", "delete"]), None if a == "delete" else (rnd.randint(1, 12), f"v{i}", 0), (rnd.randint(1, 12), "o", 0) if a == "delete" else None) for i in range(120)]

    def final(cuts):
        sink = CaptureSink("docs")
        model = Model()
        model.add(SPEC)
        model.map(DOCS)
        engine = Engine(spark, model, [sink])
        for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
            if a < b:
                engine.process(log(spark, rows[a:b]), n)
        return sink.latest()

    assert final([]) == final([40, 41, 90]) != {}


def test_stream_to_table_is_idempotent(spark, tmp_path):
    rows = [change(i + 1, 0, "update", (i % 5, f"v{i}", 0)) for i in range(40)]
    for k in range(4):
        log(spark, rows[k * 10 : k * 10 + 10]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    model = Model()
    model.add(SPEC)
    model.map(DOCS)
    sink = TableSink(spark, f"file://{tmp_path}/table")
    sink.name = "docs"
    engine = Engine(spark, model, [sink])
    for _ in range(2):  # a second run finds nothing new
        q = engine.start(changelog.stream_log(spark, f"{tmp_path}/log", IMAGE, 1), f"{tmp_path}/checkpoint")
        q.awaitTermination()
        assert q.exception() is None
    want = {str(i): f"v{35 + i}" for i in range(5)}
    assert {r["id"]: r["document"] for r in sink.read().collect()} == want
    again = route.route(materialise.with_record(log(spark, rows[:10]), SPEC), [DOCS])
    assert sink.deliver(again, Batch(3, "live", engine.run)) == "success"
    assert {r["id"]: r["document"] for r in sink.read().collect()} == want
    sink.purge("d")
    assert sink.read().count() == 0


def test_fanout_in_a_batch(spark):
    model = Model()
    model.add(SPEC)
    model.add(GROUPS)
    model.map(DOCS)
    model.bind(Binding("app.groups", "app.items", (("id", "group"),)))
    sink = CaptureSink("docs")
    now = spark.createDataFrame([(1, "one", 7), (2, "two", 7), (3, "three", 8)], IMAGE)
    engine = Engine(spark, model, [sink], current={"app.items": lambda: now})
    engine.process(log(spark, [change(1, 0, "update", (7, "g", 0), (7, "f", 0), "groups"), change(2, 0, "update", (2, "live", 7))]), 0)
    got = {k[1]: (r, ) for k, r in sink.latest().items()}
    assert got == {"1": ("one",), "2": ("live",)}


def test_lookup_keys_of_composite_bindings(spark):
    b = Binding("app.items", "app.x", (("id", "p"), ("group", "q")))
    rows = [change(1, 0, "update", (1, "n", 2), (1, "n", 3)), change(2, 0, "insert", (1, "n", 2)), change(3, 0, "delete", None, (4, "n", None))]
    assert sorted(tuple(r) for r in fanout.lookup_keys(log(spark, rows), b).collect()) == [(1, 2), (1, 3)]
    with pytest.raises(ValueError):
        Binding("a", "b", ())


def test_dispatch(spark):
    df = records_df(spark)
    calls, naps = [], []
    flaky = DelegateSink("docs", lambda r, b: calls.append(b) or ("retryable" if len(calls) < 3 else "success"))
    assert dispatch(df, [flaky], 5, Options(retry_attempts=4), naps.append) == {"docs": "success"}
    assert calls == [5, 5, 5] and len(naps) == 2
    seen = []
    bad = DelegateSink("docs", lambda r, b: 1 / 0)
    good = DelegateSink("other", lambda r, b: seen.append(r.count()))
    with pytest.raises(DeliveryError, match="permanent"):
        dispatch(df, [bad, good], 1)
    assert seen == [0]
    with pytest.raises(DeliveryError, match="retryable"):
        dispatch(df, [DelegateSink("docs", lambda r, b: "retryable")], 1, Options(retry_attempts=1), lambda s: None)


def records_df(spark):
    return route.route(materialise.with_record(log(spark, [change(1, 0, "insert", (1, "a", 0))]), SPEC), [DOCS])


def test_embedding(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(1, 8)], "id long, text string")
    got = {r["id"]: list(r["embedding"]) for r in embed(rows, lambda ts: [[float(len(t)), 1.0] for t in ts], 2, 3).collect()}
    assert got == {i: [float(i), 1.0] for i in range(1, 8)}
    with pytest.raises(Exception, match="wrong number or size"):
        embed(rows, lambda ts: [[1.0]] * len(ts), 2).collect()


def test_last_wins_keeps_one_row_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id as commit_lsn", "0 as commit_idx")
    plan = collapse.last_wins(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_ordered_items_holds_events_past_the_first_thousand(spark, tmp_path):
    rows = [(i, i % 7 if i < 1500 else 100 + i % 3, f"e{i % 5}") for i in range(900, 2100)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["ordered_group_items"](spark, str(tmp_path)).orderBy("first_position", "position").collect()
    first = {u: min(i for i, x, _ in rows if x == u) for _, u, _ in rows}
    assert [tuple(r) for r in got] == sorted(((u, first[u], i, e) for i, u, e in rows), key=lambda r: r[1:3])


def test_ordered_items_keeps_null_keys(spark):
    rows = spark.createDataFrame([(1, "a", 5, "x"), (None, "a", 3, "y"), (None, "a", 4, "z"), (1, None, 2, "w")], "k long, m string, p long, v string")
    got = collapse.ordered_items(rows, ["k", "m"], F.col("v"), "p").orderBy("first_position", "position").collect()
    assert [tuple(r) for r in got] == [(1, None, 2, 2, "w"), (None, "a", 3, 3, "y"), (None, "a", 3, 4, "z"), (1, "a", 5, 5, "x")]


def test_a_resource_is_held_for_a_scope(spark, tmp_path):
    """Scopes larger than a batch are streamed through one resource each, which is given back after errors too."""
    from rivulet.operators.route import leased

    def acquire(scope):
        (tmp_path / f"open-{scope}-{uuid.uuid4().hex}").write_text("")
        return {"scope": scope, "calls": 0}

    def release(resource):
        (tmp_path / f"closed-{resource['scope']}-{resource['calls']}-{uuid.uuid4().hex}").write_text("")

    def transform(resource, pdf):
        if (pdf["n"] < 0).any():
            raise RuntimeError("bad row")
        resource["calls"] += 1
        return pd.DataFrame({"doc_key": pdf["doc_key"], "document": [f"{resource['scope']}:{n}" for n in pdf["n"]]})

    names = lambda kind: sorted(f.name.split("-")[1] for f in tmp_path.iterdir() if f.name.startswith(kind))
    rows = spark.range(3000).select((F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string")))).alias("scope"), F.col("id").cast("string").alias("doc_key"), F.struct(F.col("id").alias("n")).alias("record"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        got = {r["doc_key"]: r["document"] for r in leased(transform, "doc_key string, document string", acquire, release)(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {str(i): f"{'s' + str(i % 3) if i % 3 else None}:{i}" for i in range(3000)}
    assert names("open") == names("closed") == ["None", "s1", "s2"]
    assert all(int(f.name.split("-")[2]) >= 4 for f in tmp_path.iterdir() if f.name.startswith("closed"))
    bad = rows.limit(5).withColumn("record", F.struct(F.lit(-1).cast("long").alias("n")))
    with pytest.raises(Exception, match="bad row"):
        leased(transform, "doc_key string, document string", acquire, release)(bad).collect()
    assert len(names("open")) == len(names("closed"))
