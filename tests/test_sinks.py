"""Sinks of outside systems over recording transports, tables and vectors over folders."""

import gzip
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from rivulet.functions.ids import webhook_signatures
from rivulet.sinks import Batch, BulkSink, HttpSink, IndexSink, KafkaSink, Request, Response, TableSink, VectorSink
from rivulet.sinks.remote import grade


class Recorder:
    """Writes every request to a folder, since tasks run in other processes, and answers by rule."""

    def __init__(self, folder, answer):
        self.folder, self.answer = str(folder), answer
        os.makedirs(self.folder, exist_ok=True)

    def __call__(self, request):
        with open(f"{self.folder}/{uuid.uuid4().hex}.json", "w") as f:
            json.dump({"method": request.method, "url": request.url, "body": request.body.hex(), "headers": request.headers, "at": len(os.listdir(self.folder))}, f)
        return self.answer(request)

    def seen(self):
        out = []
        for n in os.listdir(self.folder):
            with open(f"{self.folder}/{n}") as f:
                r = json.load(f)
            out.append(r | {"body": bytes.fromhex(r["body"])})
        return sorted(out, key=lambda r: r["at"])


def fine(request):
    return Response(200)


def records(spark, rows, destination="d"):
    """rows: (id, document or None for a deletion), in commit order."""
    full = [("s", destination, str(i), doc is None, doc, "app", "items", "delete" if doc is None else "update", None, n + 1, 0, False, None) for n, (i, doc) in enumerate(rows)]
    return spark.createDataFrame(full, "sink string, destination string, document_id string, is_deletion boolean, document string, schema string, table string, action string, commit_ts timestamp_ntz, commit_lsn long, commit_idx int, is_backfill boolean, backfill_run_id string")


def test_grades():
    assert [grade(s) for s in (200, 204, 301, 400, 404, 408, 429, 500, 503)] == [0, 0, 2, 2, 2, 1, 1, 1, 1]


def test_http_chunks_signs_and_compresses(spark, tmp_path):
    secret = "whsec_" + "MDEyMzQ1Njc4OWFiY2RlZg=="
    wire = Recorder(tmp_path / "w", fine)
    sink = HttpSink("s", "http://x/hook", wire, (secret,), per_request=3, compress=True, parts=1, clock=lambda: 1000.5)
    rows = [(i, json.dumps({"v": i})) for i in range(7)] + [(7, None)]
    assert sink.deliver(records(spark, rows), Batch(0)) == "success"
    seen = wire.seen()
    bodies = [gzip.decompress(r["body"]) for r in seen]
    assert [len(json.loads(b)["records"]) for b in bodies] == [3, 3, 2]
    ids = [r["id"] for b in bodies for r in json.loads(b)["records"]]
    assert ids == [str(i) for i in range(8)] and "document" not in json.loads(bodies[2])["records"][1]
    for r, b in zip(seen, bodies, strict=True):
        assert r["headers"]["webhook-signature"] == webhook_signatures([secret], r["headers"]["webhook-id"], 1000, b)
    assert sink.deliver(records(spark, rows), Batch(0)) == "success"
    assert [r["headers"]["webhook-id"] for r in wire.seen()[3:]] == [r["headers"]["webhook-id"] for r in seen]


def test_http_stops_a_part_at_the_first_failure(spark, tmp_path):
    wire = Recorder(tmp_path / "w", lambda r: Response(503 if b'"id":"3"' in r.body else 200))
    sink = HttpSink("s", "http://x", wire, per_request=2, parts=1)
    assert sink.deliver(records(spark, [(i, "{}") for i in range(8)]), 0) == "retryable" and len(wire.seen()) == 2
    assert HttpSink("s", "http://x", lambda r: Response(302), parts=1).deliver(records(spark, [(1, "{}")]), 0) == "permanent"

    def late(request):
        raise TimeoutError

    assert HttpSink("s", "http://x", late, parts=1).deliver(records(spark, [(1, "{}")]), 0) == "retryable"
    assert HttpSink("s", "http://x", late, parts=1).deliver(records(spark, []), 0) == "success"


def test_a_retry_sends_what_was_not_accepted(spark, tmp_path):
    down = tmp_path / "down"
    down.write_text("")
    wire = Recorder(tmp_path / "w", lambda r: Response(503 if down.exists() and b'"id":"5"' in r.body else 200))
    sink = HttpSink("s", "http://x", wire, per_request=2, parts=1)
    rows = records(spark, [(i, "{}") for i in range(9)])
    assert sink.deliver(rows, Batch(3)) == "retryable" and len(wire.seen()) == 3
    assert sink.deliver(rows, Batch(3)) == "retryable" and len(wire.seen()) == 4  # the third again, none before it
    down.unlink()
    assert sink.deliver(rows, Batch(3)) == "success"
    sent = [[r["id"] for r in json.loads(x["body"])["records"]] for x in wire.seen()[4:]]
    assert sent == [["4", "5"], ["6", "7"], ["8"]]
    assert sink.deliver(rows, Batch(4)) == "success" and len(wire.seen()) == 12 and not sink._ledger


def test_errors_are_graded_in_the_task(spark, tmp_path):
    def answer(request):
        if b'"id":"2"' in request.body:
            raise KeyError("a bug of the transport")
        return Response(200)

    wire = Recorder(tmp_path / "w", answer)
    assert HttpSink("s", "http://x", wire, per_request=1, parts=1).deliver(records(spark, [(i, "{}") for i in range(5)]), 0) == "permanent"
    assert len(wire.seen()) == 3  # once, though Spark would try a failed task again

    def reset(request):
        raise OSError("broken pipe")

    assert HttpSink("s", "http://x", reset, parts=1).deliver(records(spark, [(1, "{}")]), 0) == "retryable"


@pytest.mark.parametrize(("text", "want"), [("org.apache.kafka.common.errors.TimeoutException: Topic t not present", True), ("org.apache.kafka.common.errors.RecordTooLargeException: too large", False), ("java.net.ConnectException: refused", True)])
def test_topic_errors_of_the_writer(spark, text, want):
    def failing(df):
        # as Spark's writer fails: in a task, of which the driver gets the text
        df.select(F.raise_error(F.lit(text))).collect()

    sink = KafkaSink("s", writer=failing)
    if want:
        assert sink.deliver(records(spark, [(1, "{}")]), 0) == "retryable"
    else:
        with pytest.raises(Exception, match="too large"):
            sink.deliver(records(spark, [(1, "{}")]), 0)


def test_topics(spark, tmp_path):
    sink = KafkaSink("s", writer=lambda df: df.write.parquet(f"{tmp_path}/topic"))
    assert sink.deliver(records(spark, [(1, '{"a":1}'), (2, None)]), 0) == "success"
    got = {r["key"]: r["value"] for r in spark.read.parquet(f"{tmp_path}/topic").collect()}
    assert json.loads(got["1"])["document"] == {"a": 1} and got["2"] is None

    def down(df):
        raise ConnectionError

    assert KafkaSink("s", writer=down).deliver(records(spark, [(1, "{}")]), 0) == "retryable"


@pytest.mark.parametrize(("status", "want"), [(200, "success"), (429, "retryable"), (400, "permanent")])
def test_bulk_grades_each_item(spark, tmp_path, status, want):
    def answer(request):
        if request.url.endswith("refresh=true"):
            return Response(404 if "none" in request.url else 500 if "bad" in request.url else 200)
        lines = [json.loads(x) for x in request.body.decode().splitlines()]
        ops = [x for x in lines if "index" in x or "delete" in x]
        return Response(200, json.dumps({"items": [{"delete": {"status": 404}} if "delete" in x else {"index": {"status": status if x["index"]["_id"] == "5" else 201}} for x in ops]}).encode())

    wire = Recorder(tmp_path / "w", answer)
    sink = BulkSink("s", "http://x", wire, per_request=4)
    assert sink.deliver(records(spark, [(i, '{"v":1}') for i in range(9)] + [(9, None)]), 0) == want
    assert all(len([x for x in r["body"].splitlines() if b"_id" in x]) <= 4 for r in wire.seen())
    sink.purge("d")
    sink.purge("none")
    with pytest.raises(RuntimeError):
        sink.purge("bad")


def test_index_sends_upserts_first_and_waits(spark, tmp_path):
    def answer(request):
        if request.method == "GET":
            return Response(200, b'{"status":"failed","error":{"code":"index_not_found"}}' if request.url.endswith("/2") else b'{"status":"succeeded"}')
        return Response(202, b'{"taskUid":%d}' % (2 if "delete-batch" in request.url else 1))

    wire = Recorder(tmp_path / "w", answer)
    sink = IndexSink("s", "http://x", wire, key="pk", attributes=("a.b",), per_request=2, parts=1)
    rows = [(1, None), ("2|x", '{"a":{"b":null}}'), (3, '{"a":[{"b":1},{}]}'), ("é", '{"a":[]}')]
    assert sink.deliver(records(spark, rows), 0) == "success"
    posts = [r for r in wire.seen() if r["method"] == "POST"]
    assert ["delete-batch" in r["url"] for r in posts] == [False, False, True] and json.loads(posts[2]["body"]) == ["1"]
    assert [d["pk"] for r in posts[:2] for d in json.loads(r["body"])] == ["2_x", "3", "_ew6k"]
    with pytest.raises(Exception, match="has no a.b"):
        sink.deliver(records(spark, [(1, '{"a":1}')]), 0)
    failed = IndexSink("s", "http://x", lambda r: Response(200, b'{"status":"failed","taskUid":1}'))
    assert failed.deliver(records(spark, [(1, "{}")]), 0) == "permanent"
    slow = IndexSink("s", "http://x", lambda r: Response(200, b'{"status":"processing","taskUid":1}'), polls=2, poll_seconds=0)
    assert slow.deliver(records(spark, [(1, "{}")]), 0) == "retryable"


def test_one_index_is_sent_by_many_tasks(spark, tmp_path):
    wire = Recorder(tmp_path / "w", lambda r: Response(200, b'{"status":"succeeded"}' if r.method == "GET" else b'{"taskUid":1}'))
    sink = IndexSink("s", "http://x", wire, per_request=40, parts=6)
    many = [(i, '{"v":1}') for i in range(900)] + [(i, None) for i in range(900, 1000)]
    assert sink.frames(records(spark, many)).where("not deletion").select("part").distinct().count() == 6
    assert sink.deliver(records(spark, many), 0) == "success"
    posts = [r for r in wire.seen() if r["method"] == "POST"]
    deletes = [k for k, r in enumerate(posts) if "delete-batch" in r["url"]]
    assert deletes == list(range(len(posts) - len(deletes), len(posts)))  # behind all upserts
    assert sorted(int(d["id"]) for r in posts[: deletes[0]] for d in json.loads(r["body"])) == list(range(900))


def table(sink):
    return {r["id"]: r["document"] for r in sink.read().collect()}


def test_table_knows_batches_by_their_run(spark, tmp_path):
    sink = TableSink(spark, f"file://{tmp_path}/t")
    want = {}

    def put(rows, batch, counts=True):
        assert sink.deliver(records(spark, rows), batch) == "success"
        for i, doc in rows if counts else ():
            if doc is None:
                want.pop(str(i), None)
            else:
                want[str(i)] = doc
        assert table(sink) == want

    for n in range(5):
        put([(n, f"live {n}")], Batch(n, "live", "a"))
    put([(i, f"fill {i}") for i in range(10, 30)], Batch(0, "backfill:app.items", "r1"))
    put([(i, f"fill {i}") for i in range(30, 40)], Batch(1, "backfill:app.items", "r1"))
    put([(99, "again")], Batch(1, "backfill:app.items", "r1"), counts=False)
    put([(12, "resumed"), (13, None)], Batch(0, "backfill:app.items", "r2"))
    put([(1, None)], Batch(5, "live", "a"))
    put([(2, "old")], Batch(4, "live", "a"), counts=False)
    put([(3, "new checkpoint")], Batch(0, "live", "b"))
    again = TableSink(spark, f"file://{tmp_path}/t")
    assert table(again) == want
    assert again.deliver(records(spark, [(3, "x")]), Batch(0, "live", "b")) == "success" and table(again) == want


def test_table_merges_runs_and_purges(spark, tmp_path):
    sink = TableSink(spark, f"file://{tmp_path}/t")
    sink.FAN = 3
    want = {}
    for n in range(20):
        rows = [(n % 4, f"v{n}"), (100 + n, f"w{n}"), (100 + n - 2, None)]
        sink.deliver(records(spark, rows), n)
        for i, d in rows:
            want.pop(i, None) if d is None else want.__setitem__(i, d)
        if n == 10:
            sink.deliver(records(spark, [(1, "other")], "e"), Batch(n, "other"))
            sink.purge("d")
            want = {}
            assert table(sink) == {"1": "other"}
    rows = {(r["destination"], r["id"]): r["document"] for r in sink.read().collect()}
    assert rows == {("d", str(i)): d for i, d in want.items()} | {("e", "1"): "other"}
    _, p = sink.store.list()
    assert len(p["runs"]) <= 6 and max(r["level"] for r in p["runs"]) >= 2
    sink.vacuum(0)
    kept = {f["path"].split("/")[0] for f in sink.store.run_files(p["runs"])} | {r["name"] for r in p["runs"]}
    assert {n for n in os.listdir(tmp_path / "t") if n.startswith("run-") and not n.endswith("-bloom")} == kept
    assert {(r["destination"], r["id"]): r["document"] for r in sink.read().collect()} == rows


def test_a_held_reader_keeps_its_version(spark, tmp_path):
    now = [0.0]
    sink = TableSink(spark, f"file://{tmp_path}/t", retain=100.0, clock=lambda: now[0])
    sink.FAN = 2
    sink.deliver(records(spark, [(i, f"v{i}") for i in range(5)]), 0)
    first, taken = sink.version(), sink.read()
    lease, leased = sink.store.lease(1000.0)
    for n in range(1, 21):
        now[0] += 3.0
        sink.deliver(records(spark, [(n % 5, f"w{n}"), (100 + n, "x")]), n)
    old = {str(i): f"v{i}" for i in range(5)}
    assert {r["id"]: r["document"] for r in taken.collect()} == old  # within the time
    now[0] += 500.0
    assert sink.vacuum() > 0
    assert leased == first and {r["id"]: r["document"] for r in sink.read(first).collect()} == old
    assert {r["id"]: r["document"] for r in taken.collect()} == old  # by the lease
    sink.store.release(lease)
    sink.vacuum()
    with pytest.raises(LookupError):
        sink.read(first)
    assert len(table(sink)) == 25 and table(sink)["0"] == "w20"
    with sink.held() as v:
        sink.deliver(records(spark, [(0, None)]), 21)
        now[0] += 200.0
        sink.vacuum()
        assert len(sink.read(v).collect()) == 25 and len(table(sink)) == 24
    again = TableSink(spark, f"file://{tmp_path}/t")
    assert again.deliver(records(spark, [(7, "y")]), 21) == "success" and len(table(again)) == 24


def test_files_that_cannot_hold_the_ids_are_not_opened(spark, tmp_path):
    sink = VectorSink(spark, f"file://{tmp_path}/v", 1, lambda texts: [[float(len(t))] for t in texts], "text")
    doc = lambda i: json.dumps({"text": f"t{i}"})
    sink.FAN = 3
    for n in range(4):  # disjoint ranges: merged without rewriting
        before = {f["path"] for f in sink.store.run_files(sink.store.list()[1]["runs"])}
        sink.deliver(records(spark, [(f"{n}{i:03d}", doc(i)) for i in range(0, 60, 2)]), n)
        assert before <= {f["path"] for f in sink.store.run_files(sink.store.list()[1]["runs"])}
    _, p = sink.store.list()
    every = sink.store.run_files(p["runs"])
    ids = lambda *names: spark.createDataFrame([("d", x) for x in names], "destination string, id string")
    opened = lambda *names: {f["path"] for f in sink.store.holding(ids(*names), p["runs"])}
    assert len(every) >= 4 and len(opened("1004")) == 1 and opened("zzz", "0") == set()
    seldom = [len(opened(f"2{i:03d}")) for i in range(1, 41, 8)]  # in the range, but not there
    assert sum(seldom) <= 1
    for i in range(0, 60, 6):
        assert len(opened(f"3{i:03d}")) == 1
    stored = {r["id"] for r in sink._stored(ids("1004", "2001", "0010")).collect()}
    assert stored == {"1004", "0010"}


def test_nothing_is_left_in_the_work_folder(spark, tmp_path):
    from rivulet.storage import shared_dir

    def work():
        folder = f"{shared_dir(spark)}/rivulet-work".removeprefix("file://")
        return set(os.listdir(folder)) if os.path.isdir(folder) else set()

    sink = VectorSink(spark, f"file://{tmp_path}/v", 2, vector_field="vec")
    before = work()
    for n in range(3):
        sink.deliver(records(spark, [(n, '{"vec":[1,2],"n":1.0}')]), n)
    with pytest.raises(Exception, match="wrong size"):
        sink.deliver(records(spark, [(9, '{"vec":[1]}')]), 3)
    assert work() == before


def test_documents_keep_their_numbers_text(spark, tmp_path):
    sink = VectorSink(spark, f"file://{tmp_path}/v", 1, vector_field="vec")
    text = '{"a":1.0,"vec":[1],"b":0.1000,"c":{"d":2.50,"e":[1e3,"x"]},"f":"1.0","g":null,"h":true,"i \\"q":"\\n{}"}'
    sink.deliver(records(spark, [(1, text), (2, '{"vec":null}'), (3, '{"n":2.50}'), (4, '{ "vec" : [1] , "x":{"vec":[2]}, "n":2.50}'), (5, '{"x":{"vec":[2]}}'), (6, r'{"\u0076ec":[1], "n":1e3}')]), 0)
    got = table(sink)
    assert got["4"] == '{ "x":{"vec":[2]}, "n":2.50}' and got["5"] == '{"x":{"vec":[2]}}' and got["6"].replace(" ", "") == '{"n":1e3}'
    assert got["1"] == text.replace('"vec":[1],', "") and got["2"] == "{}" and got["3"] == '{"n":2.50}'


def test_vectors_are_gated_by_the_texts_hash(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def embedder(texts):
        (asked / uuid.uuid4().hex).write_text("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    sink = VectorSink(spark, f"file://{tmp_path}/v", 2, embedder, "text")
    doc = lambda text, n=0: json.dumps({"text": text, "n": n})
    sink.deliver(records(spark, [(1, doc("one")), (2, doc("three")), (3, doc("")), (4, doc("gone"))]), 0)
    sink.deliver(records(spark, [(1, doc("one", 5)), (2, doc("three")), (4, None), (5, None)]), 1)
    got = {r["id"]: (r["embedding"], json.loads(r["document"])["n"]) for r in sink.read().collect()}
    assert got == {"1": ([3.0, 1.0], 5), "2": ([5.0, 1.0], 0), "3": (None, 0)}
    assert sorted(t for f in asked.iterdir() for t in f.read_text().splitlines()) == ["gone", "one", "three"]
    _, p = sink.store.list()
    last = spark.read.parquet(f"{tmp_path}/v/{p['runs'][-1]['name']}")
    assert sorted((r["id"], r["is_deletion"]) for r in last.collect()) == [("1", False), ("4", True)]  # what stays the same isn't written


def test_the_gate_has_a_row_for_each_of_the_batch(spark):
    from rivulet.functions.ids import text_hash
    from rivulet.sinks.tables import embedding_gate

    batch = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, ""), (2, None), (3, "c"), (None, "a")], "id long, text string")
    stored = spark.createDataFrame([(1, "a"), (1, "a"), (1, "z"), (2, ""), (2, None), (3, "old"), (None, "a")], "id long, text string")
    got = embedding_gate(batch, stored.select("id", text_hash("v", F.col("text")).alias("text_hash")), "v")
    assert got.columns == ["id", "text", "text_hash", "step"]
    want = [(1, "a", "keep"), (1, "a", "keep"), (1, "b", "embed"), (2, "", "null"), (2, None, "null"), (3, "c", "embed"), (None, "a", "embed")]
    assert sorted(((r["id"], r["text"], r["step"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert got.where("text_hash is null").count() == 2


def test_vectors_that_come_with_the_document(spark, tmp_path):
    sink = VectorSink(spark, f"file://{tmp_path}/v", 2, vector_field="vec")
    sink.deliver(records(spark, [(1, '{"a":{"b":[1,"x"]},"vec":[0.5,2],"s":"t"}'), (2, '{"vec":null}')]), 0)
    got = {r["id"]: (r["embedding"], json.loads(r["document"])) for r in sink.read().collect()}
    assert got == {"1": ([0.5, 2.0], {"a": {"b": [1, "x"]}, "s": "t"}), "2": (None, {})}
    with pytest.raises(Exception, match="wrong size"):
        sink.deliver(records(spark, [(3, '{"vec":[1]}')]), 1)
    with pytest.raises(ValueError):
        VectorSink(spark, "x", 2)


def test_embedding_limits(spark, tmp_path):
    import time

    from rivulet.sinks.tables import embed

    flight = tmp_path / "flight"
    flight.mkdir()

    def slow(texts):
        mine = flight / uuid.uuid4().hex
        mine.write_text("")
        most = len(list(flight.iterdir()))
        time.sleep(0.05 if texts[0] != "hang" else 5)
        mine.unlink()
        return [[float(len(t)), float(most)] for t in texts]

    rows = spark.range(60).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).coalesce(1)
    got = embed(rows, slow, 2, batch=4, concurrency=3).collect()
    assert [r["id"] for r in got] == list(range(60)) and [r["embedding"][0] for r in got] == [len(f"t{i}") for i in range(60)]
    assert 2 <= max(r["embedding"][1] for r in got) <= 3
    sink = VectorSink(spark, f"file://{tmp_path}/v", 2, slow, "text", concurrency=2, timeout=0.5)
    assert sink.deliver(records(spark, [(1, '{"text":"hang"}')]), 0) == "retryable" and table(sink) == {}
    assert sink.deliver(records(spark, [(1, '{"text":"fine"}')]), 0) == "success" and list(table(sink)) == ["1"]
    wrong = VectorSink(spark, f"file://{tmp_path}/u", 3, slow, "text")
    with pytest.raises(Exception, match="wrong number or size"):
        wrong.deliver(records(spark, [(1, '{"text":"fine"}')]), 0)
