"""Queries that run the whole engine into a table, each with its SQL twin.

Each takes a folder of its own below the shared one for the table, the state and what waits."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Binding, Mapping, Model, Options, TableSpec
from ..operators.materialise import with_record
from ..sinks import Batch, TableSink, VectorSink
from ..sinks.dispatch import dispatch
from ..sources import changelog
from ..sources.positions import append_segments, stream_positions, trim_segments
from ..storage import materialise, shared_dir
from ..streaming.backfill import Backfiller
from ..streaming.driver import Engine
from ..streaming.windows import TokenWindows
from .control import StateStore
from .queries import CL, ORACLES, TXN, _t, query


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/rivulet-work/delivery-{uuid.uuid4().hex}"


def _log(rows: DataFrame, table: str, image: T.StructType, **columns) -> DataFrame:
    """Rows as log records: `columns` gives what isn't null."""
    known = {"schema": F.lit("app"), "table": F.lit(table)} | columns
    return rows.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in changelog.log_schema(image)])


NAMED = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("ref", T.LongType())])


def _named(live: DataFrame) -> DataFrame:
    return live.select("doc_key", F.col("record.name").alias("document"))


def _model(*tables: str) -> Model:
    model = Model()
    for t in tables:
        model.add(TableSpec("app", t, NAMED, ("id",)))
    model.map(Mapping(f"app.{tables[0]}", "table", _named, destination="d"))
    return model


def _image(*columns: Column) -> Column:
    return F.struct(*[c.cast(f.dataType).alias(f.name) for c, f in zip(columns, NAMED, strict=True)])


@query("engine_protocol_log", f"""WITH {TXN} SELECT CAST(r.user_id AS VARCHAR) AS id, r.event_type AS document FROM alive a JOIN raw r ON r.xid = a.xid AND r.seq = a.seq AND r.kind = 'change'
QUALIFY row_number() OVER (PARTITION BY r.user_id ORDER BY a.commit_lsn DESC, r.seq DESC) = 1""")  # fmt: skip
def _(spark, d):
    raw = changelog.transaction_log(spark, d)
    image = _image(F.col("user_id"), F.col("event_type"), F.lit(None))
    log = materialise(_log(raw, "users", NAMED, **{c: F.col(c) for c in ("kind", "seq", "xid", "subxid")}, action=F.lit("update"), new=F.when(F.col("kind") == "change", image)), "log")
    folder = _folder(spark)
    sink = TableSink(spark, f"{folder}/table")
    engine = Engine(spark, _model("users"), [sink], work=f"{folder}/work")
    # the cut goes through open transactions, which wait for their end
    middle = log.agg(F.max("seq")).first()[0] // 2
    for n, part in enumerate((log.where(F.col("seq") < middle), log.where(F.col("seq") >= middle))):
        engine.process(part, n)
    return sink.read().select("id", "document")


class _Faulty:
    """A sink that refuses one of its backfill's batches."""

    def __init__(self, sink: TableSink, number: int) -> None:
        self.sink, self.name, self.number = sink, sink.name, number

    def deliver(self, records: DataFrame, batch: Batch) -> str:
        if batch.scope.startswith("backfill") and batch.number == self.number:
            return "permanent"
        return self.sink.deliver(records, batch)


@query("spilled_transactions", ORACLES["engine_protocol_log"])
def _(spark, d):
    """The same records in batches of a few transactions' length each, so most stay open over several: each
    record of an open one is kept once, and read again when its transaction commits."""
    raw = changelog.transaction_log(spark, d)
    image = _image(F.col("user_id"), F.col("event_type"), F.lit(None))
    log = materialise(_log(raw, "users", NAMED, **{c: F.col(c) for c in ("kind", "seq", "xid", "subxid")}, action=F.lit("update"), new=F.when(F.col("kind") == "change", image)), "log")
    folder, parts = _folder(spark), 4
    sink = TableSink(spark, f"{folder}/table")
    engine = Engine(spark, _model("users"), [sink], work=f"{folder}/work")
    end = (log.agg(F.max("seq")).first()[0] or 0) + 1
    cuts = [0, *(end * k // parts + 37 for k in range(1, parts)), end]
    for n, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        engine.process(log.where((F.col("seq") >= low) & (F.col("seq") < high)), n)
    return sink.read().select("id", "document")


@query("token_windows", f"""WITH {CL}, h AS (SELECT max(event_id) AS top FROM events), w AS (SELECT k, (SELECT top FROM h) * k // 8 AS low, (SELECT top FROM h) * (k + 3) // 8 AS high FROM range(0, 5) t(k)),
c AS (SELECT DISTINCT k, user_id, low, high FROM events, w WHERE user_id % 5 = k)
SELECT CAST(k AS BIGINT) AS chunk, CAST(user_id AS VARCHAR) AS id FROM c WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.user_id AND e.event_id > low AND e.event_id < high)""")  # fmt: skip
def _(spark, d):
    """Five overlapping windows of one table over a log in four batches, the engine's state made anew between
    them: of each chunk the keys that no change inside its window had."""
    e = _t(spark, d, "events").select("event_id", F.col("user_id").cast("long").alias("user_id"))
    top = e.agg(F.max("event_id")).first()[0] or 0
    folder, due = _folder(spark), []
    bounds = {k: (top * k // 8, top * (k + 3) // 8) for k in range(5)}
    for k in bounds:
        TokenWindows(spark, f"{folder}/windows").keep(f"t{k}", "app.users", e.where(F.col("user_id") % 5 == k).select(F.col("user_id").cast("string").alias("doc_key")).distinct())
    tokens = spark.createDataFrame([(kind, at, f"t{k}") for k, two in bounds.items() for kind, at in zip(("watermark_low", "watermark_high"), two, strict=True)], "kind string, seq long, token string")
    keys = e.select(F.lit("app.users").alias("table"), F.col("user_id").cast("string").alias("doc_key"), F.col("event_id").alias("pos"))
    for n in range(4):
        low, high = top * n // 4 - (n == 0), top * (n + 1) // 4
        inside = lambda c: (F.col(c) > low) & (F.col(c) <= high)  # noqa: B023, E731
        found = TokenWindows(spark, f"{folder}/windows").passed(tokens.where(inside("seq")), keys.where(inside("pos")), n)
        due += [rows.select(F.lit(int(t[1:])).cast("bigint").alias("chunk"), F.col("doc_key").alias("id")) for t, (_, rows) in found.items()]
    return reduce(DataFrame.unionByName, due)


@query("delivery_mix", """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS document FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT 'live' || c_custkey, 'live' FROM customer WHERE c_custkey % 7 = 0""")  # fmt: skip
def _(spark, d):
    """Live, a backfill that breaks off, a restart that resumes it, an old batch again, live."""
    customers = _t(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("long").alias("ref"))
    folder = _folder(spark)
    options = Options(backfill_chunk=max(1, min(100_000, customers.count() // 4)))

    def engine(broken: bool) -> tuple[Engine, Backfiller]:
        sink = TableSink(spark, f"{folder}/table")
        e = Engine(spark, _model("customer"), [_Faulty(sink, 2) if broken else sink], options=options)
        return e, Backfiller(e, StateStore(spark, f"{folder}/state"), {"app.customer": lambda: customers}, chunks_per_step=1)

    def live(e: Engine, batch: Batch, rows: DataFrame, deleted: bool) -> None:
        ident = F.col("id").cast("string") if deleted else F.concat(F.lit("live"), "id")
        document = F.lit(None).cast("string") if deleted else F.lit("live")
        dispatch(_records(rows, "table", ident, document), e.sinks, batch)

    e, fill = engine(True)
    for n in range(3):
        live(e, Batch(n, "live", "one"), customers.where(F.col("id") % 21 == 7 * n), False)
    fill.run_due()
    e, fill = engine(False)
    live(e, Batch(1, "live", "one"), customers, True)  # an old batch, which changes nothing
    fill.run("app.customer", fill.decide("app.customer", None))
    live(e, Batch(3, "live", "one"), customers.where("id % 5 = 0"), True)
    return e.sinks[0].read().select("id", "document")


def _records(rows: DataFrame, sink: str, ident: Column, document: Column) -> DataFrame:
    """Sink records as the router makes them."""
    return rows.select(
        F.lit(sink).alias("sink"), F.lit("d").alias("destination"), ident.alias("document_id"), document.isNull().alias("is_deletion"), document.alias("document"), F.lit("app").alias("schema"), F.lit("t").alias("table"),
        F.when(document.isNull(), "delete").otherwise("update").alias("action"), F.lit(None).cast("timestamp_ntz").alias("commit_ts"), F.lit(1).cast("decimal(20,0)").alias("commit_lsn"), F.lit(0).alias("commit_idx"), F.lit(False).alias("is_backfill"), F.lit(None).cast("string").alias("backfill_run_id"),
    )


@query("fanout_queue_drained", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS document FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)")
def _(spark, d):
    """Every nation changes: more lookups than a chunk, so nothing is inline and the queue is drained."""
    customers = _t(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("ref"))
    folder = _folder(spark)
    sink, state = TableSink(spark, f"{folder}/table"), StateStore(spark, f"{folder}/state")
    model = _model("customer", "nation")
    model.bind(Binding("app.nation", "app.customer", (("id", "ref"),)))
    engine = Engine(spark, model, [sink], current={"app.customer": lambda: customers}, state=state, work=f"{folder}/work", options=Options(fanout_chunk=10))
    image = _image(F.col("n_nationkey"), F.col("n_name"), F.lit(None))
    log = _log(_t(spark, d, "nation"), "nation", NAMED, kind=F.lit("change"), commit_lsn=F.col("n_nationkey") + 1, commit_idx=F.lit(0), action=F.lit("update"), new=image, old=image)
    engine.process(log, 0)
    Backfiller(engine, state, {"app.customer": lambda: customers}, chunks_per_step=None).drain_fanout()
    return sink.read().select("id", "document")


@query("fanout_page_and_queue", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS document, c_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 5) AS inline FROM customer WHERE c_nationkey = 3")
def _(spark, d):
    """One nation changes: the first rows go at once, the whole scope later."""
    customers = _t(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("ref"))
    folder = _folder(spark)
    sink, state = TableSink(spark, f"{folder}/table"), StateStore(spark, f"{folder}/state")
    model = _model("customer", "nation")
    model.bind(Binding("app.nation", "app.customer", (("id", "ref"),)))
    engine = Engine(spark, model, [sink], current={"app.customer": lambda: customers}, state=state, work=f"{folder}/work", options=Options(max_batch_size=5))
    image = _image(F.lit(3), F.lit("n"), F.lit(None))
    engine.process(_log(spark.range(1), "nation", NAMED, kind=F.lit("change"), commit_lsn=F.lit(1), commit_idx=F.lit(0), action=F.lit("update"), new=image, old=image), 0)
    page = materialise(sink.read().select("id"), "page")
    Backfiller(engine, state, {"app.customer": lambda: customers}, chunks_per_step=None).drain_fanout()
    now = sink.read().select("id", "document")
    return now.join(page.withColumn("inline", F.lit(True)), "id", "left").withColumn("inline", F.coalesce("inline", F.lit(False)))


@query("vector_store", """SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS dimensions, round(CAST(embedding[1] AS DOUBLE), 4) AS first, CAST(CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END AS BIGINT) AS label
FROM embeddings WHERE vec_id % 4 <> 1""")  # fmt: skip
def _(spark, d):
    """Vectors that come with their documents: stored apart, some updated, some deleted."""
    e = _t(spark, d, "embeddings")
    size = len(e.select("embedding").first()[0])
    sink = VectorSink(spark, f"{_folder(spark)}/vectors", size, vector_field="vec")
    document = F.to_json(F.struct(F.col("label"), F.col("embedding").alias("vec")))
    sink.deliver(_records(e, "vectors", F.col("vec_id").cast("string"), document), Batch(0))
    changed = F.to_json(F.struct(F.lit(-1).alias("label"), F.col("embedding").alias("vec")))
    later = F.when(F.col("vec_id") % 4 == 1, None).when(F.col("vec_id") % 3 == 0, changed).otherwise(document)
    sink.deliver(_records(e, "vectors", F.col("vec_id").cast("string"), later), Batch(1))
    return sink.read().select("id", F.size("embedding").cast("bigint").alias("dimensions"), F.round(F.col("embedding")[0].cast("double"), 4).alias("first"), F.get_json_object("document", "$.label").cast("bigint").alias("label"))


@query("embedded_store", """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN coalesce(text, '') = '' THEN NULL ELSE CAST(length(text) AS BIGINT) END AS first,
CASE WHEN coalesce(text, '') = '' THEN NULL ELSE base64(unhex(sha256('1' || chr(10) || text))) END AS text_hash FROM documents WHERE doc_id % 6 <> 0""")  # fmt: skip
def _(spark, d):
    """Texts that are embedded once: the second delivery repeats all and deletes some."""

    def embedder(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), 0.0] for t in texts]

    docs = _t(spark, d, "documents")
    sink = VectorSink(spark, f"{_folder(spark)}/vectors", 2, embedder, "text")
    document = F.to_json(F.struct("text", "lang"))
    sink.deliver(_records(docs, "vectors", F.col("doc_id").cast("string"), document), Batch(0))
    sink.deliver(_records(docs, "vectors", F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 6 != 0, document)), Batch(1))
    return sink.read().select("id", F.col("embedding")[0].cast("bigint").alias("first"), "text_hash")


# ---- logs and declarations ---------------------------------------------------------------


@query("log_partitions", f"WITH {CL} SELECT action, count(*) AS n, min(commit_lsn) AS first_lsn, max(commit_lsn) AS last_lsn FROM cl GROUP BY action")
def _(spark, d):
    """Two tables' logs in one folder by table; a filter on the table reads its files alone."""
    folder = f"{_folder(spark)}/log"
    e = changelog.events_log(spark, d)
    users = _log(e, "users", _users(), **{c: F.col(c) for c in ("kind", "seq", "commit_lsn", "commit_idx", "commit_ts", "action", "new", "old")})
    other = _log(_t(spark, d, "nation"), "nations", _users(), kind=F.lit("change"), commit_lsn=F.lit(0), action=F.lit("insert"))
    users.unionByName(other).write.partitionBy("table").parquet(folder)
    rows = changelog.read_log(spark, folder, _users()).where("table = 'users'")
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.min("commit_lsn").cast("bigint").alias("first_lsn"), F.max("commit_lsn").cast("bigint").alias("last_lsn"))


def _users() -> T.StructType:
    s = T.StringType()
    return T.StructType([T.StructField(n, t) for n, t in (("user_id", T.LongType()), ("event_type", s), ("value", T.DoubleType()), ("props", s))])


@query("modelled_only", "SELECT 'app.customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'app.nation', count(*) FROM nation")
def _(spark, d):
    """Rows of tables that the model doesn't have are skipped."""
    parts = [_log(_t(spark, d, t), t, NAMED, kind=F.lit("change")) for t in ("customer", "nation", "region", "supplier")]
    log = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return changelog.only_modelled(log, ["app.customer", "app.nation"]).groupBy(F.concat_ws(".", "schema", "table").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("published_columns", """SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS reason FROM supplier
UNION ALL SELECT s_suppkey, NULL, 'full identity covers every column' FROM supplier""")  # fmt: skip
def _(spark, d):
    """What a mapping consumes and the key; everything, with a reason, where identity needs it."""
    s = _t(spark, d, "supplier")
    out = []
    for full in (False, True):
        m = Model()
        m.add(TableSpec("app", "supplier", s.schema, ("s_suppkey",), full_identity=full))
        m.map(Mapping("app.supplier", "docs", _named, consumes=("s_name",)))
        columns, reason = m.published_columns("app.supplier")
        chosen = s.select(*columns) if columns else s.select("s_suppkey", F.lit(None).cast("string").alias("s_name"))
        out.append(chosen.withColumn("reason", F.lit(reason).cast("string")))
    return out[0].unionByName(out[1])


@dataclass
class PartSupply:
    """A table by its fields: two marked as key, one with a column name of its own."""

    partKey: int = field(metadata={"key": 1})  # noqa: N815
    lineNumber: int = field(metadata={"key": 0})  # noqa: N815
    HTTPStatus: str = ""  # noqa: N815
    quantity: float = field(default=0.0, metadata={"column": "qty"})


@query("declared_table", "SELECT l_linenumber || '|' || l_partkey AS doc_key, l_partkey AS part_key, l_linenumber AS line_number, l_returnflag AS http_status, l_quantity AS qty FROM lineitem")
def _(spark, d):
    """Columns and key that follow from a dataclass."""
    spec = TableSpec.from_dataclass(PartSupply, "app")
    li = _t(spark, d, "lineitem")
    given = {"part_key": "l_partkey", "line_number": "l_linenumber", "http_status": "l_returnflag", "qty": "l_quantity"}
    image = F.struct(*[F.col(given[f.name]).cast(f.dataType).alias(f.name) for f in spec.columns.fields])
    log = _log(li, "part_supply", spec.columns, kind=F.lit("change"), commit_lsn=F.lit(1), action=F.lit("insert"), new=image)
    return with_record(log, spec).select("doc_key", "record.*")


@query("request_ids", "SELECT n_nationkey, 'msg_' || substr(sha256('hook' || chr(10) || n_name || chr(10) || n_nationkey), 1, 32) AS id FROM nation")
def _(spark, d):
    parts = F.concat_ws("\n", F.lit("hook"), "n_name", F.col("n_nationkey").cast("string"))
    return _t(spark, d, "nation").select("n_nationkey", F.concat(F.lit("msg_"), F.substring(F.sha2(parts, 256), 1, 32)).alias("id"))


@query("advisory_keys", """SELECT n_name, CAST(CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616 ELSE x END AS BIGINT) AS key
FROM (SELECT n_name, CAST(CAST('0x' || substr(sha256(n_name), 1, 16) AS UBIGINT) AS HUGEINT) AS x FROM nation)""")  # fmt: skip
def _(spark, d):
    # a signed base asks conv for the 64 bits as a signed number
    return _t(spark, d, "nation").select("n_name", F.conv(F.substring(F.sha2("n_name", 256), 1, 16), 16, -10).cast("bigint").alias("key"))


@query("table_versions", """SELECT 'first' AS version, CAST(c_custkey AS VARCHAR) AS id, c_name AS document FROM customer
UNION ALL SELECT 'last', CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment ELSE c_name END FROM customer WHERE c_custkey % 10 <> 9""")  # fmt: skip
def _(spark, d):
    """A version that a lease holds beside the newest, with deliveries, merges and a vacuum in between."""
    c = _t(spark, d, "customer")
    sink, ident = TableSink(spark, f"{_folder(spark)}/versions", retain=0.0), F.col("c_custkey").cast("string")
    sink.FAN = 2
    sink.deliver(_records(c, "d", ident, F.col("c_name")), Batch(0))
    lease, first = sink.store.lease(3600.0)
    old = materialise(sink.read(first), "first")
    for n, document in enumerate((F.col("c_mktsegment"), F.lit(None).cast("string")), 1):
        sink.deliver(_records(c.where(F.col("c_custkey") % 10 == (0 if n == 1 else 9)), "d", ident, document), Batch(n))
    sink.vacuum()
    again = sink.read(first)
    both = again.join(old.select("id", "document"), ["id", "document"], "left_semi").select(F.lit("first").alias("version"), "id", "document")
    return both.unionByName(sink.read().select(F.lit("last").alias("version"), "id", "document"))


@query("pruned_lookup", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS document FROM customer WHERE c_custkey % 50 = 0")
def _(spark, d):
    """Stored rows of some ids, from the files whose ranges and Bloom filters may hold them."""
    c = _t(spark, d, "customer")
    sink = TableSink(spark, f"{_folder(spark)}/pruned")
    for n in range(3):
        sink.deliver(_records(c.where(F.col("c_custkey") % 3 == n), "d", F.col("c_custkey").cast("string"), F.col("c_name")), Batch(n))
    ids = c.where(F.col("c_custkey") % 50 == 0).select(F.lit("d").alias("destination"), F.col("c_custkey").cast("string").alias("id"))
    _, p = sink.store.list()
    return sink.store.rows(sink.store.holding(ids, p["runs"])).join(ids, ["destination", "id"], "left_semi").select("id", "document")


def _user_log(spark: SparkSession, d: str) -> DataFrame:
    return _log(changelog.events_log(spark, d), "users", _users(), **{c: F.col(c) for c in ("kind", "seq", "commit_lsn", "commit_idx", "commit_ts", "action", "new", "old")})


def _user_model() -> Model:
    model = Model()
    model.add(TableSpec("app", "users", _users(), ("user_id",)))
    model.map(Mapping("app.users", "table", lambda live: live.select("doc_key", F.col("record.event_type").alias("document")), destination="d"))
    return model


LAST_USERS = f"WITH {CL} SELECT CAST(user_id AS VARCHAR) AS id, event_type AS document FROM lastw WHERE action <> 'delete'"


#: Records of a log's file, which the task that writes it sorts.
FILE_ROWS = 250_000


def _log_files(rows: int, least: int = 3) -> int:
    return max(least, -(-rows // FILE_ROWS))


@query("engine_stream", f"WITH {CL} SELECT CAST(user_id AS VARCHAR) AS id, event_type AS document FROM lastw WHERE action <> 'delete'")
def _(spark, d):
    """The log as a stream of files, through a checkpoint, twice: the second run finds nothing new."""
    folder = _folder(spark)
    users, model = _user_log(spark, d), _user_model()
    files = _log_files(_t(spark, d, "events").count())
    users.repartitionByRange(files, "commit_lsn").sortWithinPartitions("commit_lsn").write.parquet(f"{folder}/log")
    sink = TableSink(spark, f"{folder}/table")
    for _ in range(2):
        # files of one write come in no order of positions, so one batch takes them all
        query_ = Engine(spark, model, [sink]).start(changelog.stream_log(spark, f"{folder}/log", _users(), files), f"{folder}/checkpoint")
        query_.awaitTermination()
    return sink.read().select("id", "document")


def _thirds(log: DataFrame) -> list[DataFrame]:
    """The log in three parts of about as many positions."""
    part = F.least(F.floor(F.col("commit_lsn") * 3 / F.lit(log.agg(F.max("commit_lsn") + 1).first()[0])), F.lit(2))
    return [log.where(part == i) for i in range(3)]


@query("engine_positions", LAST_USERS)
def _(spark, d):
    """The log as a stream of positions: appended in three parts, each taken by a run of its own; what was read
    is deleted from the log, which the next run doesn't miss."""
    folder, model = _folder(spark), _user_model()
    sink = TableSink(spark, f"{folder}/table")
    for part in _thirds(_user_log(spark, d)):
        _, end = append_segments(part, f"{folder}/log", _log_files(part.count(), 8))
        Engine(spark, model, [sink]).start(stream_positions(spark, f"{folder}/log", _users()), f"{folder}/checkpoint").awaitTermination()
        trim_segments(spark, f"{folder}/log", end)
    return sink.read().select("id", "document")


@query("log_hole_repair", LAST_USERS)
def _(spark, d):
    """The middle of the log is deleted before it was read: the stream finds the hole, the engine asks for a backfill
    with purge, and the table is that of the whole log again."""
    folder, model = _folder(spark), _user_model()
    sink, state = TableSink(spark, f"{folder}/table"), StateStore(spark, f"{folder}/state")
    log = _user_log(spark, d)
    engine = Engine(spark, model, [sink], state=state, purge_on_gap=True)

    def run() -> None:
        engine.start(stream_positions(spark, f"{folder}/log", _users(), on_hole="snapshot"), f"{folder}/checkpoint").awaitTermination()

    first, *rest = _thirds(log)
    append_segments(first, f"{folder}/log", _log_files(first.count(), 8))
    run()
    for part in rest:
        append_segments(part, f"{folder}/log", _log_files(part.count(), 8))
    trim_segments(spark, f"{folder}/log", 1 << 62)
    run()
    newest = log.groupBy(F.coalesce("new.user_id", "old.user_id").alias("user")).agg(F.max_by(F.struct("action", "new"), F.struct("commit_lsn", "commit_idx")).alias("l"))
    present = newest.where("l.action <> 'delete'").select("l.new.*")
    Backfiller(engine, state, {"app.users": lambda: present}, chunks_per_step=None).run_due()
    return sink.read().select("id", "document")


@query("observed_metrics", f"""WITH {CL} SELECT count(*) AS received, count(DISTINCT user_id) AS delivered, count(commit_ts) AS lags,
CAST(count_if(commit_ts <= TIMESTAMP '2026-01-01') AS BIGINT) AS lags_over_a_day FROM cl""")
def _(spark, d):
    """What the engine counted while it delivered the log, without jobs of its own."""
    engine = Engine(spark, _user_model(), [TableSink(spark, f"{_folder(spark)}/table")], measure=True)
    engine.process(_user_log(spark, d), 0)
    lag = engine.seconds["ingestion.lag"]
    row = (int(engine.totals["changes.received"]), int(engine.totals["sink.records.delivered.table"]), lag.count, lag.counts[-1])
    return spark.createDataFrame([row], "received long, delivered long, lags long, lags_over_a_day long")
