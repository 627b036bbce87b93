import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions import coerce, ids
from rivulet.model import Binding, Mapping, Model, Options, TableSpec, snake_case
from rivulet.plans import control
from rivulet.sinks.payloads import has_attribute


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_canonical_id(spark):
    assert one(spark, ids.canonical_id(F.lit("42"), F.lit("tenant-a"), F.lit(None).cast("string"))) == "42|tenant-a|"
    assert one(spark, ids.canonical_id(F.lit("a|b"))) == "a%7Cb"
    assert one(spark, ids.canonical_id(F.lit("100%"))) == "100%25"
    assert one(spark, ids.rendered(F.lit(bytes.fromhex("DEADBEEF")), T.BinaryType())) == "deadbeef"
    assert one(spark, ids.rendered(F.lit(2.0), T.DoubleType())) == "2"
    assert one(spark, ids.rendered(F.lit(True), T.BooleanType())) == "True"
    at = F.lit(datetime.datetime(2026, 7, 6, 1, 2, 3, 123000)).cast("timestamp_ntz")
    assert one(spark, ids.rendered(at, T.TimestampNTZType())) == "2026-07-06T01:02:03.1230000"


def test_split_id(spark):
    assert one(spark, ids.split_id(F.lit("a%7Cb|100%25|"))) == ["a|b", "100%", ""]
    with pytest.raises(Exception, match="invalid escape"):
        one(spark, ids.split_id(F.lit("a%41")))


def test_lookup_hash_has_its_pinned_value(spark):
    for order in (["[12]", "[1]", "[2]"], ["[2]", "[12]", "[1]", "[1]"]):
        got = one(spark, ids.lookup_hash("public.orders", ["tenant_id"], F.array(*map(F.lit, order))))
        assert got == "97FDE398E6842E8E045ED559069904BBF003FBB96FEA39BCBC638DC45274A779"


def test_index_ids(spark):
    cases = {"abc-1": "abc-1", "a|b": "a_b", "_x": "_e" + "X3g", "a||b": "_eYXx8Yg", "": "_e"}
    for raw, coded in cases.items():
        assert one(spark, ids.index_id(F.lit(raw))) == coded
        assert one(spark, ids.index_id_decoded(F.lit(coded), 2 if coded == "a_b" else 1)) == raw
    with pytest.raises(Exception, match="too long"):
        one(spark, ids.index_id(F.lit("x" * 512)))
    with pytest.raises(Exception, match="not an index id"):
        one(spark, ids.index_id_decoded(F.lit("a_b"), 3))
    long = "é" * 100
    assert one(spark, ids.index_id_decoded(ids.index_id(F.lit(long)), 1)) == long


def test_lsn(spark):
    assert str(one(spark, ids.lsn_number(F.lit("FFFFFFFF/FFFFFFFF")))) == str(2**64 - 1)
    assert one(spark, ids.lsn_text(F.lit("18446744073709551615").cast("decimal(20,0)"))) == "FFFFFFFF/FFFFFFFF"


def test_signatures():
    import base64

    key = "whsec_" + base64.b64encode(b"k" * 16).decode()
    both = ids.webhook_signatures([key, key], "msg_1", 5, b"{}")
    a, b = both.split(" ")
    assert a == b and a.startswith("v1,")
    with pytest.raises(ValueError):
        ids.webhook_signatures([base64.b64encode(b"short").decode()], "m", 1, b"")
    assert ids.message_id("s", ["a", "b"]) == ids.message_id("s", ["a", "b"]) != ids.message_id("s", ["b", "a"])
    assert len(ids.message_id("s", [])) == 36
    assert ids.advisory_key("x") == ids.advisory_key("x") != ids.advisory_key("y")


def test_coercion(spark):
    assert one(spark, coerce.to_type(F.lit("aGk="), T.StringType(), T.BinaryType())) == b"hi"
    assert one(spark, coerce.to_type(F.array(F.lit("1"), F.lit(None)), T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType()))) == [1, None]
    assert one(spark, coerce.enum_by_name(F.lit("PAID"), ["Pending", "Paid"])) == "Paid"
    assert one(spark, coerce.enum_by_name(F.lit(None).cast("string"), ["Pending"])) is None
    for bad in (coerce.enum_by_name(F.lit("x"), ["Pending"]), coerce.to_type(F.lit("x"), T.StringType(), T.IntegerType())):
        with pytest.raises(Exception):  # noqa: B017
            one(spark, bad)


def spec(name="t", key=("id",), **more):
    return TableSpec("app", name, T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))]), key, **more)


def test_model_rules():
    assert [snake_case(n) for n in ("HTTPStatus", "Line2Number", "OrderId", "already_snake")] == ["http_status", "line2number", "order_id", "already_snake"]
    for bad in ((), ("nope",), ("tags",)):
        with pytest.raises(ValueError):
            spec(key=bad)
    m = Model()
    m.add(spec())
    with pytest.raises(ValueError):
        m.add(spec())
    with pytest.raises(ValueError):
        Mapping("app.t", "s", lambda x: x, consumes=("a",), excludes=("b",))
    m.map(Mapping("app.t", "one", lambda x: x, consumes=("a",)))
    assert m.captured_columns("app.t") == ["id", "a"]
    with pytest.raises(ValueError):
        m.map(Mapping("app.t", "one", lambda x: x))
    m.map(Mapping("app.t", "two", lambda x: x, excludes=("tags",)))
    assert m.captured_columns("app.t") == ["id", "a", "b"]
    m.map(Mapping("app.t", "three", lambda x: x))
    assert m.captured_columns("app.t") == ["id", "a", "b", "tags"]
    m.map(Mapping("app.t", "four", lambda x: x, excludes=("id",)))
    with pytest.raises(ValueError):
        m.captured_columns("app.t")


def test_published_columns_and_exports():
    m = Model()
    m.add(spec())
    m.add(spec("full", full_identity=True))
    m.add(spec("parts", partitioned=True))
    m.add(spec("index", identity_index=("b",)))
    m.bind(Binding("app.t", "app.full", (("a", "a"),)))
    m.bind(Binding("app.t", "app.full", (("a", "a"),)))
    assert len(m.bindings) == 1
    assert m.published_columns("app.t") == (["id", "a"], None)
    assert all(m.published_columns(f"app.{n}")[0] is None for n in ("full", "parts", "index"))
    assert m.export_tables(exclude=["app.parts"]) == ["app.t", "app.full", "app.index"]
    with pytest.raises(ValueError):
        m.export_tables(["app.t"], ["app.full"])


def test_table_from_dataclass():
    from dataclasses import dataclass, field

    @dataclass
    class OrderLine:
        LineNo: int = field(metadata={"key": 2})
        OrderId: int = field(metadata={"key": 1})
        Sku: str = field(default="", metadata={"column": "sku_code"})

    t = TableSpec.from_dataclass(OrderLine)
    assert (t.table, t.primary_key, t.columns.fieldNames()) == ("order_line", ("order_id", "line_no"), ["line_no", "order_id", "sku_code"])

    @dataclass
    class Nothing:
        name: str

    with pytest.raises(ValueError):
        TableSpec.from_dataclass(Nothing)


def test_options():
    with pytest.raises(ValueError):
        Options(max_batch_size=0)
    with pytest.raises(ValueError):
        Options(max_transactions=10_001)


def test_control_step():
    step = control.control_step
    assert step("running", None, True) == ("suspend_requested", "configuration", "finalize")
    assert step("suspended", "client", False, 1e9) == ("suspended", "client", "idle")
    assert step("suspended", "configuration", False, 5) == ("suspended", "configuration", "idle")
    assert step("suspended", "configuration", False, 61) == ("running", None, "proceed")
    assert step("running", None, False) == ("running", None, "proceed")


def test_cursor():
    text = control.encode_cursor(["a", "b"], [1, "x"])
    assert control.decode_cursor(text, ["a", "b"]) == [1, "x"]
    for bad, key in ((text, ["b", "a"]), (text, ["a"]), ("{}", ["a"]), (None, ["a"]), ("nonsense", ["a"])):
        assert control.decode_cursor(bad, key) is None


def test_state_store(spark, tmp_path):
    s = control.StateStore(spark, f"file://{tmp_path}/state")
    s.request_backfill("t", purge=True)
    s.request_backfill("t")
    assert s.load("backfill")["t"]["purge"] and not s.save_progress("t", [1], 5)
    assert s.cancel_backfill("t") and not s.cancel_backfill("t")
    s.enqueue_fanout("h", {"n": 1})
    s.enqueue_fanout("h", {"n": 2})
    assert len(s.load("fanout")) == 1
    s.files.write(f"file://{tmp_path}/state/VERSION", "99")
    with pytest.raises(RuntimeError):
        control.StateStore(spark, f"file://{tmp_path}/state")


def test_attribute_presence():
    doc = {"a": {"b": None}, "x.y": 1, "list": [{"k": 1}, {"z": 2}], "none": []}
    assert all(has_attribute(doc, p) for p in ("a.b", "x.y", "list.k", "list.z", "none.any"))
    assert not any(has_attribute(doc, p) for p in ("a.c", "x", "list.q"))
