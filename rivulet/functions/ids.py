"""Document ids, positions, hashes and schedules as column expressions (OP-KEY-1/2, OP-FN-*)."""

from __future__ import annotations

import base64
import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "|"
#: The longest id a search index takes.
INDEX_ID_MAX = 511


def rendered(col: Column, kind: T.DataType, zone: str = "") -> Column:
    """One key value as invariant text: bytes as lower hex, dates and times in ISO form with
    seven digits of the second (`zone` is Z for UTC instants, empty for local ones), booleans
    as True/False, whole doubles without a fraction, null as empty."""
    if isinstance(kind, T.BinaryType):
        text = F.lower(F.hex(col))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0" + zone))
    elif isinstance(kind, T.BooleanType):
        text = F.when(col, "True").when(~col, "False")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.when(col == F.floor(col), F.floor(col).cast("decimal(38,0)").cast("string")).otherwise(col.cast("string"))
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def escaped(text: Column) -> Column:
    """The escape sign first, then the separator."""
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit(SEPARATOR), F.lit("%7C"))


def canonical_id(*parts: Column) -> Column:
    """Rendered values, escaped and joined; parts are strings (see `rendered`)."""
    return F.concat_ws(SEPARATOR, *[escaped(F.coalesce(p, F.lit(""))) for p in parts])


def split_id(col: Column) -> Column:
    """The rendered values of a canonical id; an escape that isn't one raises an error."""
    bad = F.regexp_replace(col, "%25|%7C", "").contains("%")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("invalid escape in document id "), col))).otherwise(col)
    return F.transform(F.split(checked, r"\|", -1), lambda x: F.replace(F.replace(x, F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%")))


def index_id(col: Column) -> Column:
    """The id as a search index takes it: plain, composite joined by _, else _e and base64url."""
    plain = col.rlike("^[A-Za-z0-9-][A-Za-z0-9_-]*$")
    composite = col.rlike(r"^[A-Za-z0-9-]+(\|[A-Za-z0-9-]+)+$")
    b64 = F.regexp_replace(F.base64(F.encode(col, "UTF-8")), "[\r\n=]", "")
    out = F.when(plain, col).when(composite, F.replace(col, F.lit("|"), F.lit("_"))).otherwise(F.concat(F.lit("_e"), F.translate(b64, "+/", "-_")))
    return F.when(F.length(out) <= INDEX_ID_MAX, out).otherwise(F.raise_error(F.concat(F.lit("id too long for the index: "), F.substring(col, 1, 40))))


def index_id_decoded(col: Column, parts: int) -> Column:
    """The canonical id of an index id; one that index_id doesn't make raises an error."""
    coded = col.startswith("_e")
    body = F.translate(F.substring(col, 3, INDEX_ID_MAX), "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(F.lit(4) - F.length(body) % 4, F.lit(4))))
    text = F.when(coded, F.decode(F.unbase64(padded), "UTF-8")).otherwise(col if parts == 1 else F.replace(col, F.lit("_"), F.lit("|")))
    fits = coded | (F.length(F.regexp_replace(text, "[^|]", "")) == parts - 1)
    return F.when(fits & (index_id(text) == col), text).otherwise(F.raise_error(F.concat(F.lit("not an index id: "), col)))


def idempotency_key(destination: Column, schema: Column, table: Column, document_id: Column, lsn: Column, idx: Column, backfill: Column, run_id: Column) -> Column:
    scope = F.coalesce(destination, F.concat_ws(".", schema, table))
    live = F.concat_ws(":", lsn.cast("string"), idx.cast("string"), scope, document_id)
    return F.when(backfill, F.concat_ws(":", F.lit("backfill"), F.coalesce(run_id, F.lit("0")), scope, document_id)).otherwise(live)


def text_hash(version: str, text: Column) -> Column:
    return F.base64(F.unhex(F.sha2(F.concat(F.lit(version + "\n"), text).cast("binary"), 256)))


def lookup_hash(table: str, columns: list[str], tuples: Column) -> Column:
    """The identity of a set of lookup tuples (JSON arrays as text), in any order."""
    values = F.concat(F.lit("["), F.array_join(F.array_sort(F.array_distinct(tuples)), ","), F.lit("]"))
    return F.upper(F.sha2(F.concat(F.lit(f"{table}|{'|'.join(columns)}|"), values).cast("binary"), 256))


def lsn_number(text: Column) -> Column:
    """hi/lo in hex as an unsigned 64-bit number."""
    part = lambda i: F.conv(F.split_part(text, F.lit("/"), F.lit(i)), 16, 10).cast("decimal(20,0)")
    return (part(1) * F.lit(2**32).cast("decimal(20,0)") + part(2)).cast("decimal(20,0)")


def lsn_text(number: Column) -> Column:
    n = number.cast("decimal(20,0)")
    high = F.floor(n / F.lit(2**32)).cast("bigint")
    low = (n - high.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(20,0)")).cast("bigint")
    return F.concat_ws("/", F.hex(high), F.hex(low))


def backoff_seconds(attempts: Column) -> Column:
    """Persisted backoff: five seconds, doubling, five minutes at most."""
    return F.least(F.lit(5.0) * F.pow(F.lit(2.0), F.least(attempts, F.lit(16))), F.lit(300.0))


def progress(copied: Column, estimated: Column) -> Column:
    return F.when(estimated > 0, F.least(F.lit(1.0), copied.cast("double") / estimated))


def eta_seconds(status: Column, copied: Column, estimated: Column, elapsed: Column) -> Column:
    ready = (status == "in_progress") & (copied > 0) & (elapsed > 0) & estimated.isNotNull()
    return F.when(ready, F.greatest(estimated - copied, F.lit(0)) * elapsed / copied)


def message_id(sink: str, keys: list[str]) -> str:
    """The id of a request: it follows from the sink and the records' keys."""
    digest = hashlib.sha256((sink + "".join("\n" + k for k in keys)).encode()).digest()
    return "msg_" + digest[:16].hex()


def webhook_signatures(secrets: list[str], msg_id: str, timestamp: int, body: bytes) -> str:
    """v1 signatures of id.timestamp.body, one for each secret (two while they rotate)."""
    out = []
    for secret in secrets:
        key = base64.b64decode(secret.removeprefix("whsec_"))
        if len(key) < 16:
            raise ValueError("a signing key has at least 16 bytes")
        mac = hmac.new(key, f"{msg_id}.{timestamp}.".encode() + body, hashlib.sha256).digest()
        out.append("v1," + base64.b64encode(mac).decode())
    return " ".join(out)


def advisory_key(name: str) -> int:
    """A stable signed 64-bit number for a name."""
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big", signed=True)
