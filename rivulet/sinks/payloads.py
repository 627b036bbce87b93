"""Sink records as the payloads of each kind of destination (OP-SNK-5..9, OP-FN-6, OP-FN-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import idempotency_key, index_id


def record_key() -> Column:
    return idempotency_key(F.col("destination"), F.col("schema"), F.col("table"), F.col("document_id"), F.col("commit_lsn"), F.col("commit_idx"), F.col("is_backfill"), F.col("backfill_run_id"))


def metadata() -> Column:
    """Positions are text: they exceed what JSON consumers read as whole numbers."""
    return F.struct(
        "schema", "table", "action", F.col("commit_lsn").cast("string").alias("commitLsn"), F.col("commit_idx").alias("commitIdx"),
        F.date_format("commit_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("commitTimestamp"), F.col("is_backfill").alias("isBackfill"), F.col("backfill_run_id").alias("backfillRunId"),
    )


def operation() -> Column:
    return F.when(F.col("is_deletion"), "delete").otherwise("upsert")


def with_document(envelope: list[Column]) -> Column:
    """The envelope as JSON with the document, a JSON text (its nulls written), spliced in."""
    head = F.to_json(F.struct(*envelope))
    meta = F.to_json(F.struct(metadata().alias("metadata")))
    body = F.when(F.col("is_deletion"), F.lit("")).otherwise(F.concat(F.lit(',"document":'), F.coalesce("document", F.lit("null"))))
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), body, F.lit(","), F.substring(meta, F.lit(2), F.length(meta)))


def kafka_records(records: DataFrame, annotations: dict[str, str] | None = None) -> DataFrame:
    """topic, key, value, headers, as Spark's Kafka sink takes them; a deletion is a tombstone."""
    notes = [F.struct(*[F.lit(v).alias(k) for k, v in annotations.items()]).alias("annotations")] if annotations else []
    value = with_document([operation().alias("operation"), F.col("document_id").alias("id"), record_key().alias("idempotencyKey"), *notes])
    header = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value"))
    headers = F.array(header("rivulet.operation", operation()), header("rivulet.idempotency-key", record_key()), header("rivulet.table", F.concat_ws(".", "schema", "table")), header("rivulet.commit-lsn", F.col("commit_lsn").cast("string")))
    return records.select(F.col("destination").alias("topic"), F.col("document_id").alias("key"), F.when(~F.col("is_deletion"), value).alias("value"), headers.alias("headers"))


def chunked(rows: DataFrame, size: int, body: Column, *more: Column, parts: int | None = None) -> DataFrame:
    """(part, step, n_records, body, more): documents are dealt to as many parts as shuffle
    partitions (or `parts`) and cut into chunks of `size` in commit order; `body` and `more` are
    expressions over a chunk's `rows`."""
    count = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("part").orderBy("commit_lsn", "commit_idx", "document_id")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("document_id"), F.lit(count)))
    cut = dealt.withColumn("_n", F.row_number().over(order) - 1).withColumn("step", F.expr(f"_n div {size}"))
    grouped = cut.groupBy("part", "step").agg(F.count(F.lit(1)).alias("n_records"), F.array_sort(F.collect_list(F.struct("_n", *rows.columns))).alias("rows"))
    return grouped.select("part", "step", "n_records", body, *more)


def http_requests(records: DataFrame, sink: str, per_request: int = 500, annotations: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """One body per `per_request` records in commit order, within each of the `parts` that records
    are dealt to by document: (part, request, n_records, body, keys); keys are the records'
    idempotency keys."""
    one = with_document([operation().alias("operation"), F.col("document_id").alias("id"), record_key().alias("idempotencyKey"), F.col("destination").alias("destination")])
    rows = records.select("document_id", "commit_lsn", "commit_idx", one.alias("j"), record_key().alias("k"))
    head = F.to_json(F.struct(F.lit("rivulet.changes").alias("type"), F.lit(sink).alias("sink"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("sentAt"), *([F.struct(*[F.lit(v).alias(k) for k, v in annotations.items()]).alias("annotations")] if annotations else [])))
    body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"records":['), F.array_join(F.transform("rows", lambda r: r["j"]), ","), F.lit("]}"))
    return chunked(rows, per_request, body.alias("body"), F.transform("rows", lambda r: r["k"]).alias("keys"), parts=parts).withColumnRenamed("step", "request")


def bulk_lines(records: DataFrame) -> DataFrame:
    """NDJSON of the bulk API: an action line, and for an upsert the document."""
    target = F.struct(F.col("destination").alias("_index"), F.col("document_id").alias("_id"))
    action = F.when(F.col("is_deletion"), F.to_json(F.struct(target.alias("delete")))).otherwise(F.to_json(F.struct(target.alias("index"))))
    lines = F.when(F.col("is_deletion"), F.concat(action, F.lit("\n"))).otherwise(F.concat(action, F.lit("\n"), "document", F.lit("\n")))
    return records.select("destination", "document_id", "commit_lsn", "commit_idx", lines.alias("lines"))


def index_batches(records: DataFrame, *more: str) -> DataFrame:
    """Per index: upserts are sent before deletes, ids encoded for the index."""
    return records.select(F.col("destination").alias("index"), index_id(F.col("document_id")).alias("id"), F.when(F.col("is_deletion"), 1).otherwise(0).alias("step"), "document", *more)


def index_requests(records: DataFrame, per_request: int = 500, parts: int | None = None) -> DataFrame:
    """(part, step, index, deletion, ids, documents): an index's upserts and its deletes are dealt by id to
    `parts` parts each, so one index is sent by many tasks and an id's records stay in order; requests
    hold `per_request` documents in commit order."""
    rows = index_batches(records.withColumns({"lsn": F.col("commit_lsn"), "idx": F.col("commit_idx")}), "lsn", "idx")
    parts = parts or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_slot", F.pmod(F.xxhash64("id"), F.lit(parts)))
    key = ["index", "step", "_slot"]
    cut = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("lsn", "idx", "id")) - 1).withColumn("_chunk", F.expr(f"_n div {per_request}"))
    grouped = cut.groupBy(*key, "_chunk").agg(F.array_sort(F.collect_list(F.struct("_n", "id", "document"))).alias("rows"))
    return grouped.select(
        F.xxhash64(*key).alias("part"), F.col("_chunk").alias("step"), "index", (F.col("step") == 1).alias("deletion"),
        F.transform("rows", lambda r: r["id"]).alias("ids"), F.transform("rows", lambda r: r["document"]).alias("documents"),
    )


def bulk_outcome(items: DataFrame) -> DataFrame:
    """Outcome of each request from its items' (status, op): success below 300 and for a delete
    of what isn't there; 408, 429 and 5xx can be retried; one permanent failure outweighs."""
    fine = (F.col("status") < 300) | ((F.col("op") == "delete") & (F.col("status") == 404))
    again = F.col("status").isin(408, 429) | (F.col("status") >= 500)
    grade = F.when(fine, 0).when(again, 1).otherwise(2)
    worst = items.groupBy("request").agg(F.max(grade).alias("g"), F.sum(F.when(~fine, 1).otherwise(0)).alias("failed"))
    return worst.select("request", F.when(F.col("g") == 0, "success").when(F.col("g") == 1, "retryable").otherwise("permanent").alias("outcome"), "failed")


def has_attribute(document: dict, path: str) -> bool:
    """A dotted path is there as a literal key, through nested objects, or in any item of an
    array; an empty array passes, and a null value counts."""
    if path in document:
        return True
    head, dot, rest = path.partition(".")
    while dot:
        if head in document:
            value = document[head]
            items = value if isinstance(value, list) else [value]
            if isinstance(value, list) and not value:
                return True
            if any(isinstance(v, dict) and has_attribute(v, rest) for v in items):
                return True
        more, dot, rest = rest.partition(".")
        head = f"{head}.{more}"
    return False
