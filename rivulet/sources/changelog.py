"""The change log: its schema, its readers, and logs derived from plain tables.

A log row is a change or a control record (commit, abort, sub_abort, truncate, watermarks,
heartbeat, gap).  Order is (commit_lsn, commit_idx); commit_lsn is a decimal(20,0) on disk, since
positions are unsigned 64-bit numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL = ("commit", "abort", "sub_abort", "truncate", "watermark_low", "watermark_high", "heartbeat", "gap")


def log_schema(image: T.StructType) -> T.StructType:
    s, l = T.StringType(), T.LongType()
    return T.StructType([T.StructField(n, t) for n, t in [("kind", s), ("seq", l), ("xid", l), ("subxid", l), ("commit_lsn", T.DecimalType(20, 0)), ("commit_ts", T.TimestampNTZType()), ("commit_idx", T.IntegerType()), ("schema", s), ("table", s), ("action", s), ("new", image), ("old", image), ("unavailable_cols", T.ArrayType(s)), ("token", s), ("backfill_run_id", s)]])


def read_log(spark: SparkSession, path: str, image: T.StructType) -> DataFrame:
    """All segments of a log, columns by name, unknown ones ignored, missing ones null.  With
    the log laid out as table=.../ directories a filter on `table` prunes files."""
    return spark.read.schema(log_schema(image)).parquet(path)


def stream_log(spark: SparkSession, path: str, image: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    """The log as a stream; writers put whole transactions into a file."""
    return spark.readStream.schema(log_schema(image)).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def only_modelled(log: DataFrame, tables: list[str]) -> DataFrame:
    """Changes of tables that the model doesn't have are skipped."""
    return log.where(F.concat_ws(".", "schema", "table").isin(tables))


def markers(log: DataFrame) -> DataFrame:
    """Watermarks and heartbeats of the stream, in order of position."""
    return log.where(F.col("kind").isin("watermark_low", "watermark_high", "heartbeat")).select("kind", "seq", "xid", "token")


def truncated_tables(log: DataFrame) -> DataFrame:
    """Truncations are noted for a warning and take no part in the flow of changes."""
    return log.where("kind = 'truncate'").groupBy("xid").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(".", "schema", "table"))), ",").alias("tables"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as the log of a table of users: sign-ups insert, errors delete, all else updates;
    five events are a transaction; the old image is the user's event before, and a delete
    without one has the key alone."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    image = F.struct("user_id", "event_type", "value", "props")
    key_only = F.struct("user_id", F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("props"))
    action = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    before = F.lag(image).over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select(
        F.lit("change").alias("kind"), F.col("event_id").alias("seq"), F.expr("event_id div 5 + 1").alias("commit_lsn"), F.col("ts").alias("commit_ts"),
        F.expr("cast(event_id % 5 as int)").alias("commit_idx"), F.lit("app").alias("schema"), F.lit("users").alias("table"), action.alias("action"),
        F.when(action != "delete", image).alias("new"), F.when(action == "update", before).when(action == "delete", F.coalesce(before, key_only)).alias("old"),
    )


def transaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as raw protocol records: eight interleaved transactions of 64 events each block;
    every fifth aborts; events of type view belong to a subtransaction that the first error
    behind them rolls back; clicks on every 97th event truncate a table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    xid = F.expr("event_id div 64 * 8 + event_id % 8")
    base = e.select(F.col("event_id").alias("seq"), xid.alias("xid"), F.when(F.col("event_type") == "view", xid * 10 + 1).alias("subxid"), "user_id", "event_type")
    kind = F.when((F.col("event_type") == "error"), "sub_abort").when((F.col("event_type") == "click") & (F.col("seq") % 97 == 0), "truncate").otherwise("change")
    body = base.withColumn("kind", kind).withColumn("subxid", F.when(F.col("kind") == "sub_abort", F.col("xid") * 10 + 1).otherwise(F.col("subxid")))
    ends = base.groupBy("xid").agg((F.max("seq")).alias("seq")).select(
        (F.col("seq") * 2 + 1).alias("seq"), "xid", F.lit(None).cast("bigint").alias("subxid"), F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("event_type"),
        F.when(F.col("xid") % 5 == 0, "abort").otherwise("commit").alias("kind"),
    )
    return body.withColumn("seq", F.col("seq") * 2).unionByName(ends).withColumns({"schema": F.lit("app"), "table": F.lit("users")})
