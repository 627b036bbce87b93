"""Helpers shared by the operators: tables, the shared work folder, Arrow batches."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in groups of at most this many bytes (one longer text is a group of its own).
GROUP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in
    local runs without that setting a temporary folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rivulet-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rivulet-work/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["rivulet_path"] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialise() wrote for these, once nothing reads it any more."""
    for df in frames:
        _delete(df.sparkSession, df.__dict__["rivulet_path"])


def clear_work(spark: SparkSession) -> None:
    """Delete all intermediate tables; results that still read them must be written before."""
    _delete(spark, f"{shared_dir(spark)}/rivulet-work")


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot if it holds more than this part of a task's fair share of the rows.
HOT = 64
#: No key with so few rows is.
HOT_LEAST = 8


def marked_hot(keyed: DataFrame, key: list[str], count: str, share: int | None = None) -> DataFrame:
    """`keyed` (one row a key, with the number of its rows) with _share, the most rows that a key may
    have without being hot, and _is_hot.  Fewer than HOT * shuffle partitions keys can have more; the
    key that most rows have is hot in any case.  `share` is a bound known beforehand."""
    one, present = F.struct(F.col(count).alias("n"), *key), F.lit(True)
    for k in key:
        present = present & F.col(k).isNotNull()
    # one subquery for both: each is a pass of its own with an exchange, and stands twice in the plan
    found = keyed.agg(F.struct(F.coalesce(F.sum(count), F.lit(0)).alias("all"), F.max(F.when(present, one)).alias("most"))).scalar()
    bound = F.greatest(F.floor(found.getField("all") / (HOT * shuffle_partitions(keyed.sparkSession))), F.lit(HOT_LEAST))
    bound = bound if share is None else F.lit(max(share, HOT_LEAST))
    return keyed.withColumn("_share", bound).withColumn("_is_hot", (F.col(count) > bound) | F.coalesce(one == found.getField("most"), F.lit(False)))


def join_spread(rows: DataFrame, keyed: DataFrame, key: list[str], count: str, spread: list[str], how: str = "inner", share: int | None = None) -> DataFrame:
    """`rows` joined with `keyed`, which has one row of fixed size for each key that more than
    one row has and whose column `count` is the number of those rows.

    Hot keys (see marked_hot; their number is bounded by the number of partitions) are broadcast,
    and their rows are dealt by `spread` where the rest is dealt by key, so no key's rows meet in
    one task.  Rows with a null in the key match nothing.  `hot` in the result tells hot rows.
    The key that most rows have is always among the hot ones, so that the plan is the same whether
    the data have hot keys or not (Spark leaves out a join with nothing).
    `share` is a bound known beforehand of what marked_hot would find out."""
    rest = [c for c in keyed.columns if c not in key]
    keyed = marked_hot(keyed, key, count, share).drop("_share")
    hot = keyed.where("_is_hot").select(*key, F.struct(*rest).alias("_hot"))
    # 0 in a form that Spark can't fold into the join's condition, which would leave the keys alone to deal by
    zero = F.when(F.col(count) < 0, 1).otherwise(0)
    cold = keyed.where("not _is_hot").select(*key, F.struct(*rest).alias("_cold"), zero.alias("_deal"))
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    dealt = rows.join(F.broadcast(hot), key, "left")
    dealt = dealt.withColumn("_deal", F.when(F.col("_hot").isNull() & whole, 0).otherwise(F.pmod(F.hash(*spread), F.lit(1 << 20)) + 1))
    found = dealt.join(cold.hint("merge"), [*key, "_deal"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    if how == "inner":
        found = found.where(F.col("_found").isNotNull())
    return found.select(*rows.columns, *[F.col("_found").getField(c).alias(c) for c in rest], F.col("_hot").isNotNull().alias("hot"))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; null stays None."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def groups(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have at most `limit` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pa.compute.binary_length(col).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and what one task had at
    its height would stay with each of them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def per_process(key: tuple, make: Callable[[], object]) -> object:
    """What `make` gives, once per Python worker: workers live on between tasks, and functions
    that come by value have no module of their own to keep things in."""
    home = sys.modules.setdefault("_rivulet_kept", types.ModuleType("_rivulet_kept"))
    kept = home.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
