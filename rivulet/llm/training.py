"""Bounded samples of labelled documents, for the models that learn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: At most so many labelled documents train a model; which ones follows from a hash of the id.
SAMPLE = 12_000


#: Groups above one part in so many of all rows are bounded before they are dealt.
GROUPS = 1_000


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def held_out(modulus: int, held: int) -> Column:
    """Whether the row is in the held-out fold; one without an id isn't (nor does it train)."""
    return F.coalesce(fold(modulus) == held, F.lit(False))


def least_hashes(rows: DataFrame, limit: int, group: str | None = None) -> DataFrame:
    """The `limit` rows with the least hash of doc_id, of all or of each value of `group`.

    A count comes first and gives a bound on the hash that about twice the limit passes, so that
    what is sorted in one task doesn't grow with the table."""
    steps = 1 << 40
    h = F.pmod(F.xxhash64("doc_id"), F.lit(steps))
    bound = lambda n: F.when(n <= 4 * limit, F.lit(steps).cast("double")).otherwise(F.lit(2.0 * limit * steps) / n)
    if group is None:
        n = rows.count()
        return rows.where(h < bound(F.lit(n))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # groups that hold more than a thousandth of all rows are at most a thousand, so their sizes
    # are broadcast and bound them where they lie; smaller ones are dealt as they are
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > max(4 * limit, rows.count() // GROUPS))
    near = rows.join(F.broadcast(large), group, "left").where(h < bound(F.coalesce("_n", F.lit(0))))
    first = Window.partitionBy(group).orderBy(F.xxhash64("doc_id"), "doc_id")
    return near.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= limit).drop("_k", "_n")


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of at most `limit` labelled documents outside the held-out fold.

    The ids are bounded by `limit`, so they are broadcast.  Null texts, ids and labels are left
    out, and so are ids whose labels clash; of several texts of one id the least is taken."""
    want = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(modulus) != held) if modulus else F.col(label).isNotNull())
    ids = want.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"), F.max(F.col(label).cast("int")).alias("_y")).where("y = _y").select("doc_id", "y")
    ids = least_hashes(ids, limit)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    found = found.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return materialise(found.select("doc_id", "text", "y"), "sample")
