"""Connected components as DataFrame rounds (large-star / small-star, Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_spread, materialise


#: Up to so many edges are followed in one task, which takes less than the rounds' shuffles.
FEW = 100_000


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of edges (u, v) that are few: union-find with the smallest node as root."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = find(u), find(v)
            root[max(p, q)] = min(p, q)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])


def _mark(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that an edge names, with the smallest node it reaches.

    Nulls and self-loops are ignored; no edges give no rows.  Each round only joins and takes
    minima per node, so no group is gathered; the edges of a node that very many have are spread
    (the second join is by the larger node of each edge, which has few smaller ones).  The number
    of rounds is logarithmic.  Up to FEW edges are followed in one task instead."""
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = materialise(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _mark(e)
    if before[0] <= FEW:
        return e.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_followed, "node long, root long")
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        least = materialise(least.withColumn("m", F.least("u", "m")), "least")
        large = join_spread(both, least, ["u"], "n", ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hubs, least = least, large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, materialise(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        discard(last, hubs)
        now = _mark(e)
        if now == before:
            break
        before = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
