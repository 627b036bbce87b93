"""Benchmarks of many blocks: each block is parsed for few shards, and the results are those of one block."""

import pyarrow as pa

from rivulet.llm import decontaminate as dc


def test_shards_go_back_and_forth(monkeypatch):
    monkeypatch.setattr(dc, "SHARD_BYTES", 100)
    batch = pa.record_batch([pa.array(range(40)), pa.array(["word " * 5] * 40)], names=["doc_id", "text"])
    files = [f"b{k}" for k in range(10)]
    kept, parsed, shards = [], 0, 0
    for part, order in dc._shards(iter([batch]), files):
        shards += 1
        assert part.num_rows <= 16 and sorted(order) == sorted(files)
        for f in order:
            parsed += f not in kept
            kept = [x for x in kept if x != f][-(dc.KEPT - 1) :] + [f]
    assert shards == 3 and parsed == 10 + 2 * (10 - dc.KEPT)
    assert [o for _, o in dc._shards(iter([batch]), ["one"])] == [["one"]] * 10


def test_ten_blocks_equal_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    size = sum(len((r["text"] or "").encode()) for r in items.collect())
    rows = lambda limit: sorted(map(repr, dc.contamination(docs, items, limit=limit).collect()))
    assert len(dc.blocks(items, size // 10)) >= 8
    assert rows(size // 10) == rows(dc.BLOCK_BYTES)
