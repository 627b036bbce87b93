"""The prefix trie against a plain dictionary of all beginnings."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rivulet.llm import prefix_trie as pt

TINY = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"
NAMES = [x.split()[0] for x in pt.NODE.split(", ")]


def rebuilt(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))

    def digest(r):
        return hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()

    turns = {c: [(r[1], r[2]) for r in sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))] for c, x in own.items()}
    out = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + x[h:]
    return out


def brute(conversations):
    nodes = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: set() for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(conversations[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    assert df.columns == NAMES
    return sorted(map(tuple, df.collect()), key=repr)


def test_query(spark):
    for folder in (TINY, SMALL):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert rows_of(pt.op13_prefix_trie(spark, folder)) == brute(rebuilt(rows))


def odd(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(150), 300, 317, 9_000_000_000, None]:
        for k in range(rnd.choice([0, 1, 2, 3, 5, 8, 8, 12])):
            same = k < 4 and rnd.random() < 0.85
            rows.append((c, None if rnd.random() < 0.05 else k, "user" if same else rnd.choice(["user", "", None, "é"]), f"t{k}" if same else rnd.choice([None, "", "x" * 3000, "漢字", "tail"])))
    return rows + rows[:5]


@pytest.mark.parametrize("group", [None, 1, 40])
def test_odd_rows_and_splits(spark, tmp_path, group):
    rows = odd(4)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, top string, n int").repartition(4)
    conversations = pt.grafted(pt.numbered_turns(df))
    assert rows_of(pt.prefix_trie(conversations, group)) == brute(rebuilt(rows))


def test_copies_and_the_empty_conversation(spark):
    rows = [(c, k, "user", f"t{k}") for c in range(1000, 1400) for k in range(3)] + [(2001, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = brute(rebuilt(rows))
    for group in (None, 2):
        assert rows_of(pt.prefix_trie(pt.grafted(pt.numbered_turns(df)), group)) == want
    assert pt.prefix_trie(pt.grafted(pt.numbered_turns(df.limit(0)))).collect() == []
    # a conversation of which nothing is left ends at the root
    c = next(c for c in range(5001, 5099) if zlib.crc32(str(c).encode()) % 6 > 1)
    alone = spark.createDataFrame([(c, 0, "user", "gone")], df.schema)
    assert rows_of(pt.prefix_trie(pt.grafted(pt.numbered_turns(alone)))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_ids_of_one_key_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 7)
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, F.lit(b"hot")).otherwise(F.encode(F.col("id").cast("string"), "UTF-8")).alias("whole"), F.col("id").alias("conv_id"))
    got = {bytes(r[0]): r[1] for r in pt.id_digests(df, "whole").collect()}
    want = {b"hot": ",".join(str(i) for i in range(500) if i % 3 == 0)} | {str(i).encode(): str(i) for i in range(500) if i % 3}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
