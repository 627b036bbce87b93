"""Packing: ids against the library, places against the contract, sequences against bounds and best fit."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from rivulet.llm import packing
from rivulet.llm.byte_ids import ByteCoder
from rivulet.llm.common import materialise

TINY = "/root/testdata/sf0.001"
END = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.byte_tokenizer_path())


def test_ids_equal_the_library(library):
    rnd = random.Random(1)
    signs = [*"ab'sZ9 ,.\n\t\r  é漢 \x1c\x85　​́😀<|>-_", END, " \n", "\n\n\n", "  ", "don't", "'ll ", " 's"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(4000)] + [None, "", " ", "\n", "  ", "a ", "word. " * 50_000]
    got = ByteCoder(packing.byte_tokenizer_path()).encode(texts)
    assert got == [np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def want_pieces(library, doc, text):
    ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
    first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
    cuts = [0, *range(first, len(ids) + 1, 2048)]
    return [(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def check_places(rows, capacity=2048):
    """rows: (sequence, offset, length); the number of sequences."""
    rows, last = sorted(rows), None
    for s, o, n in rows:
        assert o == (last[1] + last[2] if last and last[0] == s else 0) and 0 < n and o + n <= capacity
        last = (s, o, n)
    return len({s for s, _, _ in rows})


def check_query(spark, library, folder, got):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((p for d, t in docs for p in want_pieces(library, d, t)), key=repr)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == want
    n = check_places([(r["sequence_id"], r["offset"], r["length"]) for r in rows])
    counts = np.bincount([r["length"] for r in rows], minlength=2049)
    return n, max(-(-int(counts @ np.arange(2049)) // 2048), int(counts[1025:].sum())), packing.best_fit(counts, 2048).total()


def test_query(spark, library):
    n, bound, plain = check_query(spark, library, TINY, packing.op12_packing(spark, TINY))
    assert bound <= n <= plain


def test_odd_rows(spark, library, tmp_path):
    rnd = random.Random(3)
    long = " ".join(str(rnd.random()) for _ in range(9000))
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (None, None), (3, long), (3, long), (4, "x" * 50_000), (5, f"a {END} b  \n"), (6, " y" * 2047), (7, " y" * 2048), *[(10 + i, "same text") for i in range(300)]]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, row string, length int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    n, bound, plain = check_query(spark, library, tmp_path, packing.op12_packing(spark, str(tmp_path)))
    assert bound <= n <= plain
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_sequences_hold_the_ids(spark, library):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").limit(60)
    placed = materialise(packing.pack_documents(docs, capacity=256), "placed")
    whole = {r["sequence_id"]: r for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        row = whole[r["sequence_id"]]
        assert bytes(row["ids"])[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
        assert len(set(row["segments"][r["offset"] : r["offset"] + r["length"]])) == 1
    assert all(len(r["ids"]) // 4 == len(r["segments"]) <= 256 and len(set(r["segments"])) == max(r["segments"]) + 1 for r in whole.values())


def places_of(counts, capacity):
    plan = packing.make_plan(np.array(counts), capacity)
    length = np.repeat(np.arange(capacity + 1), counts)
    rank = np.concatenate([np.arange(c) for c in counts]) if sum(counts) else np.zeros(0, dtype=np.int64)
    s, o = plan.places(length, rank)
    n = check_places(list(zip(s.tolist(), o.tolist(), length.tolist(), strict=True)), capacity)
    assert n == plan.n_sequences
    return n


def least(counts, capacity):
    """The least number of sequences, by trying everything."""
    pieces = [k for k in range(capacity, 0, -1) for _ in range(counts[k])]
    best = [len(pieces)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= pieces[i]}):
            k = rooms.index(r)
            put(i + 1, [*rooms[:k], r - pieces[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, capacity - pieces[i]])

    put(0, [])
    return best[0]


def test_plans_against_all_ways():
    rnd, over = random.Random(5), 0
    for _ in range(150):
        capacity = rnd.randint(3, 14)
        counts = [0] * (capacity + 1)
        for _ in range(rnd.randint(0, 11)):
            counts[rnd.randint(1, capacity)] += 1
        n, best = places_of(counts, capacity), least(counts, capacity)
        assert best <= n <= best + 1
        over += n > best
    assert over <= 5


def test_plans_of_large_counts_reach_the_bound():
    rnd = np.random.default_rng(7)
    lengths = np.minimum(rnd.lognormal(5.5, 1.1, 30_000).astype(int) + 1, 2048)
    for times in (1, 40):
        counts = np.bincount(lengths, minlength=2049) * times
        bound = -(-int(counts @ np.arange(2049)) // 2048)
        n = places_of(counts.tolist(), 2048)
        assert bound <= n <= packing.best_fit(counts, 2048).total() and n <= bound * 1.001 + 1
    assert places_of([0, 100_000, *[0] * 2047], 2048) == 49 and places_of([0] * 700 + [10] + [0] * 1348, 2048) == 5
    with pytest.raises(ValueError):
        packing.make_plan(np.array([0, -1]), 1)
