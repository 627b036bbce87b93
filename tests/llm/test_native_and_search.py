"""Line dedup, near-dedup, decontamination and suffix dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivulet.llm import common, components, gbt, near_dedup, quality_rules, suffix_dedup
from rivulet.llm.components import connected_components
from rivulet.llm.decontaminate import ORACLE as DECONTAMINATE_SQL
from rivulet.llm.decontaminate import Shard, contamination, keep_clean, op4_decontaminate
from rivulet.llm.line_dedup import ORACLE, line_dedup, op1_line_dedup, passage_dedup
from rivulet.llm.near_dedup import band_count, block_links, keep_first, near_duplicates
from rivulet.llm.shingles import ShingleSet, Vocabulary, shingle_sets
from rivulet.llm.suffix_dedup import suffix_dedup as dedup
from rivulet.llm.suffix_sort import Text, deep_shallow
from rivulet.llm.superminhash import bands, signatures

TINY = "/root/testdata/sf0.001"


def docs(spark, rows, parts=3):
    """Documents with columns that clash with the operators' own names."""
    full = [(i, t, "a", "b", "c", "d", None) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, t string, h string, lines string, key string, label string").repartition(parts)


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


# ---- line dedup


def test_line_dedup_equals_sql(spark):
    df = op1_line_dedup(spark, TINY)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{TINY}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, n_lines, n_chunks, n_removed_lines, kept_sha256 FROM ({ORACLE})").fetchall()
    got = df.select("doc_id", "n_lines", "n_chunks", "n_removed_lines", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_line_dedup_edges(spark):
    passage = "\n".join(f"common line {i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, "\n\n\n"), (5, "x\n" + passage + "\ny"), (6, passage), (7, passage), (None, passage), (8, "one line"), (9, "one line")]
    out = {(r["doc_id"]): r for r in line_dedup(docs(spark, rows)).collect()}
    assert out[1]["text"] is None and out[1]["n_lines"] == 0
    assert out[2]["text"] == "" and out[2]["n_lines"] == 1
    assert out[3]["text"] == out[4]["text"] == "\n\n\n"
    assert out[5]["text"].count("\n") == 31 and out[8]["text"] == out[9]["text"] == "one line"
    assert out[7]["n_removed_lines"] > 20 and out[6]["n_removed_lines"] > 15  # chunks of two lines or more
    assert out[None]["text"] == passage
    assert all(ln in passage for ln in out[7]["text"].split("\n"))
    assert line_dedup(docs(spark, [(1, "a")]).limit(0)).count() == 0


def test_line_dedup_takes_no_python(spark):
    plan = op1_line_dedup(spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def planted(spark, size):
    """40 passages of `size` lines, each in two documents among lines of their own."""
    rows = []
    for k in range(40):
        passage = [f"passage {k} of {size} line {i}" for i in range(size)]
        for j in range(2):
            rows.append((2 * k + j, "\n".join([f"own {k} {j} a", f"own {k} {j} b", *passage, f"own {k} {j} c", f"own {k} {j} d"])))
    return docs(spark, rows)


@pytest.mark.parametrize(("size", "least"), [(5, 0.2), (10, 0.5), (50, 0.85)])
def test_line_dedup_finds_most_of_long_passages(spark, size, least):
    gone = sum(n for i, (n,) in by_id(line_dedup(planted(spark, size)), "n_removed_lines").items() if i % 2)
    assert least * 40 * size <= gone <= 40 * size


@pytest.mark.parametrize("size", [2, 3, 5, 10])
def test_passage_dedup_misses_no_short_passage(spark, size):
    for i, (n, text) in by_id(passage_dedup(planted(spark, size)), "n_removed_lines", "text").items():
        own = [f"own {i // 2} {i % 2} {x}" for x in "abcd"]
        assert n == (size if i % 2 else 0) and (not i % 2 or text == "\n".join(own))


def brute_passages(rows):
    """What passage_dedup keeps of each document, pair by pair."""
    first, kept = {}, {}
    for i, t in sorted(rows):
        lines, gone = t.split("\n"), set()
        for no in range(len(lines) - 1):
            pair = (lines[no], lines[no + 1])
            if not "".join(pair).strip():
                continue
            d, at = first.setdefault(pair, (i, no))
            if d != i or no > at + 1:
                gone |= {no, no + 1}
        kept[i] = "\n".join(x for no, x in enumerate(lines) if no not in gone)
    return kept


def test_passage_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "d", "", " "]) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    rows += [(60, "x\nx\nx"), (61, "y\ny\ny\ny\ny"), (62, "x\nx\nx"), (63, "")]
    out = {i: t for i, (t,) in by_id(passage_dedup(docs(spark, rows)), "text").items()}
    assert out == brute_passages(rows)
    kept = {x for t in out.values() for x in t.split("\n")}
    assert kept >= {x for _, t in rows for x in t.split("\n")}


def test_passage_dedup_edges(spark):
    passage = "\n".join(f"common line {i}" for i in range(4))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "\n\n"), (5, passage), (None, passage), (6, passage + "\nend"), (6, passage + "\nend"), (7, "one line"), (8, "one line")]
    out = sorted((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_removed_lines"]) for r in passage_dedup(docs(spark, rows)).collect() if r["doc_id"] != 1)
    assert out == [(0, passage, 4, 0), (2, "", 1, 0), (3, "\n\n", 3, 0), (4, "\n\n", 3, 0), (5, passage, 4, 0), (6, "end", 5, 4), (6, "end", 5, 4), (7, "one line", 1, 0), (8, "one line", 1, 0)]
    assert passage_dedup(docs(spark, [(1, None)])).first()["text"] is None


# ---- near-dedup


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    inv = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inv[x].append(i)
    both = defaultdict(int)
    for ids in inv.values():
        for a in range(len(ids)):
            for b in range(a):
                both[tuple(sorted((ids[a], ids[b])))] += 1
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), k in both.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("small", [near_dedup.SMALL_BUCKET, 2])
def test_near_duplicates_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(components, "FEW", 0 if small == 2 else components.FEW)
    monkeypatch.setattr(near_dedup, "TURNS", 0 if small == 2 else near_dedup.TURNS)
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 8 if small == 2 else near_dedup.BLOCK)
    rnd = random.Random(3)
    base = [f"w{rnd.randint(0, 999)}" for _ in range(110)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  b"), (5, "a b c")]
    for i in range(6, 80):  # copies with a changed word or two: about half of their pairs are links
        w = list(base)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 9)}"
        rows.append((i, " ".join(w).upper() if i % 2 else "  ".join(w)))
    rows += [(i, " ".join(f"v{rnd.randint(0, 10**6)}" for _ in range(60))) for i in range(80, 100)]
    got = by_id(near_duplicates(docs(spark, rows), percent=85), "n_shingles", "component_id", "kept")
    assert got == brute_components(rows, 85)


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F")]
    out = sorted(near_duplicates(docs(spark, rows)).collect(), key=str)
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in out] == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]
    assert near_duplicates(docs(spark, rows).limit(0)).count() == 0
    left = keep_first(docs(spark, rows))
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == [1, 1, None] and left.columns == docs(spark, rows).columns


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_share_a_polynomial_hash_are_told_apart(spark):
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(8))
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{one} x y {other} x y")]
    assert by_id(near_duplicates(docs(spark, rows), percent=85), "n_shingles", "component_id", "kept") == brute_components(rows, 85)
    got = quality_rules.quality_rules(docs(spark, rows), gbt.fit(np.zeros((0, 14)), np.zeros(0)))
    assert by_id(got, "n_repeat_words") == {1: (0,), 2: (0,), 3: (0,)}


def test_shingles_with_clashing_hashes_are_compared_by_word():
    v = Vocabulary()
    a, b = (ShingleSet(v.numbers(t.split()), v, 2) for t in (b"a b c d", b"a b x d"))
    assert (a.size, b.size, a.shared(b)) == (3, 3, 1)
    v.array = np.zeros(len(v.hashes), dtype=np.uint64)  # as if all words had one hash
    a, b = (ShingleSet(v.numbers(t.split()), v, 2) for t in (b"a b c d a b", b"a b x d"))
    assert a.clash and (a.size, b.size, a.shared(b)) == (4, 3, 1)
    hashes, bounds, size = shingle_sets([v.numbers(t.split()) for t in (b"a b c d a b", b"", b"a", b"a b x d")], v, 2)
    assert size.tolist() == [4, 0, 1, 3] and len(hashes) == bounds[-1] == 3
    one, other = (ShingleSet(v.numbers(t.split()), v, 2) for t in (b"a b", b"c d"))
    assert not one.clash and one.shared(other) == 0 and one.shared(one) == 1


def test_pairs_at_the_threshold_share_a_band():
    rng = np.random.default_rng(5)
    for percent, n in ((85, 37), (85, 370), (80, 36)):
        misses, common_, own = 0, int(round(2 * n * percent / (100 + percent))), None
        own = n - common_
        for _ in range(300):
            u = rng.integers(0, 2**63, n + own, dtype=np.uint64)
            sig = bands(signatures(np.concatenate([u[:n], u[own:]]), np.array([0, n, 2 * n]), band_count(percent) * near_dedup.ROWS), near_dedup.ROWS)
            misses += not (sig[0] == sig[1]).any()
        assert misses == 0


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near = text + " end"
    rows = [(1, text), (2, "quite another text of its own here"), (2, near), (None, text), (None, near), (3, near), (3, near), (4, None), (4, "")]
    left = sorted(((str(r["doc_id"]), r["text"]) for r in keep_first(docs(spark, rows)).collect()), key=str)
    assert left == sorted([("1", text), ("2", rows[1][1]), ("None", text), ("None", near), ("4", None), ("4", "")], key=str)
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs(spark, rows)).collect()}
    assert found == {(1, 1, True), (2, 2, True), (2, 1, False), (None, None, True), (3, 1, False), (4, 4, True)}


def test_hot_keys_are_spread(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(1000 + F.floor(F.col("id") / 6)).alias("k"), "id").unionByName(spark.createDataFrame([(None, 5)], "k long, id long"))
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1 and k is not null")
    got = common.join_spread(rows, keyed, ["k"], "n", ["id"])
    assert {(r["k"], r["n"], r["first"]) for r in got.where("hot").collect()} == {(7, 1333, 1)} and got.where("hot").count() == 1333
    assert got.where("not hot").count() == 666 and {r["n"] for r in got.where("not hot").collect()} == {2}
    assert common.join_spread(rows, keyed, ["k"], "n", ["id"], how="left").where("n is null").count() == 2
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = got.select(F.spark_partition_id().alias("p"), "id").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in sizes) < 800


def test_near_duplicates_plans_stay_small(spark, monkeypatch):
    """What the driver holds of a step is its plan: steps of dense buckets don't stand in each other."""
    monkeypatch.setattr(near_dedup, "TURNS", 0)
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.012 else f"x{rng.randrange(10**6)}" for w in base)) for i in range(150)]
    exchanges, dense = {}, []

    def counted(df, name):
        shown = df._jdf.queryExecution().executedPlan().toString()
        exchanges[name] = max(exchanges.get(name, 0), shown.count("Exchange"))
        return common.materialise(df, name)

    monkeypatch.setattr(near_dedup, "materialise", counted)
    links = near_dedup._dense_links
    monkeypatch.setattr(near_dedup, "_dense_links", lambda *a: dense.append(1) or links(*a))
    near_duplicates(docs(spark, rows), percent=85).collect()
    assert dense and "dealt" in exchanges
    assert max(exchanges.values()) <= 24, exchanges


def test_block_links_form_a_spanning_forest():
    rng = np.random.default_rng(0)
    core = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([core[: 100 - k], rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in (0, 3, 5, 60, 0)]
    links = block_links(np.arange(5), np.arange(5), sets, 85)
    assert {frozenset(x) for x in links} <= {frozenset((a, b)) for a in (0, 1, 2, 4) for b in (0, 1, 2, 4)} and len(links) == 3
    assert block_links(np.arange(2), np.zeros(2, dtype=int), sets[:2], 85) == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 40, 3000):
        u = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        c = n * 2 // 3
        a, b = u[:n], np.concatenate([u[n - c : n], u[n : 2 * n - c]])
        sig = signatures(np.concatenate([a, b, a[::-1]]), np.array([0, n, 2 * n, 3 * n]), 600)
        assert (sig[0] == sig[2]).all()
        assert abs((sig[0] == sig[1]).mean() - c / (2 * n - c)) < 0.08
    assert (signatures(np.zeros(0, dtype=np.uint64), np.array([0, 0]), 8) == np.iinfo(np.uint64).max).all()
    assert (1 - 0.85**6) ** band_count(85) <= 1e-6 and (1 - 0.8**6) ** band_count(80) <= 1e-6


@pytest.mark.parametrize("few", [components.FEW, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    edges = [(1, 2), (2, 3), (7, 6), (6, 5), (5, 4), (9, 9), (None, 1)] + [(k, k + 1) for k in range(100, 140)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).distinct().collect()}
    want = {1: 1, 2: 1, 3: 1, **dict.fromkeys(range(4, 8), 4), **dict.fromkeys(range(100, 141), 100)}
    assert got == want
    assert connected_components(df.limit(0)).count() == 0


# ---- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(rows, bench):
    wins = defaultdict(set)
    for i, t in bench:
        w = words(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[j : j + 10])].add(str(i))
    out = {}
    for d, t in rows:
        w, hit, items = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        out[d] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("limit", [1 << 24, 60])
def test_contamination_against_brute_force(spark, limit):
    rnd = random.Random(2)
    pool = ["a", "B", "c1", "é", "漢字", "x_y", "d-e"]
    text = lambda n: " ".join(rnd.choice(pool) for _ in range(n))
    bench = [(1, text(14)), (2, text(3)), (10, text(25)), (11, None), (12, "--"), (13, text(10))]
    rows = [(i, text(rnd.randint(0, 60))) for i in range(40)] + [(50, None), (51, ""), (52, "Zz. " + bench[2][1].replace(" ", ", ") + "! zz"), (53, bench[0][1] + " " + bench[0][1])]
    got = by_id(contamination(docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), limit=limit), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute_hits(rows, bench)


@pytest.mark.parametrize("limit", [1 << 24, 1])
def test_contamination_says_where(spark, limit):
    bench = [(1, "one two three"), (2, "three four five"), (3, "six seven eight"), (4, "p q r")]
    rows = [(1, "x one TWO three y"), (2, "one two three four five x six seven eight p q r x one two three"), (3, "nothing"), (4, None)]
    out = by_id(contamination(docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), limit=limit), "spans", "n_hit")
    spans = {i: [tuple(x) for x in found] for i, (found, _) in out.items()}
    assert spans == {1: [(1, 4)], 2: [(0, 5), (6, 12), (13, 16)], 3: [], 4: []}
    assert all(n == sum(e - b for b, e in spans[i]) for i, (_, n) in out.items())


def brute_longest(rows, bench):
    out = {}
    for d, t in rows:
        w, best, at = words(t), 0, None
        for i in range(len(w)):
            for _, b in bench:
                v = words(b)
                for j in range(len(v)):
                    k = 0
                    while i + k < len(w) and j + k < len(v) and w[i + k] == v[j + k]:
                        k += 1
                    if k > best:
                        best, at = k, i
        out[d] = (best, at)
    return out


@pytest.mark.parametrize("limit", [1 << 24, 60])
@pytest.mark.parametrize("pool", [2, 7])
def test_longest_matches_against_brute_force(spark, limit, pool):
    rnd = random.Random(pool)
    text = lambda n: " ".join(f"w{rnd.randrange(pool)}" for _ in range(n))
    bench = [(1, text(14)), (2, text(3)), (10, text(25)), (11, None), (12, "--")]
    rows = [(i, text(rnd.randint(0, 50))) for i in range(25)] + [(50, None), (51, ""), (52, "none of it"), (53, f"{bench[2][1]} x {bench[2][1]}"), (54, "w0 " * 300)]
    got = by_id(contamination(docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), limit=limit), "longest_match", "longest_at")
    assert got == brute_longest(rows, bench)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), max_size=30).map(" ".join), max_size=5))
def test_suffix_array_is_sorted(texts):
    shard = Shard([t.encode() for t in texts])
    ids = shard.ids.tolist()
    assert shard.order.tolist() == sorted(range(len(ids)), key=lambda i: ids[i:])


def test_decontamination_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TINY}/{name}.parquet'")
    columns = ["doc_id", "n_hit", "n_items", "items_sha256", "longest_match", "hit_spans"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({DECONTAMINATE_SQL})").fetchall()
    assert sorted(map(tuple, op4_decontaminate(spark, TINY).select(columns).collect())) == sorted(want)


def test_clean_rows_stay_whatever_their_ids(spark):
    bench = spark.createDataFrame([(1, "one two three"), (None, "clean"), (3, None)], "item_id long, text string")
    rows = [(None, "x one two three"), (None, "clean"), (1, "one, two, THREE"), (2, "clean words"), (2, "one two three"), (3, None), (4, ""), (5, "one two " * 20_000), (6, "z " * 30_000 + "one two three")]
    left = keep_clean(docs(spark, rows), bench)
    assert sorted(((str(r["doc_id"]), (r["text"] or "")[:12]) for r in left.collect())) == [("2", "clean words"), ("3", ""), ("4", ""), ("5", "one two one "), ("None", "clean")]
    assert left.columns == docs(spark, rows).columns and keep_clean(docs(spark, rows).limit(0), bench).count() == 0
    assert keep_clean(docs(spark, rows), bench.limit(0)).count() == len(rows)


def test_contamination_edges(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    out = contamination(docs(spark, [(1, "x one TWO three"), (1, "x one TWO three"), (None, "one two")]), bench).collect()
    assert [r["contaminated"] for r in sorted(out, key=lambda r: str(r["doc_id"]))] == [True, True, False]
    assert contamination(docs(spark, [(1, "a")]), bench.limit(0)).first()["n_hit"] == 0
    assert contamination(docs(spark, [(1, "a")]).limit(0), bench).count() == 0


# ---- suffix dedup


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=120), st.integers(1, 40), st.integers(0, 16), st.data())
def test_deep_shallow_sorts(text, limit, shallow, data):
    raw = text.encode()
    n = len(raw) - limit + 1
    if n <= 0:
        return
    starts = np.array(data.draw(st.lists(st.integers(0, n - 1), max_size=30)), dtype=np.int64)
    bucket = starts % 2
    perm, cls = deep_shallow(Text(raw), starts, bucket, limit, shallow)
    key = [(int(b), raw[s : s + limit]) for s, b in zip(starts, bucket, strict=True)]
    assert perm.tolist() == sorted(range(len(key)), key=lambda i: (key[i], i))
    assert (cls[1:] == cls[:-1]).tolist() == [key[a] == key[b] for a, b in zip(perm[1:], perm[:-1], strict=True)]


def brute_removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1))
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("least", [common.HOT_LEAST, 0])
@pytest.mark.parametrize("block", [suffix_dedup.BLOCK_BYTES, 3000])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, block, least):
    monkeypatch.setattr(common, "HOT_LEAST", least)
    monkeypatch.setattr(suffix_dedup, "HOT", common.HOT if least else 10**6)  # every repeated anchor is hot
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 1500 if block == 3000 else suffix_dedup.GROUP_BYTES)
    rnd = random.Random(block)
    base = "".join(rnd.choice("abcdé ") for _ in range(500))
    make = [lambda: "a" * rnd.randint(90, 400), lambda: base[rnd.randint(0, 380) :][: rnd.randint(50, 300)], lambda: "ab" * rnd.randint(40, 200), lambda: "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 200))) + base[100:280] + "z" * rnd.randint(0, 5), lambda: "", lambda: None, lambda: base * 6]
    rows = [(i, rnd.choice(make)()) for i in range(80)]
    got = by_id(dedup(docs(spark, rows, 5)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_removed(rows)


def test_first_equal_segments():
    rnd = random.Random(5)
    data = bytes(rnd.choice(b"ab") for _ in range(4000))
    starts = np.array([rnd.randrange(3900) for _ in range(3000)])
    sizes, alike = (np.array([rnd.randint(*x) for _ in starts]) for x in ((1, 24), (0, 2)))
    seen: dict = {}
    wanted = [seen.setdefault((data[a : a + n], k), i) for i, (a, n, k) in enumerate(zip(starts.tolist(), sizes.tolist(), alike.tolist(), strict=True))]
    assert suffix_dedup.first_equals(Text(data), starts, sizes, alike).tolist() == wanted
    none = np.zeros(0, dtype=np.int64)
    assert suffix_dedup.first_equals(Text(b""), none, none, none).tolist() == []


def test_suffix_dedup_edges(spark):
    long = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    rows = [(None, long), (1, long), (1, long), (2, long), (3, "short"), (4, "short")]
    out = sorted(((str(r["doc_id"]), r["n_removed"]) for r in dedup(docs(spark, rows)).collect()))
    assert out == [("1", 0), ("1", 0), ("2", len(long)), ("3", 0), ("4", 0), ("None", 0)]
    assert dedup(docs(spark, rows).limit(0)).count() == 0
    assert dedup(docs(spark, [(1, long), (2, "q" + long)]), digest=False).where("doc_id = 2").first()["kept"] == b"q"
