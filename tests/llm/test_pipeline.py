"""The pipeline's stages: what each keeps, and each against its operator."""

import hashlib
import re
import string

from tokenizers import Tokenizer

import corpus_pipeline as cp
from rivulet.llm.bpe import tokenizer_path
from rivulet.llm.common import materialise
from rivulet.llm.decontaminate import contamination
from rivulet.llm.near_dedup import near_duplicates
from rivulet.llm.quality_rules import fit, quality_rules

TINY = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in cp.STAGES:
        before, docs = docs, materialise(stage(spark, docs, TINY), name)
        kept.append((name, before, docs))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert [n for n, _, _ in kept] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    assert all(after.columns == columns for _, _, after in kept[:-1])
    assert ids(kept[0][2]) == ids(quality_rules(kept[0][1], fit(kept[0][1], spark.read.parquet(f"{TINY}/labels.parquet"))).where("kept"))
    assert all(r["n_chars"] == len(r["text"]) for r in kept[1][2].collect())
    assert ids(kept[2][2]) == ids(near_duplicates(kept[2][1]).where("kept"))
    assert ids(kept[3][2]) == ids(kept[3][1]) - ids(contamination(kept[3][1], spark.read.parquet(f"{TINY}/benchmark.parquet")).where("contaminated"))
    assert ids(kept[4][2]) == ids(kept[3][2])
    assert sorted(map(tuple, cp.run(spark, TINY).collect())) == sorted(map(tuple, docs.collect()))


def test_empty_and_odd_rows(spark):
    rows = [(1, None, "en", "s", 0, "x"), (2, "", "en", "s", 0, "x"), (None, "a b " * 60, "en", "s", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone string")
    for part in (docs, docs.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, part, TINY)
            assert out.columns == docs.columns
            out.collect()


def odd(spark, rows):
    """Rows (id, text) with columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, m string, h long").repartition(3)


def stays(spark, name, rows):
    out = dict(cp.STAGES)[name](spark, odd(spark, rows), TINY)
    assert out.columns == odd(spark, rows).columns
    return sorted(((r["doc_id"] or 0, r["text"]) for r in out.collect()), key=repr)


def kept(rows, *gone):
    return sorted(((i or 0, t) for k, (i, t) in enumerate(rows) if k not in gone), key=repr)


def test_near_dedup_keeps_rows_by_their_text(spark):
    base = " ".join(f"w{i}" for i in range(50))
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, base), (2, "quite another one"), (2, base + " end"), (None, base), (3, base), (3, base), (4, None), (4, ""), (5, long), (6, long + " end"), (1, base)]
    assert stays(spark, "near_dedup", rows) == kept(rows, 2, 4, 5, 9)


def test_decontamination_keeps_rows_by_their_text(spark):
    item = spark.read.parquet(f"{TINY}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    long = "z " * 50_000
    rows = [(None, f"x {item}"), (None, "clean"), (1, item), (2, "clean too"), (2, f"{item} y"), (3, None), (3, ""), (4, long), (5, long + item), (2, "clean too")]
    assert stays(spark, "decontaminate", rows) == kept(rows, 0, 2, 4, 8)


def test_quality_rules_keep_rows_by_their_text(spark):
    good = spark.read.parquet(f"{TINY}/documents.parquet")
    judged = quality_rules(good, fit(good, spark.read.parquet(f"{TINY}/labels.parquet"))).where("kept and n_words < 2000")
    text = good.join(judged.select("doc_id"), "doc_id").orderBy("doc_id").first()["text"]
    junk = "w " * 40_000
    rows = [(None, text), (None, "short"), (1, text), (1, junk), (1, text), (2, None), (3, ""), (4, junk)]
    assert stays(spark, "quality_rules", rows) == kept(rows, 1, 3, 5, 6, 7)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lines_removed(rows):
    """rows (id, text) without repeats: {(id, text): text without its repeated pairs of lines}."""
    first, out = {}, {}
    usable = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    for i, t in usable:
        lines = t.split("\n")
        for k in range(len(lines) - 1):
            first.setdefault((lines[k], lines[k + 1]), (i, k))
    for i, t in usable:
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 1):
            at = first[lines[k], lines[k + 1]]
            if re.search(r"\S", lines[k] + lines[k + 1]) and at != (i, k) and not (at[0] == i and k <= at[1] + 1):
                gone |= {k, k + 1}
        out[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t
    return out


def line_stage(rows):
    left = lines_removed(rows)
    out = []
    for i, t in rows:
        now = left.get((i, t), t)
        n, was = len(words(now)), len(words(t))
        if now == t or (n >= 50 and 100 * n > 20 * was):
            out.append((i, now))
    return out


def near_stage(rows, percent=80):
    sets = []
    for _, t in rows:
        w = [x.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) for x in words(t)]
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    for a, b in {(a, b) for ks in where.values() for a in ks for b in ks if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return [r for k, r in enumerate(rows) if r[0] == least[find(k)]]


def clean_stage(rows, items):
    fold = lambda t: [x.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))]
    windows = set()
    for t in items:
        w = fold(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    return [r for r in rows if not hit(fold(r[1]))]


def test_whole_pipeline_by_brute_force(spark):
    """All stages behind the learned one, which is taken as it is, in plain Python and the tokenizers library."""
    library = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in cp.quality_rules(spark, docs, TINY).collect())
    stripped = line_stage(rows)
    assert len(stripped) < len(rows) and all(len(words(t)) >= 50 for _, t in stripped)
    kept = near_stage(stripped)
    items = [r["text"] for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    clean = clean_stage(kept, items)
    want = []
    for i, t in clean:
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = cp.run(spark, TINY)
    assert sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want


def test_line_dedup_drops_what_little_is_left_of(spark):
    passage = "one line of it\nanother line of it"
    own = "\n".join(f"own {i} words here" for i in range(20))
    long = "\n".join(f"line {i}" for i in range(30_000))
    much = "\n".join(f"shared line number {i} of many" for i in range(100))
    rows = [(1, passage + "\n" + own), (2, own + "x\n" + passage), (None, passage), (3, None), (4, ""), (2, "other\n" + passage), (5, long), (6, long), (7, much), (8, much + "\n" + own.replace("own", "new")), (9, "short"), (9, "short")]
    got = stays(spark, "line_dedup", rows)
    want = [(i or 0, t) for i, t in line_stage(rows)]
    assert got == sorted(want, key=repr)
    assert {i for i, _ in got} == {0, 1, 3, 4, 5, 7, 9}
