"""Classifiers on held-out rows, tokenizing against the library, files against round trips."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivulet.llm import bpe, gbt, language_id, quality_fm, quality_rules, token_files, toxicity, training
from rivulet.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.01"


def frame(spark, rows):
    full = [(i, t, "a", 1.0, 2, True) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, score string, x double, y int, kept boolean")


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "é"), (5, "12 !!"), (6, "w " * 40_000), (7, "z" * 300_000), (8, "the cat"), (8, "the cat"), (None, "the cat")]


def checked(spark, name, label):
    got = QUERIES[name](spark, SMALL)
    assert got.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").withColumnRenamed(label, "truth")
    pdf = got.join(labels.select("doc_id", "truth"), "doc_id").toPandas()
    assert pdf["score"].between(0, 1).all() if "score" in pdf else True
    return pdf


@pytest.mark.parametrize(("name", "label", "modulus", "held", "least"), [("op3_toxicity", "toxic", 5, 0, 0.9), ("op5_quality_fm", "quality", 3, 1, 0.95)])
def test_held_out_accuracy(spark, name, label, modulus, held, least):
    pdf = checked(spark, name, label)
    assert (pdf["held_out"] == [zlib.crc32(str(i).encode()) % modulus == held for i in pdf["doc_id"]]).all()
    assert (pdf["predicted"] == (pdf["score"] >= 0.5)).all()
    out = pdf[pdf["held_out"]]
    assert (out["predicted"] == out["truth"]).mean() >= least
    assert out[(out["truth"] == 0) & (label == "toxic")]["predicted"].sum() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    pdf = QUERIES["op7_language_id"](spark, SMALL).join(docs, "doc_id").toPandas()
    out = pdf[pdf["held_out"]]
    assert (out["lang"] == out["lang_pred"]).mean() >= 0.98


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    ids = [r["doc_id"] for r in training.labelled(docs, labels, "toxic", 5, 0).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 5 != 0 for i in ids)
    assert training.labelled(docs, labels, "toxic", 5, 0, 10).count() == 10


def test_ids_with_clashing_labels_do_not_train(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(1, 9)] + [(3, "a text"), (None, "t")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    assert sorted(map(tuple, training.labelled(docs, labels, "toxic", 0, 0).collect())) == [(1, "t1", 1), (3, "a text", 0)]
    flags = docs.select(training.held_out(5, 0).alias("h")).collect()
    assert all(r["h"] is not None for r in flags) and not flags[-1]["h"]


def test_large_languages_are_bounded_before_they_are_dealt(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 > 0, "en").otherwise(F.concat(F.lit("x"), F.col("id") % 50)).alias("lang"))
    got = {r["lang"]: r["count"] for r in training.least_hashes(rows, 30, "lang").groupBy("lang").count().collect()}
    assert got == {"en": 30, **{f"x{i}": 30 for i in range(0, 50, 5)}}


def test_registered_digests_equal_the_library(spark):
    library = bpe.Coder(bpe.tokenizer_path()).split.tokenizer
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in QUERIES["op6_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_models_on_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    docs = frame(spark, EDGES)
    for df in (toxicity.toxicity(docs, toxicity.fit(docs, labels)), quality_fm.quality_scores(docs, quality_fm.fit(docs, labels)), quality_rules.quality_rules(docs, quality_rules.fit(docs, labels))):
        scores = [r["score"] for r in df.collect()]
        assert len(scores) == len(EDGES) and all(0 <= s <= 1 for s in scores)
    none = labels.limit(0)
    for df in (toxicity.toxicity(docs, toxicity.fit(docs, none)), quality_fm.quality_scores(docs, quality_fm.fit(docs, none)), quality_rules.quality_rules(docs.limit(0), quality_rules.fit(docs, none))):
        df.collect()
    with_lang = docs.withColumn("lang", F.when(F.col("doc_id") == 4, None).otherwise("en"))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(with_lang, language_id.fit(with_lang)).collect()}
    assert [got[i] for i in (1, 2, 3, 5)] == ["und"] * 4 and got[8] == "en"
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.Network([])).collect()} == {"und"}


def test_statistics_against_brute_force(spark):
    def brute(t):
        t = t or ""
        words, cur = [], ""
        for ch in t + " ":
            if ch in " \t\n\x0b\x0c\r":
                words += [cur] if cur else []
                cur = ""
            else:
                cur += ch
        tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        return (len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(hit), failed)

    rows = [(1, None), (2, ""), (3, "a b c a b c\na b c\n\n \na b c a b c"), (4, "é# ü|x 漢字 \x1c y\n" * 30), (5, " ".join(f"w{i}" for i in range(60))), (6, "x y z " * 40)]
    rows += [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect() if len(r["text"]) < 9000]
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality_rules.quality_rules(frame(spark, rows), gbt.fit(np.zeros((0, 14)), np.zeros(0))).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_trees_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.2, 3000)) > 0.5).astype(float)
    trees = gbt.fit(x[:2000], y[:2000], monotone={0: 1})
    assert ((trees.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.93
    grid = np.repeat(x[:50], 20, axis=0)
    grid[:, 0] = np.tile(np.linspace(-3, 3, 20), 50)
    assert (np.diff(trees.score(grid).reshape(50, 20), axis=1) >= -1e-12).all()
    kx, ky = gbt.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert (np.diff(ky) >= 0).all() and np.interp(0.25, kx, ky) == pytest.approx(0.5)


def test_pair_sum_identity():
    m = quality_fm.Machine(np.zeros(1), np.ones(1))
    m.v = np.random.default_rng(0).normal(size=m.v.shape).astype(np.float32)
    x = np.zeros((1, len(m.w)), dtype=np.float32)
    x[0, [3, 9, 40]] = [0.5, -1, 2]
    v = m.v
    want = sum(x[0, i] * x[0, j] * (v[i] @ v[j]) for i, j in ((3, 9), (3, 40), (9, 40)))
    assert m.raw(x)[0] == pytest.approx(want, rel=1e-4)


def test_folded_tables_equal_plain_convolution():
    net = language_id.Network(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (5, language_id.WINDOW), dtype=np.uint8)
    top, _ = net._pooled(x)
    z = np.maximum(top + net.bias, 0) @ net.out + net.out_bias
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(net.probabilities(x, net.fold_pairs()), p, atol=1e-5)


# ---- tokens

PARTS = st.sampled_from(["a", "the", "Ing", "É", "ß", "İ", "Σ", "é", "ñ", "1", "٣", "½", "漢", "한", "ᄀ", " ", "\n", "\x1c", "\x85", "'s", "'LL", "<|endoftext|>", "<|", "!!", "#", "ﬁ", "K", "aaaaaaa", "\x00", "’", "👩‍👧", "Ω", "."])


@pytest.fixture(scope="module")
def coders():
    path = bpe.tokenizer_path()
    return bpe.Coder(path), token_files.LibraryCoder(path)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_coders_equal_the_library(coders, text):
    own, library = coders
    want = own.split.tokenizer.encode(text, add_special_tokens=False).ids
    ids, shown = next(own.texts([text]))
    assert ids == " ".join(map(str, want))
    assert shown == own.split.tokenizer.decode(want, skip_special_tokens=False)
    assert np.frombuffer(library.encode([text])[0], dtype=library.kind).tolist() == want


def test_encode_documents(spark):
    want = bpe.Coder(bpe.tokenizer_path()).split.tokenizer.encode_batch([t or "" for _, t in EDGES], add_special_tokens=False)
    rows = bpe.encode_documents(frame(spark, EDGES).coalesce(1), out="ids").collect()
    assert [r["ids"] for r in rows] == [e.ids for e in want]
    assert bpe.encode_documents(frame(spark, EDGES).limit(0)).count() == 0


def test_decode_documents(spark):
    coded = bpe.encode_documents(frame(spark, EDGES), out="ids").cache()
    got = sorted((str(r["doc_id"]), r["decoded"]) for r in bpe.decode_documents(coded).collect())
    assert got == sorted((str(r["doc_id"]), r["decoded"]) for r in coded.collect())
    text = {r["doc_id"]: r["decoded"] for r in bpe.decode_documents(coded, restore=True).collect()}
    assert text[8] == "the cat " and text[4] == "é " and text[5] == "1 2 !! " and text[1] == ""
    odd = spark.createDataFrame([(1, [0, -5, 10**6]), (2, None)], "doc_id long, ids array<int>")
    assert sorted(map(tuple, bpe.decode_documents(odd).collect())) == [(1, "!"), (2, None)]


def test_merging_one_place_at_a_time_where_it_matters():
    # (a, b) ranks after (ab, c), which it makes possible: only the first place may be merged at once
    spec = {"added_tokens": [], "model": {"end_of_word_suffix": "", "vocab": {c: i for i, c in enumerate(dict.fromkeys([*bpe.byte_symbols(), "ab", "abc", "ca"]))}, "merges": [["ab", "c"], ["c", "a"], ["a", "b"]]}}
    m = bpe.Merges(spec)
    assert m.safe.tolist() == [True, True, False]
    shown = [m.tokens[i] for i in m.encode([b"abcab"])[0]]
    assert shown == ["ab", "ca", "b"] or shown == ["a", "b", "ca", "b"]
    assert m.encode([b"", b"aaa"])[0].tolist() == []


@pytest.mark.parametrize("length", [16, 4096])
def test_token_files_round_trip(spark, tmp_path, monkeypatch, length):
    monkeypatch.setattr(token_files, "ROWS", 3)
    docs = frame(spark, EDGES).repartition(3)
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/out", length=length)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(manifest).collect()))
    library = bpe.Coder(bpe.tokenizer_path()).split.tokenizer
    want, at = [], 0
    for i, t in sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    shard = token_files.Shard(max(manifest.collect(), key=lambda r: r["n_tokens"])["path"])
    total = sum(int(shard.mask(i).sum()) for i in range(sum(shard.seq.get_batch(k).num_rows for k in range(shard.seq.num_record_batches))))
    assert total == max(r["n_tokens"] for r in manifest.collect())
    assert len(shard.sequence(0)) == length and shard.seq.schema.field("ids").type == pa.list_(pa.uint16(), length)
    assert token_files.write_token_files(docs.limit(0), f"file://{tmp_path}/none").count() == 0
