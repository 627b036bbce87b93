"""Features and scores of operators 3, 5 and 7 against plain loops over words, pairs and bytes."""

import math
import random

import numpy as np
import pytest

from rivulet.llm import gbt, language_id, quality_fm, toxicity
from rivulet.llm.docstats import Counts
from rivulet.llm.shingles import WordHasher

HASHER = WordHasher()


def one_hash(word):
    return int(HASHER.words(word)[0][0])


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


# ---- toxicity

BAD, BEGIN = {"idiot", "stupid"}, {4: {"moro", "trol"}, 5: {"loser"}, 6: {"stupid"}}


def lexicons():
    """The words, and beginnings by their hash as the operator cuts them."""
    kinds = [[one_hash(w.encode()) for w in BAD]]
    for at, k in enumerate(toxicity.PREFIXES):
        heads = [HASHER.words_and_prefixes(w.encode() + b"zzzz", toxicity.PREFIXES)[2][at][0] for w in BEGIN[k]]
        kinds.append([int(h) for h in heads])
    return toxicity.Lexicons([np.array(k, dtype=np.uint64) for k in kinds])


def hits(words):
    """For each kind, which words it hits."""
    return [[w in BAD for w in words], *[[len(w.encode()) >= k and w.encode()[:k].decode(errors="replace") in BEGIN[k] for w in words] for k in toxicity.PREFIXES]]


def folded(text, table):
    return "".join(c.lower() if c.isascii() else c for c in text).encode().translate(table).decode().split()


def brute_toxicity(text):
    words = text.split()
    plain = folded(text, toxicity._STRIP)
    n, chars = max(len(words), 1), max(sum(map(len, words)), 1)
    kinds = hits(plain)
    out = []
    for k in kinds:
        out += [math.log1p(sum(k)), sum(k) / n]
    some = [any(k[i] for k in kinds) for i in range(len(plain))]
    you = [w in toxicity.SECOND_PERSON for w in plain]
    near = [s and any(you[max(i - 5, 0) : i + 6]) for i, s in enumerate(some)]
    out += [sum(some) / n, sum(near) / n, sum(you) / n]
    looks = hits(folded(text, toxicity._LOOKS))
    out += [max(sum(looks[k]) - sum(kinds[k]), 0) / n for k in (0, 2)]
    b = text.encode()
    letter = [chr(x).isalpha() and x < 128 for x in b] + [False]
    padded = b + b"\n"
    inside = sum(letter[i - 1] and letter[i + 1] and not letter[i] and 0x20 < b[i] < 0x80 for i in range(1, len(b)))
    stretched = sum(letter[i] and b[i] == b[i - 1] == b[i - 2] for i in range(2, len(b)))
    apart = sum(letter[i] and (i == 0 or b[i - 1] <= 0x20) and padded[i + 1] <= 0x20 for i in range(len(b)))
    return [*out, inside / chars, stretched / chars, apart / chars]


def test_toxicity_features():
    rnd = random.Random(1)
    parts = ["you", "idiot", "IDIOT!", "1d10t", "i.d.i.o.t", "stupid", "stupidity", "loserly", "trolls", "sooo", "a", "café", "漢字", "tu", "fine", "words", "x_y", "\n", "$tupid"]
    texts = [" x " + " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) + " y" for _ in range(40)] + ["", None]
    got = toxicity.dense_features([t if t is None else t.encode() for t in texts], lexicons(), HASHER)
    want = [brute_toxicity(t or "") for t in texts]
    assert np.allclose(got[:, : len(want[0])], want)
    alone = np.concatenate([toxicity.dense_features([t if t is None else t.encode()], lexicons(), HASHER) for t in texts])
    assert np.allclose(got, alone)


def test_toxicity_scores(spark):
    texts = ["you idiot", "fine words", "", None, "stupid " * 50]
    x = toxicity.dense_features([(t or "").encode() for t in texts], lexicons(), HASHER)
    y = np.array([1, 0, 0, 0, 1] * 40, dtype=float)
    trees = gbt.fit(np.tile(x, (40, 1)), y, monotone=toxicity.MONOTONE, trees=5)
    model = toxicity.Model(lexicons(), trees, gbt.isotonic(trees.score(np.tile(x, (40, 1))), y))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.toxicity(frame(spark, texts), model).collect()}
    for i in range(len(texts)):
        score = model.score(x[i : i + 1])[0]
        assert got[i] == (pytest.approx(score), int(score >= 0.5))


# ---- factorisation machine


def test_quality_scores_by_all_pairs(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["alpha", "beta", "é", "x#y", "12", "Z"]) for _ in range(n)) for n in (1, 5, 40, 700)] + ["", None]
    dense = np.concatenate([quality_fm.structure(Counts([None if t is None else t.encode()], HASHER)) for t in texts])
    machine = quality_fm.Machine(dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3))
    rng = np.random.default_rng(3)
    machine.w, machine.v, machine.bias = rng.normal(0, 0.3, machine.w.shape).astype(np.float32), rng.normal(0, 0.3, machine.v.shape).astype(np.float32), 0.1
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality_fm.quality_scores(frame(spark, texts), machine).collect()}
    for i, text in enumerate(texts):
        counts: dict[int, int] = {}
        for w in (text or "").split():
            k = one_hash(w.encode()) >> 53
            counts[k] = counts.get(k, 0) + 1
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values())) or 1.0
        x = {k: math.log1p(c) / norm for k, c in counts.items()}
        for j, v in enumerate(dense[i]):
            x[quality_fm.BUCKETS + j] = min(max((v - machine.mean[j]) / machine.scale[j], -4), 4) / 2
        keys = sorted(x)
        raw = machine.bias + sum(float(machine.w[k]) * x[k] for k in keys)
        raw += sum(float(machine.v[a] @ machine.v[b]) * x[a] * x[b] for n, a in enumerate(keys) for b in keys[n + 1 :])
        assert got[i][0] == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-4)
        assert got[i][1] == int(got[i][0] >= 0.5)


# ---- language ID


def test_language_scores_by_plain_convolution(spark):
    net = language_id.Network(["de", "en", "fr"])
    rng = np.random.default_rng(4)
    net.bias = rng.normal(0, 0.1, net.bias.shape).astype(np.float32)
    texts = ["The Cat", "12 !!", "", None, "Été " * 60, "w" * 300, "漢字"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(frame(spark, texts), net).collect()}
    for i, text in enumerate(texts):
        if not text or not any(c.isalpha() for c in text):
            assert got[i] == ("und", 0.0)
            continue
        data = "".join(c.lower() if c.isascii() else c for c in text).encode()
        total = np.zeros(3)
        windows = [data[k : k + language_id.WINDOW].ljust(language_id.WINDOW, b"\0") for k in range(0, len(data), language_id.WINDOW)]
        for w in windows:
            pooled = []
            for table in net.tables:
                for f in range(language_id.FILTERS):
                    pooled.append(max(sum(float(table[j][w[p + j]][f]) for j in range(len(table))) for p in range(len(w) - len(table) + 1)))
            act = np.maximum(np.array(pooled) + net.bias, 0)
            z = act @ net.out + net.out_bias
            total += np.exp(z) / np.exp(z).sum()
        mean = total / len(windows)
        assert got[i] == (net.langs[int(mean.argmax())], pytest.approx(mean.max(), abs=1e-4))
