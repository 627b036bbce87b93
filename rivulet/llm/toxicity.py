"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicons are learned from labelled texts: words, and word beginnings of 4 to 6 bytes,
that toxic texts hold far more often than others.  Features are the lexicons' densities, as
written and with look-alike characters read as letters, the share of hits near a word of the
second person, and rates of capitals, punctuation, symbols inside words, stretched letters
and letters set apart.  No step is fitted on what an earlier one has seen: each half of the
bounded sample gets its densities from the lexicons of the other half, and a fifth of the
sample, kept apart, gives the calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import gbt
from .common import groups, table, utf8
from .docstats import Counts
from .shingles import WordHasher
from .training import SAMPLE, held_out, labelled

#: Words of the second person in English, French, German and Spanish.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch ti usted ustedes tus vosotros".split()
PREFIXES = (4, 5, 6)
#: Least number of toxic texts with an entry (a fiftieth of them, within these bounds), least
#: log-odds, most entries of a lexicon.
MIN_TOXIC, MIN_ODDS, MOST = (3, 6), 3.0, 4_000
_PUNCT = b".,;:!?\"'()[]{}<>#*$%&|_-~`/\\+="
_STRIP = bytes.maketrans(_PUNCT, b" " * len(_PUNCT))
#: Characters that stand for letters.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
_LOOKS = bytes.maketrans("".join(LOOK_ALIKE).encode() + b".,;:?\"'()[]{}<>#%&", "".join(LOOK_ALIKE.values()).encode() + b" " * 18)
NEAR = 5


class Lexicons:
    """Sorted hashes by kind (whole word, then each prefix size)."""

    def __init__(self, kinds: list[np.ndarray]) -> None:
        self.kinds = [np.unique(k.astype(np.uint64)) for k in kinds]
        self.maybe = []
        for k in self.kinds:
            t = np.zeros(1 << 16, dtype=bool)
            t[k >> np.uint64(48)] = True
            self.maybe.append(t)

    def hits(self, kind: int, h: np.ndarray) -> np.ndarray:
        out = self.maybe[kind][h >> np.uint64(48)]
        at = np.flatnonzero(out)
        lex = self.kinds[kind]
        if len(at):
            got = h[at]
            out[at] = lex[np.minimum(np.searchsorted(lex, got), len(lex) - 1)] == got
        return out


def _tokens(texts: list[bytes | None], hasher: WordHasher, to: bytes) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Word starts' text numbers, the hashes by kind, and the words' lengths."""
    lens = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
    buf = b"\n".join(t or b"" for t in texts).lower().translate(to)
    whole, starts, heads = hasher.words_and_prefixes(buf, PREFIXES)
    owner = np.searchsorted(np.cumsum(lens + 1), starts, side="right")
    return owner, [whole, *heads], starts


def learn_lexicons(sample: DataFrame) -> Lexicons:
    """From (text, y).  Counts of texts by hash are summed in Spark; at most MOST entries of a
    kind come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in groups(batches):
            y = np.asarray(batch.column(1))
            owner, kinds, _ = _tokens(utf8(batch.column(0)), hasher, _STRIP)
            for kind, h in enumerate(kinds):
                pair = np.unique(np.stack([h, owner.astype(np.uint64)], axis=1), axis=0)
                pair = pair[pair[:, 0] != 0]
                values, at = np.unique(pair[:, 0], return_inverse=True)
                toxic = np.bincount(at, y[pair[:, 1].astype(np.int64)], len(values)).astype(np.int64)
                total = np.bincount(at, minlength=len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), kind, dtype=np.int32)), pa.array(values.view(np.int64)), pa.array(toxic), pa.array(total)], names=["kind", "h", "toxic", "total"])

    n = sample.agg(F.count(F.lit(1)), F.sum("y")).first()
    n_all, n_toxic = n[0] or 0, n[1] or 0
    counts = sample.select("text", "y").mapInArrow(run, "kind int, h long, toxic long, total long").groupBy("kind", "h").agg(F.sum("toxic").alias("t"), F.sum("total").alias("n"))
    odds = F.log((F.col("t") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / F.lit(n_all - n_toxic + 1.0))
    picked = counts.withColumn("odds", odds).where((F.col("t") >= min(max(n_toxic // 50, MIN_TOXIC[0]), MIN_TOXIC[1])) & (F.col("odds") >= MIN_ODDS))
    # one job for all kinds: the features of the sample aren't made again for each
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(F.col("odds") * F.col("t")), "h"))
    rows = picked.withColumn("place", place).where(F.col("place") <= MOST).select("kind", "place", "h").collect()
    of = {kind: sorted((r["place"], r["h"]) for r in rows if r["kind"] == kind) for kind in range(1 + len(PREFIXES))}
    return Lexicons([np.array([h for _, h in of[kind]], dtype=np.int64).view(np.uint64) for kind in of])


def dense_features(texts: list[bytes | None], lex: Lexicons, hasher: WordHasher) -> np.ndarray:
    n = len(texts)
    c = Counts(texts, hasher)
    words, chars = np.maximum(c.n_words, 1), np.maximum(c.word_chars, 1)
    cols, any_hit = [], None
    owner, kinds, starts = _tokens(texts, hasher, _STRIP)
    per_text = lambda own, flag: np.bincount(own[flag], minlength=n).astype(float)
    plain = []
    for k, h in enumerate(kinds):
        flag = lex.hits(k, h)
        any_hit = flag if any_hit is None else any_hit | flag
        plain.append(per_text(owner, flag))
        cols += [np.log1p(plain[-1]), plain[-1] / words]
    second = np.unique(hasher.words(b" ".join(w.encode() for w in SECOND_PERSON))[0])
    you = np.isin(kinds[0], second) if len(kinds[0]) else np.zeros(0, dtype=bool)
    near = np.zeros(len(you), dtype=bool)
    total = np.concatenate([[0], np.cumsum(you)])
    at = np.flatnonzero(any_hit)
    low, high = np.maximum(at - NEAR, 0), np.minimum(at + NEAR + 1, len(you))
    first = np.searchsorted(owner, owner[at])
    last = np.searchsorted(owner, owner[at], side="right")
    near[at] = total[np.minimum(high, last)] > total[np.maximum(low, first)]
    cols += [per_text(owner, any_hit) / words, per_text(owner, near) / words, per_text(owner, you) / words]
    looks_owner, looks, _ = _tokens(texts, hasher, _LOOKS)
    for k in (0, 2):
        cols.append(np.maximum(per_text(looks_owner, lex.hits(k, looks[k])) - plain[k], 0) / words)
    data = c.data
    inside = np.zeros(len(data), dtype=bool)
    lower = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    inside[1:-1] = lower[:-2] & lower[2:] & ~lower[1:-1] & (data[1:-1] > 0x20) & (data[1:-1] < 0x80)
    stretched = np.zeros(len(data), dtype=bool)
    stretched[2:] = lower[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    apart = np.zeros(len(data), dtype=bool)
    blank = data <= 0x20
    apart[1:-1] = blank[:-2] & lower[1:-1] & blank[2:]
    for flag in (inside, stretched, apart):
        s = np.concatenate([[0], np.cumsum(flag)])
        cols.append((s[c.offsets[1:] - 1] - s[c.offsets[:-1]]) / chars)
    cols += [c.of[k] / chars for k in ("upper", "exclaim", "stop", "symbol", "digit", "mark")]
    cols.append(np.log1p(c.n_words))
    return np.stack(cols, axis=1)


class Model:
    def __init__(self, lex: Lexicons, trees: gbt.Trees, knots: tuple[np.ndarray, np.ndarray]) -> None:
        self.lex, self.trees, self.knots = lex, trees, knots

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.score(x)
        # calibration makes steps; a thousandth of the raw score keeps the order within them
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * raw, 0, 1)


N_FEATURES = 23
#: Lexicon columns may only raise the score.
MONOTONE = dict.fromkeys(range(13), 1) | {10: 0}


def _collect(sample: DataFrame, lex: Lexicons) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in groups(batches):
            x = dense_features(utf8(batch.column(0)), lex, hasher)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = sample.select("text", "y").mapInArrow(run, "x array<double>, y int").toPandas()
    if not len(rows):
        return np.zeros((0, N_FEATURES)), np.zeros(0)
    return np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(dtype=float)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, limit: int = SAMPLE) -> Model:
    """Learn `labels.toxic` from at most `limit` labelled documents outside the held-out fold."""
    sample = labelled(docs, labels, "toxic", modulus, held, limit)
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5))
    one, two, rest = sample.where(part < 2), sample.where((part >= 2) & (part < 4)), sample.where(part == 4)
    pairs = [_collect(one, learn_lexicons(two)), _collect(two, learn_lexicons(one))]
    trees = gbt.fit(np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs]), monotone=MONOTONE, trees=50)
    lex = learn_lexicons(sample.where(part < 4))
    x, y = _collect(rest, lex)
    return Model(lex, trees, gbt.isotonic(trees.score(x), y))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if the score is at least 0.5), for every row; whole
    texts are scored.  Null and empty texts are scored as texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in groups(batches):
            score = model.score(dense_features(utf8(batch.column(1)), model.lex, hasher))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double, predicted int")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
