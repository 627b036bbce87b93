"""Language ID: a byte convolutional network in numpy.

A text is cut into windows of WINDOW bytes.  Filters of several widths run over the bytes,
each window keeps every filter's maximum, and a softmax layer tells the language; a text's
prediction is the mean over all of its windows.  Inputs are single bytes, so a filter is a
table per position and byte; for scoring, the tables of two neighbouring positions are added
up beforehand, so a filter bank of width 4 costs two look-ups."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, materialise, table, utf8
from .training import fold, held_out, least_hashes

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 12
#: Training takes at most so many documents of each language, and windows of each document.
PER_LANGUAGE, PER_DOCUMENT = 1_000, 5
#: Windows that are scored at a time.
BATCH = 2_048
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LETTER = regex.compile(r"\p{L}")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and bool(_LETTER.search(text.decode())))


def windows(text: bytes, most: int | None = None) -> np.ndarray:
    """Lower-cased (A-Z) windows of WINDOW bytes, the last filled up with zeros; with `most`,
    so many at most, spread evenly over the text."""
    n = max(1, -(-len(text) // WINDOW))
    data = np.frombuffer(text.lower().ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)
    return data if most is None or n <= most else data[np.linspace(0, n - 1, most).astype(int)]


class Network:
    def __init__(self, langs: list[str]) -> None:
        rng = np.random.default_rng(3)
        self.langs = langs
        self.tables = [rng.normal(0, 0.15, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), dtype=np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), dtype=np.float32)

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        tops, places = [], []
        for t in self.tables:
            w = len(t)
            n = WINDOW - w + 1
            conv = t[0][x[:, :n]]
            for j in range(1, w):
                conv += t[j][x[:, j : j + n]]
            places.append(conv.argmax(axis=1))
            tops.append(np.take_along_axis(conv, places[-1][:, None, :], axis=1)[:, 0])
        return np.concatenate(tops, axis=1), places

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01) -> None:
        """Adam on the cross-entropy; gradients pass a maximum only at its place."""
        rng = np.random.default_rng(9)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        m = [np.zeros_like(p) for p in params]
        q = [np.zeros_like(p) for p in params]
        t = 0
        for _ in range(epochs if len(x) else 0):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                xb = x[rows]
                top, places = self._pooled(xb)
                act = np.maximum(top + self.bias, 0)
                z = act @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                back = (p @ self.out.T) * (act > 0)
                grads = []
                for k, tab in enumerate(self.tables):
                    g = np.zeros_like(tab)
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(len(tab)):
                        byte = np.take_along_axis(xb, places[k] + j, axis=1)
                        np.add.at(g[j], (byte, np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                grads += [back.sum(axis=0), act.T @ p, p.sum(axis=0)]
                t += 1
                for k, g in enumerate(grads):
                    m[k] += 0.1 * (g - m[k])
                    q[k] += 0.001 * (g * g - q[k])
                    params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(q[k] / (1 - 0.999**t)) + 1e-8)

    def fold_pairs(self) -> list[list[np.ndarray]]:
        """Tables for pairs of neighbouring bytes (first * 256 + second); an odd rest is single."""
        out = []
        for t in self.tables:
            parts = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, len(t) - 1, 2)]
            out.append(parts + ([t[-1]] if len(t) % 2 else []))
        return out

    def probabilities(self, x: np.ndarray, pairs: list[list[np.ndarray]]) -> np.ndarray:
        two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        tops = []
        for w, parts in zip(WIDTHS, pairs, strict=True):
            n = WINDOW - w + 1
            conv = np.take(parts[0], two[:, :n], axis=0)
            if w == 3:
                conv += np.take(parts[1], x[:, 2 : 2 + n], axis=0)
            if w == 4:
                conv += np.take(parts[1], two[:, 2 : 2 + n], axis=0)
            tops.append(conv.max(axis=1))
        z = np.maximum(np.concatenate(tops, axis=1) + self.bias, 0) @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, modulus: int = 4, held: int = 2) -> Network:
    """Learn from text and lang of documents outside the held-out fold: of each language the
    PER_LANGUAGE with the least hash of the id, evenly spread windows of each.  Rows that share
    id and language are one document, with the least of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "text"):
            for text, lang in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    rows = [w.tobytes() for w in windows(text, PER_DOCUMENT)]
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array([lang] * len(rows))], names=["x", "lang"])

    ids = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(modulus) != held)).select("doc_id", "lang")
    # written first, so that Spark sees how small it is and doesn't deal the texts for the join
    ids = materialise(least_hashes(ids, PER_LANGUAGE, "lang").select("doc_id", "lang").distinct(), "sample_ids")
    found = docs.where((fold(modulus) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()).join(ids, ["doc_id", "lang"], "left_semi")
    found = found.groupBy("doc_id", "lang").agg(F.min(F.col("text").cast("string")).alias("text"))
    rows = found.select("text", F.col("lang").cast("string")).mapInArrow(run, "x binary, lang string").toPandas()
    langs = sorted(set(rows["lang"]))
    net = Network(langs)
    if len(rows):
        order = np.lexsort([rows["x"].to_numpy(dtype=object).astype("S"), rows["lang"].to_numpy(dtype=object).astype("U")])
        x = np.frombuffer(b"".join(rows["x"].iloc[order]), dtype=np.uint8).reshape(-1, WINDOW)
        net.train(x, np.searchsorted(np.array(langs), rows["lang"].iloc[order].to_numpy(dtype=object).astype("U")))
    return net


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row, from all windows of the whole text.

    Texts that are null or have no letter get `und` and score 0, as do all if the network was
    trained on nothing.  score is the mean probability of the predicted language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.fold_pairs()
        for batch in groups(batches):
            texts = utf8(batch.column(1))
            known = [i for i, t in enumerate(texts) if t and net.langs and has_letter(t)]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            if known:
                parts = [windows(texts[i]) for i in known]
                x = np.concatenate(parts)
                p = np.concatenate([net.probabilities(x[at : at + BATCH], pairs) for at in range(0, len(x), BATCH)]).astype(np.float64)
                sizes = np.array([len(w) for w in parts])
                mean = np.add.reduceat(p, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
                for i, k, s in zip(known, mean.argmax(axis=1), mean.max(axis=1), strict=True):
                    langs[i], scores[i] = net.langs[k], min(float(s), 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
