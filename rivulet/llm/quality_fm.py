"""Quality classifier: a factorisation machine.

Inputs are hashed words (log counts, unit length), structure statistics and the text's
length.  Every pair of inputs interacts through vectors of rank RANK; the sum over pairs is
taken in linear time as half of (square of the sum - sum of the squares)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, table, utf8
from .docstats import Counts
from .quality_rules import statistics
from .shingles import WordHasher
from .training import SAMPLE, held_out, labelled

BUCKETS, RANK = 2048, 6
#: Rows whose word counts are held as a matrix at a time.
ROWS = 512


def sparse_inputs(c: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Word counts per (text, bucket), sorted: text * BUCKETS + bucket, and the count."""
    key = c.owner() * BUCKETS + (c.words >> np.uint64(53)).astype(np.int64)
    return np.unique(key, return_counts=True)


def structure(c: Counts) -> np.ndarray:
    x = statistics(c, c.dup_lines(), c.repeat_words())
    return np.concatenate([x, np.log1p(c.of["point"])[:, None]], axis=1)


def words_matrix(n: int, key: np.ndarray, count: np.ndarray) -> np.ndarray:
    x = np.zeros(n * BUCKETS, dtype=np.float32)
    x[key] = np.log1p(count)
    x = x.reshape(n, BUCKETS)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


class Machine:
    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        self.mean, self.scale = mean, scale
        n = BUCKETS + len(mean)
        rng = np.random.default_rng(11)
        self.bias, self.w, self.v = 0.0, np.zeros(n, dtype=np.float32), rng.normal(0, 0.02, (n, RANK)).astype(np.float32)

    def inputs(self, words: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = np.clip((dense - self.mean) / self.scale, -4, 4) / 2
        return np.concatenate([words, z.astype(np.float32)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.bias + x @ self.w + 0.5 * ((s * s).sum(axis=1) - ((x * x) @ (self.v * self.v)).sum(axis=1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x).astype(np.float64), -40, 40)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 128, rate: float = 0.02, decay: float = 1e-4) -> None:
        """Adam on the logistic loss; the order of rows follows from a fixed seed."""
        rng = np.random.default_rng(5)
        m = [np.zeros_like(self.w), np.zeros_like(self.v), 0.0]
        q = [np.zeros_like(self.w), np.zeros_like(self.v), 0.0]
        t = 0
        for _ in range(epochs if len(x) else 0):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                xb = x[rows]
                g = ((self.score(xb) - y[rows]) / len(rows)).astype(np.float32)
                s = xb @ self.v
                grads = [xb.T @ g + decay * self.w, xb.T @ (g[:, None] * s) - self.v * ((xb * xb).T @ g)[:, None] + decay * self.v, float(g.sum())]
                t += 1
                steps = []
                for k, gr in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * gr
                    q[k] = 0.999 * q[k] + 0.001 * gr * gr
                    steps.append(rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(q[k] / (1 - 0.999**t)) + 1e-8))
                self.w, self.v, self.bias = self.w - steps[0], self.v - steps[1], self.bias - float(steps[2])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, limit: int = SAMPLE) -> Machine:
    """Learn `labels.quality` from at most `limit` labelled documents outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in groups(batches, "text"):
            c = Counts(utf8(batch.column(1)), hasher)
            key, count = sparse_inputs(c)
            at = np.searchsorted(key, np.arange(len(c.texts) + 1) * BUCKETS)
            lists = lambda v: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists(key % BUCKETS), lists(count), pa.array(list(structure(c)), pa.list_(pa.float64())), batch.column(2)], names=["k", "n", "z", "y"])

    rows = labelled(docs, labels, "quality", modulus, held, limit).mapInArrow(run, "k array<int>, n array<int>, z array<double>, y int").toPandas()
    if not len(rows):
        return Machine(np.zeros(1), np.ones(1))
    z = np.stack(rows["z"].to_numpy())
    machine = Machine(z.mean(axis=0), np.maximum(z.std(axis=0), 1e-3))
    key = np.concatenate([np.asarray(k, dtype=np.int64) + i * BUCKETS for i, k in enumerate(rows["k"])])
    words = words_matrix(len(rows), key, np.concatenate([np.asarray(v) for v in rows["n"]]))
    machine.train(machine.inputs(words, z), rows["y"].to_numpy(dtype=np.float32))
    return machine


def quality_scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if the score is at least 0.5), for every row; whole
    texts are scored.  Null and empty texts are scored as texts without words; a machine that
    had no labelled rows scores one half or near it everywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for group in groups(batches):
            for at in range(0, group.num_rows, ROWS):
                batch = group.slice(at, ROWS)
                c = Counts(utf8(batch.column(1)), hasher)
                dense = structure(c)[:, : len(machine.mean)]
                score = machine.score(machine.inputs(words_matrix(len(c.texts), *sparse_inputs(c)), dense))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double, predicted int")


def op5_quality_fm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = fit(docs, table(spark, sf_dir, "labels"))
    return quality_scores(docs, machine).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
