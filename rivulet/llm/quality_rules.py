"""Quality rules: gradient-boosted trees over document statistics, beside fixed base rules.

The trees learn `labels.quality` from a bounded sample; shares of symbols, repeated lines
and repeated words may only lower the score.  They are flat arrays that score all rows of a
batch a level at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import groups, table, utf8
from .docstats import Counts
from .shingles import WordHasher
from .training import SAMPLE, labelled

FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "exclaims", "stops", "high", "marks", "lines", "symbol_words", "upper_words"]
MONOTONE = {FEATURES.index(x): -1 for x in ("symbols", "dup_lines", "repeat_words")}


def statistics(c: Counts, dup_lines: np.ndarray, repeat_words: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    words, chars = np.maximum(c.n_words, 1), np.maximum(c.word_chars, 1)
    lines = c.of["line"] + 1
    per_char = lambda k: c.of[k] / chars
    share = lambda k: c.mean_of_words(c.word_flag(k)) / words
    cols = [np.log1p(c.n_words), c.word_chars / words, c.of["symbol"] / words, dup_lines / lines, repeat_words / words, per_char("upper"), per_char("digit"), per_char("exclaim"), per_char("stop"), per_char("high"), per_char("mark"), lines / words, share("symbol"), share("upper")]
    return np.stack(cols, axis=1).astype(np.float64)


def _stats(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in groups(batches, "text"):
            c = Counts(utf8(batch.column(1)), hasher)
            x = statistics(c, c.dup_lines(), c.repeat_words())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], names=["x", "y"])

    rows = sample.mapInArrow(run, "x array<double>, y int").toPandas()
    if not len(rows):
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(dtype=float)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> gbt.Trees:
    """Trees for the quality label, from at most `limit` labelled documents.  Without any, the
    score is one half everywhere."""
    x, y = _stats(labelled(docs, labels, "quality", 0, 0, limit))
    return gbt.fit(x, y, monotone=MONOTONE)


def quality_rules(docs: DataFrame, model: gbt.Trees, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    Words are what white space separates; see the columns' definitions in docstats.  The base
    rules fail texts of fewer than 50 words or with over half of the words in repeated 3-word
    windows; kept also needs a score of at least `least`.  Null and empty texts have no words
    and so fail.  Every row of `docs` gives one row; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in groups(batches):
            c = Counts(utf8(batch.column(1)), hasher)
            dup, rep = c.dup_lines(), c.repeat_words()
            score = model.score(statistics(c, dup, rep))
            failed = (c.n_words < 50) | (100 * rep > 50 * c.n_words)
            cols = [c.n_words, c.word_chars, c.of["symbol"], dup, rep]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in cols), pa.array(failed), pa.array(~failed & (score >= least)), pa.array(score)], names=NAMES)

    NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit(docs, table(spark, sf_dir, "labels")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, row by row, with all their columns."""
    model = fit(docs, labels)
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in groups(batches):
            c = Counts(utf8(batch.column(at)), hasher)
            dup, rep = c.dup_lines(), c.repeat_words()
            keep = (c.n_words >= 50) & (100 * rep <= 50 * c.n_words) & (model.score(statistics(c, dup, rep)) >= 0.5)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
