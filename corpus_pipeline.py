"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, BPE coding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to
the shared folder and read again as the next stage's docs, so a lost executor costs no more
than the tasks of one stage.  All stages but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.bpe import encode_documents
from rivulet.llm.common import materialise, table
from rivulet.llm.decontaminate import keep_clean
from rivulet.llm.line_dedup import passage_dedup
from rivulet.llm.near_dedup import keep_first
from rivulet.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


#: Of a text that line dedup cut, so many words must be left, and this part of its words in percent.
LEAST_WORDS, LEAST_PERCENT = 50, 20
WORD = r"[^\x20\x09-\x0D]+"


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of two lines or more go from the texts; n_chars follows the text.

    A document whose text was cut is judged again: one of which fewer than LEAST_WORDS words are left
    (what the quality rules ask for) or at most LEAST_PERCENT of its words is a copy of others by its
    lines and goes, so no blank or stub goes on.  Documents that nothing was cut from stay as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carry = F.struct(F.regexp_count("text", F.lit(WORD)).alias("_words"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(others)])
    # a filter isn't pushed below a number that depends on the row's place, so it reads finished texts
    # in place of splitting them anew for every line
    out = passage_dedup(docs, carry=carry).withColumn("_place", F.monotonically_increasing_id())
    cut, left = F.col("n_removed_lines") > 0, F.regexp_count("text", F.lit(WORD))
    out = out.where((F.col("_place") >= 0) & (~cut | ((left >= LEAST_WORDS) & (100 * left > LEAST_PERCENT * F.col("carry._words")))))
    columns = {c: F.col("carry")[f"_{k}"] for k, c in enumerate(others)} | {c: F.col(c) for c in ("doc_id", "text")}
    if "n_chars" in others:
        columns["n_chars"] = F.when(cut, F.length("text")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", encode),
]

#: Learned rules, SuperMinHash and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
