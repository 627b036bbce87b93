"""Differences of sets of rows (OP-SET-2, OP-SET-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def membership(want: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    """(key, step): what to add and what to drop so that `have` becomes `want`; nulls are values."""
    w, h = (df.select(*key).distinct() for df in (want, have))
    return w.exceptAll(h).withColumn("step", F.lit("add")).unionByName(h.exceptAll(w).withColumn("step", F.lit("drop")))
