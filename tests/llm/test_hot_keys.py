"""Joins with hot keys: the same plan and as many rows whether there are hot keys or not."""

import re

import pytest
from pyspark.sql import functions as F

from rivulet.llm.common import join_spread, materialise


def nodes(df):
    """Joins of the plan that ran."""
    return sorted(re.findall(r"(\w+Join) ", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_plan_and_rows(spark, how):
    plans = {}
    for name, of in {"hot": lambda i: F.when(i % 3 == 0, 0).otherwise(i % 5000 + 1), "even": lambda i: i % 5000, "nulls": lambda i: F.when(i % 3 == 0, None).otherwise(i % 5000)}.items():
        rows = materialise(spark.range(40_000).select("id", of(F.col("id")).cast("long").alias("h")), "rows")
        keyed = materialise(rows.groupBy("h").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1"), "keyed")
        out = join_spread(rows, keyed, ["h"], "n", ["id"], how=how)
        got = out.collect()
        assert len(got) == (40_000 if how == "left" else rows.where("h is not null").count())
        want = {r["h"]: (r["low"], r["n"]) for r in keyed.collect()}
        assert all((r["low"], r["n"]) == (want[r["h"]] if r["h"] is not None else (None, None)) for r in got)
        assert any(r["hot"] for r in got)
        plans[name] = nodes(out)
    assert plans["hot"] == plans["even"] == plans["nulls"] and "BroadcastHashJoin" in plans["hot"]


def test_no_rows(spark):
    rows = spark.range(0).select("id", F.col("id").alias("h"))
    keyed = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    for how in ("left", "inner"):
        assert join_spread(rows, keyed, ["h"], "n", ["id"], how=how).collect() == []
