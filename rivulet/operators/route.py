"""Mappings: collapse, transform, identify, address (OP-KEY-3..6, OP-RTE-*)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Mapping
from .collapse import last_wins

META = ["schema", "table", "action", "commit_ts", "commit_lsn", "commit_idx"]


def required(col: Column, what: str) -> Column:
    """The value, or an error where it is null or empty."""
    text = col.cast("string")
    return F.when(text.isNull() | (text == ""), F.raise_error(F.lit(f"{what} is null or empty; a delete needs the full old image"))).otherwise(text)


def scope_of(mapping: Mapping) -> Column:
    return mapping.scoped_by("record").cast("string") if mapping.scoped_by else F.lit(None).cast("string")


def destination_of(mapping: Mapping, sink_default: str | None) -> Column:
    fixed = F.lit(mapping.destination or sink_default)
    if mapping.scoped_destination:
        return required(mapping.scoped_destination(F.col("scope")), f"{mapping.table}: scoped destination")
    if mapping.destination is None and sink_default is None:
        raise ValueError(f"{mapping.table} to {mapping.sink}: no destination")
    return fixed


def route_one(collapsed: DataFrame, mapping: Mapping, sink_default: str | None = None) -> DataFrame:
    """Records of one mapping: deletes bypass the transform; a change that the transform leaves
    out, or gives no document, is a delete; records of one document collapse to the last."""
    changes = collapsed.where(F.concat_ws(".", "schema", "table") == mapping.table).withColumn("scope", scope_of(mapping))
    live = changes.where("action != 'delete'")
    documents = mapping.transform(live).select(F.col("doc_key").alias("_key"), F.col("document").cast("string").alias("document"))
    joined = changes.join(documents, (F.col("doc_key") == F.col("_key")) & (F.col("action") != "delete"), "left").drop("_key")
    ident = required(mapping.keyed_by("record"), f"{mapping.table}: document id") if mapping.keyed_by else F.col("doc_key")
    backfill = F.col("backfill_run_id") if "backfill_run_id" in changes.columns else F.lit(None).cast("string")
    records = joined.select(
        F.lit(mapping.sink).alias("sink"), destination_of(mapping, sink_default).alias("destination"), ident.alias("document_id"),
        F.col("document").isNull().alias("is_deletion"), "document", *META, (F.col("action") == "read").alias("is_backfill"), backfill.alias("backfill_run_id"),
    )
    return last_wins(records, ["destination", "document_id"])


def route(events: DataFrame, mappings: list[Mapping], sink_defaults: dict[str, str] | None = None, once: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All mappings over the same collapsed changes: the engine's sink records.  Each mapping joins
    them with their own transform; `once` may write them first, so that they are made once."""
    collapsed = last_wins(events, ["schema", "table", "doc_key"])
    collapsed = once(collapsed) if once else collapsed
    parts = [route_one(collapsed, m, (sink_defaults or {}).get(m.sink)) for m in mappings]
    return reduce(DataFrame.unionByName, parts)


def scoped(transform, schema: str):
    """A Python transform per scope: fn(pdf with doc_key, scope, record...) -> pdf(doc_key,
    document); null is a scope of its own.  A scope is one group, so use it for scopes of a
    batch's size (leased() streams larger ones); column transforms need no grouping."""

    def apply(changes: DataFrame) -> DataFrame:
        return changes.select("scope", "doc_key", "record.*").groupBy("scope").applyInPandas(transform, schema)

    return apply


def leased(transform: Callable, schema: str, acquire: Callable[[object], object], release: Callable[[object], None] = lambda r: None, spread: int = 1):
    """A Python transform with a resource that is held for a scope: acquire(scope) is called once before a
    scope's first rows, fn(resource, pdf with doc_key, scope, record...) -> pdf(doc_key, document) for each
    batch of them, and release(resource) behind its last or after an error.

    Rows are sorted by scope and streamed, so a scope may be larger than a task's memory.  `spread` deals
    each scope's rows to so many tasks at most, each with a resource of its own, for scopes that hold very many rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = None, None
        try:
            for pdf in frames:
                # neighbours of one scope; null is one too
                scopes = pdf["scope"].astype(object).where(pdf["scope"].notna(), None)
                cut = [0, *(k for k in range(1, len(pdf)) if scopes.iloc[k] != scopes.iloc[k - 1]), len(pdf)]
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    if a == b:
                        continue
                    if held is None or now != scopes.iloc[a]:
                        if held is not None:
                            last, held = held, None
                            release(last[0])
                        now = scopes.iloc[a]
                        held = (acquire(now),)
                    yield transform(held[0], pdf.iloc[a:b])
        finally:
            if held is not None:
                release(held[0])

    def apply(changes: DataFrame) -> DataFrame:
        rows = changes.select("scope", "doc_key", "record.*")
        dealt = rows.repartition("scope", F.pmod(F.xxhash64("doc_key"), F.lit(spread))).sortWithinPartitions("scope")
        return dealt.mapInPandas(run, schema)

    return apply
