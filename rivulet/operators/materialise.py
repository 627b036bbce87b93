"""From log rows to typed change events (OP-PRJ-4..13, OP-FN-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import or_default, to_type
from ..functions.ids import canonical_id, rendered
from ..model import TableSpec, leaf_paths


def with_record(log: DataFrame, spec: TableSpec) -> DataFrame:
    """Adds record (the new image, a delete's old one), coerced to the declared types; columns
    that were not on the wire fall back to a value in the old image; key and doc_key."""
    image = log.schema["new"].dataType
    names = set(image.fieldNames())
    absent = F.coalesce(F.col("unavailable_cols"), F.array()) if "unavailable_cols" in log.columns else F.array().cast("array<string>")
    fields = []
    for f in spec.columns.fields:
        if f.name not in names:
            value = F.lit(None).cast(f.dataType)
        else:
            source = image[f.name].dataType
            old, new = F.col("old").getField(f.name), F.col("new").getField(f.name)
            value = F.when(F.col("action") == "delete", old).when(F.array_contains(absent, f.name), old).otherwise(new)
            value = to_type(value, source, f.dataType)
        fields.append((or_default(value, f.dataType) if f.name in spec.non_null else value).alias(f.name))
    out = log.withColumn("record", F.struct(*fields))
    if "unavailable_cols" in log.columns:
        still = F.filter("unavailable_cols", lambda c: ~F.exists(F.array(*[F.when(F.col("old").getField(n).isNotNull(), F.lit(n)) for n in names]), lambda x: x.eqNullSafe(c)))
        out = out.withColumn("unavailable_cols", F.when(F.col("action").isin("insert", "update"), still).otherwise(F.array().cast("array<string>")))
    key = [F.col("record").getField(k) for k in spec.primary_key]
    whole = F.when(F.greatest(*[k.isNull() for k in key], F.lit(False)), F.raise_error(F.concat(F.lit(f"{spec.qualified}: null in the key at "), F.col("commit_lsn").cast("string")))).otherwise(True)
    kinds = {f.name: f.dataType for f in spec.columns.fields}
    return out.where(whole).withColumn("doc_key", canonical_id(*[rendered(k, kinds[n]) for k, n in zip(key, spec.primary_key, strict=True)]))


def healed(events: DataFrame, spec: TableSpec, current: DataFrame) -> DataFrame:
    """Inserts and updates whose columns never came take them from the present row; a change whose
    row is gone is left out (its delete is on the way).  Only such changes meet the table."""
    kinds = {f.name: f.dataType for f in spec.columns.fields}
    broken = (F.size("unavailable_cols") > 0) & F.col("action").isin("insert", "update")
    ident = canonical_id(*[rendered(F.col(k), kinds[k]) for k in spec.primary_key])
    some = events.where(broken)
    now = current.select(ident.alias("doc_key"), F.struct(*[F.col(n).cast(t).alias(n) for n, t in kinds.items()]).alias("_now"))
    value = lambda n: F.when(F.array_contains("unavailable_cols", n), F.col("_now").getField(n)).otherwise(F.col("record").getField(n)).alias(n)
    whole = some.join(now, "doc_key").withColumn("record", F.struct(*[value(n) for n in kinds])).select(events.columns)
    return events.where(~F.coalesce(broken, F.lit(False))).unionByName(whole)


def previous_values(log: DataFrame, columns: list[str]) -> Column:
    """For an update with an old image: the old values (as text) of the columns that changed."""
    entries = [F.struct(F.lit(c).alias("key"), F.col("old").getField(c).cast("string").alias("value"), (~F.col("old").getField(c).eqNullSafe(F.col("new").getField(c))).alias("changed")) for c in columns]
    changed = F.filter(F.array(*entries), lambda e: e["changed"])
    pairs = F.transform(changed, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return F.when((F.col("action") == "update") & F.col("old").isNotNull(), F.map_from_entries(pairs))


def soft_deletes(events: DataFrame, deleted: Column) -> DataFrame:
    """Rows marked deleted: a live change becomes a delete, a snapshot row is skipped."""
    mark = F.coalesce(deleted, F.lit(False))
    return events.where(~(mark & (F.col("action") == "read"))).withColumn("action", F.when(mark, "delete").otherwise(F.col("action")))


def rehydrated(rows: DataFrame, data: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document column as a struct; malformed text raises an error."""
    return rows.withColumn("document", F.from_json(data, schema, {"mode": "FAILFAST"}))


def flattened(df: DataFrame, column: str) -> DataFrame:
    """A nested struct as one column per leaf, named by its dotted path."""
    kind = df.schema[column].dataType
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*rest, *[F.col(f"{column}.{p}").alias(f"{column}.{p}") for p, _ in leaf_paths(kind)])


def optional_struct(leaves: dict[str, Column]) -> Column:
    """Null exactly if all of its leaves are."""
    some = F.coalesce(*[c.cast("string") for c in leaves.values()])
    return F.when(some.isNotNull(), F.struct(*[c.alias(n) for n, c in leaves.items()]))
