"""Coercions of decoded column values to declared types (OP-FN-1, OP-FN-2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a non-nullable field holds when its value is null or absent.
DEFAULTS = {T.BooleanType: False, T.ByteType: 0, T.ShortType: 0, T.IntegerType: 0, T.LongType: 0, T.FloatType: 0.0, T.DoubleType: 0.0, T.DecimalType: 0}


def to_type(col: Column, source: T.DataType, target: T.DataType) -> Column:
    """Null stays null; a value that doesn't fit raises an error, as a poison change must halt.

    Text to bytes is base64, bytes to text too; text to time is read as UTC; a date becomes
    midnight; an instant is cut to its date; arrays are coerced item by item."""
    if source == target:
        return col
    if isinstance(source, T.StringType) and isinstance(target, T.BinaryType):
        return F.unbase64(col)
    if isinstance(source, T.BinaryType) and isinstance(target, T.StringType):
        return F.base64(col)
    if isinstance(source, T.ArrayType) and isinstance(target, T.ArrayType):
        return F.transform(col, lambda x: to_type(x, source.elementType, target.elementType))
    if isinstance(target, T.DateType) and isinstance(source, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(col)
    return col.cast(target)


def enum_by_name(col: Column, names: list[str]) -> Column:
    """A declared enum's name, found by name without regard to case, or by its number."""
    by_name = F.lower(col.cast("string"))
    hit = None
    for i, n in enumerate(names):
        test = (by_name == n.lower()) | (by_name == str(i))
        hit = F.when(test, n) if hit is None else hit.when(test, n)
    return F.when(col.isNotNull(), hit.otherwise(F.raise_error(F.concat(F.lit("not a value of the enum: "), col.cast("string")))))


def or_default(col: Column, kind: T.DataType) -> Column:
    """A declared non-null field keeps its type's default where the value is null or absent."""
    default = DEFAULTS.get(type(kind))
    return col if default is None else F.coalesce(col, F.lit(default).cast(kind))
