"""Declarations: tables, mappings, dependants and options, checked when they are made."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

KEY_TYPES = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType, T.DoubleType, T.FloatType)
PY_TYPES = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), bytes: T.BinaryType(), datetime: T.TimestampNTZType(), date: T.DateType(), Decimal: T.DecimalType(38, 10)}


def snake_case(name: str) -> str:
    """HTTPStatus is http_status, Line2Number line2number; other signs part words."""
    words = re.split(r"[^0-9A-Za-z_]+", name)
    return "_".join(re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", w).lower() for w in words if w)


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted paths of all leaves of nested structs."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += leaf_paths(f.dataType, path + ".") if isinstance(f.dataType, T.StructType) else [(path, f.dataType)]
    return out


@dataclass(frozen=True)
class TableSpec:
    schema: str
    table: str
    columns: T.StructType
    primary_key: tuple[str, ...]
    full_identity: bool = False
    partitioned: bool = False
    identity_index: tuple[str, ...] = ()
    non_null: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        names = {f.name: f.dataType for f in self.columns.fields}
        if not self.primary_key:
            raise ValueError(f"{self.qualified}: no primary key")
        for k in self.primary_key:
            if k not in names:
                raise ValueError(f"{self.qualified}: key column {k} is unknown")
            if not isinstance(names[k], KEY_TYPES):
                raise ValueError(f"{self.qualified}: {k} can't be a key, its type is {names[k].simpleString()}")

    @property
    def qualified(self) -> str:
        return f"{self.schema}.{self.table}"

    @classmethod
    def from_dataclass(cls, kind: type, schema: str = "public", table: str | None = None, key: tuple[str, ...] = ()) -> TableSpec:
        """Columns in snake case; the key is the one given, else the fields marked
        metadata={"key": order}, else `Id` or `<Type>Id`."""
        if not is_dataclass(kind):
            raise TypeError(f"{kind} isn't a dataclass")
        names = {f.name: f.metadata.get("column") or snake_case(f.name) for f in fields(kind)}
        marked = sorted((f.metadata["key"], i, f.name) for i, f in enumerate(fields(kind)) if "key" in f.metadata)
        found = key or tuple(n for _, _, n in marked) or tuple(n for n in names if n.lower() in ("id", kind.__name__.lower() + "id"))[:1]
        kinds = {f.name: PY_TYPES[f.type if isinstance(f.type, type) else eval(f.type, {**{k.__name__: k for k in PY_TYPES}})] for f in fields(kind)}
        return cls(schema, table or snake_case(kind.__name__), T.StructType([T.StructField(names[n], t) for n, t in kinds.items()]), tuple(names[n] for n in found))

    @classmethod
    def for_json_documents(cls, schema: str, table: str, tenant: bool = False) -> TableSpec:
        key = ("tenant_id", "id") if tenant else ("id",)
        names = [*key, "data", "deleted"]
        return cls(schema, table, T.StructType([T.StructField(n, T.BooleanType() if n == "deleted" else T.StringType()) for n in names]), key)


@dataclass(frozen=True)
class Binding:
    """A change in `dependent` re-emits the rows of `primary` with equal lookup columns."""

    dependent: str
    primary: str
    pairs: tuple[tuple[str, str], ...]

    def __post_init__(self) -> None:
        if not self.pairs:
            raise ValueError("a binding needs lookup columns")


@dataclass
class Mapping:
    """One table to one sink.  transform takes the collapsed changes (DataFrame with key,
    doc_key, record, action, ...) and returns (doc_key, document); a key it leaves out, or whose
    document is null, is deleted."""

    table: str
    sink: str
    transform: Callable[[DataFrame], DataFrame]
    destination: str | None = None
    keyed_by: Callable[[str], Column] | None = None
    scoped_by: Callable[[str], Column] | None = None
    scoped_destination: Callable[[Column], Column] | None = None
    version: str | None = None
    consumes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.consumes and self.excludes:
            raise ValueError("a mapping either lists its columns or leaves some out")
        if self.scoped_destination and not self.scoped_by:
            raise ValueError("a scoped destination needs a scope")


@dataclass
class Model:
    tables: dict[str, TableSpec] = field(default_factory=dict)
    mappings: list[Mapping] = field(default_factory=list)
    bindings: list[Binding] = field(default_factory=list)

    def add(self, spec: TableSpec) -> TableSpec:
        if spec.qualified in self.tables:
            raise ValueError(f"{spec.qualified} is claimed twice")
        self.tables[spec.qualified] = spec
        return spec

    def map(self, mapping: Mapping) -> Mapping:
        if mapping.table not in self.tables:
            raise ValueError(f"{mapping.table} is unknown")
        if any(m.table == mapping.table and m.sink == mapping.sink for m in self.mappings):
            raise ValueError(f"{mapping.table} is mapped to {mapping.sink} twice")
        self.mappings.append(mapping)
        return mapping

    def bind(self, binding: Binding) -> Binding:
        if binding not in self.bindings:
            self.bindings.append(binding)
        return binding

    def captured_columns(self, table: str) -> list[str]:
        """The union of what the mappings consume, with key and lookup columns; everything if a
        mapping doesn't choose; key and lookup columns alone if none maps the table."""
        spec = self.tables[table]
        names = [f.name for f in spec.columns.fields]
        must = set(spec.primary_key)
        for b in self.bindings:
            must |= {d for d, _ in b.pairs} if b.dependent == table else set()
            must |= {p for _, p in b.pairs} if b.primary == table else set()
        chosen: set[str] = set(must)
        for m in (m for m in self.mappings if m.table == table):
            if unknown := [c for c in (*m.consumes, *m.excludes) if c not in names]:
                raise ValueError(f"{table}: unknown columns {unknown}")
            if taken := must & set(m.excludes):
                raise ValueError(f"{table}: {sorted(taken)} are keys or lookups and stay")
            chosen |= set(m.consumes) if m.consumes else set(names) - set(m.excludes)
        return [n for n in names if n in chosen]

    def published_columns(self, table: str) -> tuple[list[str] | None, str | None]:
        """The captured columns, or None (all) with a reason where a list would break identity."""
        spec, columns = self.tables[table], self.captured_columns(table)
        if spec.partitioned:
            return None, "partitioned: identity is set per partition"
        if spec.full_identity:
            return None, "full identity covers every column"
        if rest := [c for c in spec.identity_index if c not in columns]:
            return None, f"identity index columns outside the list: {rest}"
        return columns, None

    def needs_old_image(self, table: str) -> bool:
        return any(m.keyed_by or m.scoped_destination for m in self.mappings if m.table == table)

    def export_tables(self, include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
        """A named set of tables for another consumer: those listed or all, less the exceptions."""
        chosen = list(self.tables) if include is None else include
        if unknown := [t for t in chosen if t not in self.tables]:
            raise ValueError(f"unknown tables {unknown}")
        if unmatched := [t for t in exclude or [] if t not in chosen]:
            raise ValueError(f"exceptions that match nothing: {unmatched}; chosen are {chosen}")
        return [t for t in chosen if t not in (exclude or [])]


@dataclass(frozen=True)
class Options:
    """Limits; the defaults are those of the survey."""

    max_batch_size: int = 1_000
    backfill_chunk: int = 500
    max_transactions: int = 100
    fanout_chunk: int = 10_000
    max_fanout_keys: int = 1_000_000
    retry_attempts: int = 10
    retry_base_seconds: float = 0.2
    retry_max_seconds: float = 180.0

    def __post_init__(self) -> None:
        for name, low, high in (("max_batch_size", 1, 100_000), ("backfill_chunk", 1, 100_000), ("max_transactions", 1, 10_000), ("fanout_chunk", 1, None), ("max_fanout_keys", 1, None), ("retry_attempts", 0, None)):
            v = getattr(self, name)
            if v < low or (high and v > high):
                raise ValueError(f"{name} = {v} is out of range")
