"""Nested records into flat tables, in one pass.

A visitor walks the schema depth first and makes one expression that emits, for each row, every nested element as
(tag, key, parent_key, root_key, map_key, pos, payload). One generator then turns the rows into tagged rows: the input is read
once however many tables come out, and there is no shuffle. They are written partitioned by tag, and each table is read back
with its own columns.

Defined results: null and empty arrays and maps emit nothing; null elements emit nothing but count for `pos`; a repeated row or
element is emitted again; map entries keep their key and those with scalar or struct values have pos 0; scalars are in column
`value`. A null root key gives null keys, and the rows stay. Payload fields named like the key columns are kept as `x_<name>`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("root_key", "key", "parent_key", "map_key", "pos")


@dataclass
class Child:
    """One table that comes out: its tag, and the struct of its own scalar fields."""

    tag: str
    payload: T.StructType


def _nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType))


def _own(t: T.DataType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """The scalar fields of an element; structs inside it are spread out as a_b."""
    if not isinstance(t, T.StructType):
        return [] if _nested(t) else [("value", t)]
    out: list[tuple[str, T.DataType]] = []
    for f in t.fields:
        if isinstance(f.dataType, T.StructType):
            out += _own(f.dataType, f"{prefix}{f.name}_")
        elif not _nested(f.dataType):
            out.append((prefix + f.name, f.dataType))
    return out


def _free(names: list[str]) -> list[str]:
    taken, out = {k.lower() for k in KEYS}, []
    for n in names:
        m = n
        while m.lower() in taken:
            m = "x_" + m
        taken.add(m.lower())
        out.append(m)
    return out


def children(t: T.DataType, tag: str) -> list[Child]:
    """The tables under a nested type, parents first."""
    if isinstance(t, T.MapType):
        v = t.valueType
        return children(v, tag) if isinstance(v, T.ArrayType) else [*_element(v, tag)]
    if isinstance(t, T.ArrayType):
        return _element(t.elementType, tag)
    return []


def _element(t: T.DataType, tag: str) -> list[Child]:
    own = _own(t)
    names = _free([n for n, _ in own])
    out = [Child(tag, T.StructType([T.StructField(m, d, True) for m, (_, d) in zip(names, own)]))]
    if _nested(t):
        return out + children(t, f"{tag}.element")
    if isinstance(t, T.StructType):
        out += _inside(t, tag)
    return out


def _inside(t: T.StructType, tag: str) -> list[Child]:
    out: list[Child] = []
    for f in t.fields:
        if _nested(f.dataType):
            out += children(f.dataType, f"{tag}.{f.name}")
        elif isinstance(f.dataType, T.StructType):
            out += _inside(f.dataType, f"{tag}.{f.name}")
    return out


class _Visitor:
    def __init__(self, tables: list[Child]) -> None:
        self.tables = tables
        self.slot = {c.tag: i for i, c in enumerate(tables)}

    def row(self, tag: str, key: Column, parent: Column, mkey: Column, pos: Column, e: Column, t: T.DataType) -> Column:
        cols = []
        for c in self.tables:
            if not c.payload.fields:  # keys are all there is of it
                continue
            if c.tag == tag:
                payload = F.struct(*[p.alias(f.name) for p, f in zip(self._values(e, t), c.payload.fields)])
            else:
                payload = F.lit(None).cast(c.payload)
            cols.append(payload.alias(f"p{self.slot[c.tag]}"))
        return F.struct(F.lit(tag).alias("tag"), key.alias("key"), parent.alias("parent_key"), mkey.alias("map_key"), pos.cast("int").alias("pos"), *cols)

    def _values(self, e: Column, t: T.DataType) -> list[Column]:
        if not isinstance(t, T.StructType):
            return [] if _nested(t) else [e]
        out: list[Column] = []
        for f in t.fields:
            if isinstance(f.dataType, T.StructType):
                out += self._values(e[f.name], f.dataType)
            elif not _nested(f.dataType):
                out.append(e[f.name])
        return out

    def visit(self, c: Column, t: T.DataType, tag: str, parent: Column, mkey: Column) -> list[Column]:
        """Arrays of emitted rows for the nested value c."""
        if not any(x.tag == tag or x.tag.startswith(tag + ".") for x in self.tables):
            return []
        if isinstance(t, T.MapType):
            # entries are visited as an array of pairs, which keeps repeated keys
            def entry(kv: Column) -> Column:
                k = kv["key"].cast("string")
                step = F.concat(parent, F.lit(f"/{tag.rsplit('.', 1)[-1]}["), F.url_encode(k), F.lit("]"))
                if isinstance(t.valueType, T.ArrayType):
                    return self._join(self.visit(kv["value"], t.valueType, tag, step, k))
                return self._one(kv["value"], t.valueType, tag, step, parent, k, F.lit(0))

            return [self._flat(F.transform(F.map_entries(c), entry))]
        if isinstance(t, T.ArrayType):
            name = tag.rsplit(".", 1)[-1]

            def element(e: Column, i: Column) -> Column:
                step = F.concat(parent, F.lit(f"/{name}:"), i.cast("string"))
                return self._one(e, t.elementType, tag, step, parent, mkey, i)

            return [self._flat(F.transform(c, element))]
        return []

    def _one(self, e: Column, t: T.DataType, tag: str, key: Column, parent: Column, mkey: Column, pos: Column) -> Column:
        parts = []
        if tag in self.slot:
            parts.append(F.array(self.row(tag, key, parent, mkey, pos, e, t)))
        if _nested(t):
            parts += self.visit(e, t, f"{tag}.element", key, F.lit(""))
        elif isinstance(t, T.StructType):
            parts += self._fields(e, t, tag, key)
        return F.when(e.isNotNull(), self._join(parts))

    def _fields(self, e: Column, t: T.StructType, tag: str, key: Column) -> list[Column]:
        out: list[Column] = []
        for f in t.fields:
            if _nested(f.dataType):
                out += self.visit(e[f.name], f.dataType, f"{tag}.{f.name}", key, F.lit(""))
            elif isinstance(f.dataType, T.StructType):
                out += self._fields(e[f.name], f.dataType, f"{tag}.{f.name}", key)
        return out

    @staticmethod
    def _flat(c: Column) -> Column:
        """flatten() gives null for any null part; those are left out first."""
        return F.flatten(F.filter(c, lambda x: x.isNotNull()))

    @staticmethod
    def _join(parts: list[Column]) -> Column:
        if len(parts) == 1:
            return parts[0]
        return F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))


class Flattened:
    """The tagged rows of a nested DataFrame, and its tables."""

    def __init__(self, rows: DataFrame, tables: list[Child]) -> None:
        self.rows = rows
        self.tables = tables

    @property
    def tags(self) -> list[str]:
        return [c.tag for c in self.tables]

    def table(self, tag: str) -> DataFrame:
        """One table with its schema applied."""
        i = self.tags.index(tag)
        c = self.tables[i]
        cols = [F.col(f"p{i}")[f.name].alias(f.name) for f in c.payload.fields]
        return self.rows.where(F.col("tag") == tag).select(*KEYS, *cols)

    def written(self, work, name: str = "flat") -> "Flattened":
        """Written partitioned by tag and read back: tables then read their own partition only."""
        return Flattened(work.save(self.rows, name, partition_by="tag"), self.tables)


def flatten_nested(df: DataFrame, root_key: str, fields: list[str] | None = None, keep: list[str] | None = None, keys_only: bool = False) -> Flattened:
    """The tables under the array and map columns of df (all, or `fields`). `keep` limits the tables that are emitted; with
    `keys_only` they have key columns only, so no payload is written."""
    if not [f for f in df.schema.fields if f.name == root_key]:
        raise ValueError(f"no column {root_key}")
    names = [f.name for f in df.schema.fields if _nested(f.dataType) and f.name != root_key and (fields is None or f.name in fields)]
    tables = [c for n in names for c in children(df.schema[n].dataType, n)]
    if keep is not None:
        tables = [c for c in tables if c.tag in keep]
    if keys_only:
        tables = [Child(c.tag, T.StructType([])) for c in tables]
    if not tables:
        raise ValueError("no nested column to flatten")
    v = _Visitor(tables)
    root = F.col("_root").cast("string")
    src = df.select(F.col(root_key).alias("_root"), *[F.col(f"`{n}`") for n in names])
    parts = [p for n in names for p in v.visit(F.col(f"`{n}`"), df.schema[n].dataType, n, root, F.lit(""))]
    rows = src.select(F.col("_root").alias("root_key"), F.inline(v._join(parts)))
    return Flattened(rows, tables)
