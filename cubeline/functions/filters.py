"""Declarative filters over result rows, compiled to one Column.

A filter is ``{field: [entry, ...]}``; an entry is ``{"operator": ..., "value": ...}`` or
``{"AND": [...]}`` / ``{"OR": [...]}``, nested at will.  Several entries and several fields
are all required; an empty AND holds, an empty OR doesn't.  A null or missing field fails
every condition.  Values of another type than the field are unequal: EQ fails, NEQ holds,
orderings and text operators fail.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

OPERATORS = ("EQ", "NEQ", "GT", "GTE", "LT", "LTE", "CONTAINS", "NOT_CONTAINS")


def _class(v: object) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int | float):
        return "number"
    if isinstance(v, str):
        return "string"
    return "time" if isinstance(v, dt.date) else "other"


def _kind(t: DataType) -> str:
    for kind, of in (("boolean", BooleanType), ("number", NumericType), ("string", StringType), ("time", TimestampType | TimestampNTZType | DateType)):
        if isinstance(t, of):
            return kind
    return "other"


def _condition(c: Column, kind: str, op: str, value: object) -> Column:
    if op not in OPERATORS:
        raise ValueError(f"unknown filter operator {op!r}")
    same = kind == _class(value)
    v = F.lit(value) if same else None
    if op == "EQ":
        out = c == v if same else F.lit(False)
    elif op == "NEQ":
        out = c != v if same else c.isNotNull()
    elif op in ("CONTAINS", "NOT_CONTAINS"):
        out = F.lit(False) if not (same and kind == "string") else c.contains(v) if op == "CONTAINS" else ~c.contains(v)
    elif not same or kind not in ("number", "string", "time"):
        out = F.lit(False)
    else:
        out = {"GT": c > v, "GTE": c >= v, "LT": c < v, "LTE": c <= v}[op]
    return F.coalesce(out, F.lit(False))


def _entry(c: Column, kind: str, e: dict) -> Column:
    groups = [k for k in ("AND", "OR") if k in e]
    parts = [_group(k, [_entry(c, kind, x) for x in e[k]]) for k in groups]
    if "operator" in e or not groups:
        parts.append(_condition(c, kind, e.get("operator"), e.get("value")))
    return _group("AND", parts)


def _group(name: str, parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if name == "AND" else reduce(lambda a, b: a | b, parts, F.lit(False))


def compile_filter(df: DataFrame, spec: dict[str, list[dict]] | None) -> Column:
    """The whole filter as a condition on df; a field that df lacks fails."""
    kinds = {f.name: _kind(f.dataType) for f in df.schema.fields}
    conds = []
    for name, entries in (spec or {}).items():
        if name in kinds:
            conds += [_entry(F.col(f"`{name}`"), kinds[name], e) for e in entries]
        elif entries:
            conds += [_entry(F.lit(None).cast("string"), "missing", e) for e in entries]
    return _group("AND", conds)


def apply_filter(df: DataFrame, spec: dict[str, list[dict]] | None = None, offset: int | None = None, limit: int | None = None) -> DataFrame:
    """Filter, then skip `offset` rows and keep `limit` of the rest."""
    out = df.where(compile_filter(df, spec)) if spec else df
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)
