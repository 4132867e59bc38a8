"""Events to metric rows.

Each event gives, for the total and for each of its attributions, one COUNT; for each number
a SUM and a LEAF_SUM (with all of the event's categories as leaf key); for each string or
boolean a CATEGORY; for each boolean a BOOLEAN; and for each number and category a
COMPOUND_SUM.  Times are cut to the storage granularity, but for BOOLEAN rows.

Query shapes don't need this: they aggregate events directly.  It serves rollups, and the
shapes over rollups.  All is array functions in one projection and two generators; nothing is
shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from cubeline.functions.granularity import bucket
from cubeline.model import METRIC_TYPES, TOTAL, CubeDef

DIMENSIONS = ("source_id", "event_type", "ts", "granularity", "attribution_type", "attribution_value", "aggregation_type", "payload_field", "payload_category", "compound_category_key", "leaf_key")
_LEAF = "array<struct<k:string,v:string>>"
_ROWS = f"array<struct<aggregation_type:string,payload_field:string,payload_category:string,compound_category_key:string,leaf_key:{_LEAF},value:double>>"
_NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _arrays(events: DataFrame) -> tuple[Column, Column, Column]:
    """(numbers, categories, booleans) of the payload as arrays of (k, v), each sorted by name."""
    t = events.schema["payload"].dataType
    if isinstance(t, StructType):
        from cubeline.sources.events import payload_fields

        names = payload_fields(events)
        kinds = {f.name: f.dataType for f in t.fields}
        p = F.col("payload")

        def pairs(of: list[str], value: Callable[[str], Column], kind: str) -> Column:
            if not of:
                return F.array().cast(f"array<struct<k:string,v:{kind}>>")
            return F.filter(F.array(*[F.struct(F.lit(n).alias("k"), value(n).alias("v")) for n in sorted(of)]), lambda e: e["v"].isNotNull())

        text = lambda n: p[n].cast("string") if isinstance(kinds[n], BooleanType) else p[n]
        return pairs(names["numeric"], lambda n: p[n].cast("double"), "double"), pairs(names["categorical"], text, "string"), pairs(names["boolean"], lambda n: p[n].cast("double"), "double")
    # a VARIANT: types are found value by value; nulls, objects and arrays are passed over
    entries = F.array_sort(F.transform(F.map_entries(F.variant_get("payload", "$", "map<string,variant>")), lambda e: _struct(k=e["key"], t=F.schema_of_variant(e["value"]), s=e["value"].cast("string"))))
    numbers = F.transform(F.filter(entries, lambda e: e["t"].rlike(_NUMBER)), lambda e: _struct(k=e["k"], v=e["s"].cast("double")))
    categories = F.transform(F.filter(entries, lambda e: e["t"].isin("STRING", "BOOLEAN")), lambda e: _struct(k=e["k"], v=e["s"]))
    booleans = F.transform(F.filter(entries, lambda e: e["t"] == "BOOLEAN"), lambda e: _struct(k=e["k"], v=(e["s"] == "true").cast("double")))
    return numbers, categories, booleans


def _struct(**fields: Column) -> Column:
    """A struct whose names hold inside lambdas too."""
    return F.named_struct(*[x for n, c in fields.items() for x in (F.lit(n), c)])


def _row(kind: str, field: Column, category: Column, group: Column, leaf: Column, value: Column) -> Column:
    return _struct(
        aggregation_type=F.lit(kind), payload_field=field.cast("string"), payload_category=category.cast("string"),
        compound_category_key=group.cast("string"), leaf_key=leaf.cast(_LEAF), value=value.cast("double"),
    )


def _typed_rows(events: DataFrame, kinds: set[str]) -> list[Column]:
    """One struct for each metric a declared payload can give; its value is null where an event lacks it."""
    from cubeline.sources.events import payload_fields

    names = payload_fields(events)
    types = {f.name: f.dataType for f in events.schema["payload"].dataType.fields}
    p, no = F.col("payload"), F.lit(None)
    text = {c: p[c].cast("string") if isinstance(types[c], BooleanType) else p[c] for c in sorted(names["categorical"])}
    number = {n: p[n].cast("double") for n in sorted(names["numeric"])}
    out = [_row("COUNT", no, no, no, no, F.lit(1.0))] if "COUNT" in kinds else []
    if "SUM" in kinds:
        out += [_row("SUM", F.lit(n), no, no, no, v) for n, v in number.items()]
    if "CATEGORY" in kinds:
        out += [_row("CATEGORY", F.lit(c), t, no, no, F.when(t.isNotNull(), 1.0)) for c, t in text.items()]
    if "BOOLEAN" in kinds:
        out += [_row("BOOLEAN", F.lit(b), no, no, no, p[b].cast("double")) for b in sorted(names["boolean"])]
    if "COMPOUND_SUM" in kinds:
        out += [_row("COMPOUND_SUM", F.lit(n), t, F.lit(c), no, F.when(t.isNotNull(), v)) for n, v in number.items() for c, t in text.items()]
    if "LEAF_SUM" in kinds:
        out += [_row("LEAF_SUM", F.lit(n), no, no, F.col("_c"), v) for n, v in number.items()]
    return out


def _variant_rows(kinds: set[str]) -> list[Column]:
    """Arrays of structs from what a VARIANT holds."""
    no = F.lit(None)
    parts = []
    if "COUNT" in kinds:
        parts.append(F.array(_row("COUNT", no, no, no, no, F.lit(1.0))))
    if "SUM" in kinds:
        parts.append(F.transform("_n", lambda n: _row("SUM", n["k"], no, no, no, n["v"])))
    if "CATEGORY" in kinds:
        parts.append(F.transform("_c", lambda c: _row("CATEGORY", c["k"], c["v"], no, no, F.lit(1.0))))
    if "BOOLEAN" in kinds:
        parts.append(F.transform("_b", lambda b: _row("BOOLEAN", b["k"], no, no, no, b["v"])))
    if "COMPOUND_SUM" in kinds:
        parts.append(F.flatten(F.transform("_n", lambda n: F.transform("_c", lambda c: _row("COMPOUND_SUM", n["k"], c["v"], c["k"], no, n["v"])))))
    if "LEAF_SUM" in kinds:
        parts.append(F.transform("_n", lambda n: _row("LEAF_SUM", n["k"], no, no, F.col("_c"), n["v"])))
    return parts


def metric_rows(events: DataFrame, granularity: str = "minute", kinds: Iterable[str] = METRIC_TYPES, attributions: bool = True, more: Callable[[DataFrame], DataFrame] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The metric rows of events: DIMENSIONS and value, and the columns of events in `carry`.

    `more` may add rows of the same columns for the events.

    A declared payload needs no lambdas but for leaf keys: its rows are one array of structs
    that compiled code builds and unpacks.
    """
    kinds = set(kinds)
    typed = isinstance(events.schema["payload"].dataType, StructType)
    numbers, categories, booleans = _arrays(events)
    held = [categories.alias("_c")] if "LEAF_SUM" in kinds or not typed else []
    held += ["payload"] if typed else [numbers.alias("_n"), booleans.alias("_b")]
    parts = F.array(*_typed_rows(events, kinds)).cast(_ROWS) if typed else F.concat(F.array().cast(_ROWS), *_variant_rows(kinds))
    kind = events.schema["ts"].dataType
    total = F.array(F.struct(F.lit(TOTAL).alias("type"), F.lit(TOTAL).alias("value")))
    who = F.concat(total, F.coalesce("attributions", F.array().cast("array<struct<type:string,value:string>>"))) if attributions else total
    e = events.select("source_id", "event_type", "ts", *carry, who.alias("_a"), *held)
    e = e.withColumn("_a", F.explode("_a")) if attributions else e.withColumn("_a", F.col("_a")[0])
    out = (
        e.select("source_id", "event_type", "ts", *carry, "_a", F.inline(parts)).where("value is not null")
        .select(
            "source_id", "event_type", F.when(F.col("aggregation_type") == "BOOLEAN", F.col("ts")).otherwise(bucket(F.col("ts"), granularity, kind)).alias("ts"), F.lit(granularity).alias("granularity"),
            F.col("_a.type").alias("attribution_type"), F.col("_a.value").alias("attribution_value"), "aggregation_type", "payload_field", "payload_category", "compound_category_key", "leaf_key", "value", *carry,
        )
    )
    return out if more is None else out.unionByName(more(events).select(*DIMENSIONS, "value", *carry))


def accepts(cube: CubeDef) -> Column:
    """Whether a cube takes an event, by source and by event type."""
    c = F.lit(True)
    if cube.sources:
        c = c & F.col("source_id").isin(*cube.sources)
    if cube.events:
        c = c & F.col("event_type").isin(*cube.events)
    return c
