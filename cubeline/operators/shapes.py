"""The query shapes, over raw events or over the metric rows of a rollup.

Over events, each is one aggregation of the columns it needs, after filters that reach the
scan; nothing is fanned out but what a dataset of all metrics asks for, within the task.
Over rollups (or the metric rows of a stream), the same answers come from summing cells.
Several sources or partitions are one table here, so results are merged by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cubeline.functions.granularity import bucket, coarser, raw_range
from cubeline.functions.naming import base_field, metric_key
from cubeline.model import TOTAL, DatasetQuery, FlatGroupsQuery, GroupsQuery, ReportQuery, Scope
from cubeline.operators.fanout import metric_rows
from cubeline.operators.hierarchy import tree
from cubeline.operators.rollup import exact_sum
from cubeline.sources.events import payload_fields


def scoped(events: DataFrame, q: Scope, storage: str = "minute") -> DataFrame:
    """The events that a query is about."""
    low, high = raw_range(*q.time_range, storage)
    c = (F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high))
    if q.sources:
        c = c & F.col("source_id").isin(*q.sources)
    if q.events:
        c = c & F.col("event_type").isin(*q.events)
    if q.attribution is not None:
        kind, value = q.attribution
        c = c & F.exists("attributions", lambda a: (a["type"] == kind) & (a["value"] == value))
    return events.where(c)


def scoped_rows(rows: DataFrame, q: Scope) -> DataFrame:
    """The metric rows that a query is about; BOOLEAN rows keep raw times, which the range takes in whole buckets."""
    start, end = q.time_range
    kind, value = q.attribution or (TOTAL, TOTAL)
    c = F.col("ts").between(F.lit(start), F.lit(end)) & (F.col("attribution_type") == kind) & (F.col("attribution_value") == value)
    if q.sources:
        c = c & F.col("source_id").isin(*q.sources)
    if q.events:
        c = c & F.col("event_type").isin(*q.events)
    return rows.where(c)


def _bucketed(df: DataFrame, q: Scope, storage: str) -> Column:
    return bucket(F.col("ts"), coarser(q.granularity, storage), df.schema["ts"].dataType).alias("timestamp")


def _text(events: DataFrame, name: str) -> Column:
    """A categorical field as text; a field the payload lacks is null."""
    kinds = {f.name: f.dataType for f in events.schema["payload"].dataType.fields}
    if name not in kinds:
        return F.lit(None).cast("string")
    return F.col("payload")[name].cast("string") if isinstance(kinds[name], BooleanType) else F.col("payload")[name]


def _number(events: DataFrame, name: str) -> Column:
    names = payload_fields(events)
    return F.col("payload")[name].cast("double") if name in names["numeric"] else F.lit(None).cast("double")


# --- report ---------------------------------------------------------------------------------


def report(events: DataFrame, q: ReportQuery, storage: str = "minute", scale: int | None = None) -> DataFrame:
    """timestamp, value (and category): one metric as a series.  Buckets without the field are absent."""
    e = scoped(events, q, storage)
    at = _bucketed(e, q, storage)
    fields = payload_fields(e)
    if q.group_by:  # sums of a number for each value of the first field
        if q.field is None:
            raise ValueError("group_by needs a field")
        v, c = _number(e, base_field(q.field)), _text(e, q.group_by[0])
        return e.select(at, c.alias("category"), v.alias("v")).where("v is not null and category is not null").groupBy("timestamp", "category").agg(exact_sum(F.col("v"), scale).alias("value"))
    if q.metric == "COUNT":
        return e.select(at).groupBy("timestamp").agg(F.count("*").cast("double").alias("value"))
    if q.metric == "CATEGORY":
        names = [q.field] if q.field else fields["categorical"]
        one = e.select(at, F.explode(F.array(*[_text(e, n) for n in names])).alias("category")) if len(names) > 1 else e.select(at, _text(e, names[0]).alias("category")) if names else None
        if one is None:
            return e.select(at, F.lit("").alias("category"), F.lit(0.0).alias("value")).limit(0)
        return one.where("category is not null").groupBy("timestamp", "category").agg(F.count("*").cast("double").alias("value"))
    if q.metric == "BOOLEAN":
        names = [q.field] if q.field else fields["boolean"]
        vs = [F.col("payload")[n].cast("double") for n in names if n in fields["boolean"]]
    else:
        names = [base_field(q.field)] if q.field else fields["numeric"]
        vs = [_number(e, n) for n in names]
    zero = F.lit(0.0)
    some = reduce(lambda a, b: a | b, [v.isNotNull() for v in vs], F.lit(False))
    total = reduce(lambda a, b: a + b, [F.coalesce(v, zero) for v in vs], zero)
    if q.metric == "COMPOUND_SUM":  # a number counts once for each category of its event
        times = reduce(lambda a, b: a + b, [_text(e, n).isNotNull().cast("int") for n in fields["categorical"]], F.lit(0))
        some, total = some & (times > 0), total * times
    return e.where(some).select(at, total.alias("v")).groupBy("timestamp").agg(exact_sum(F.col("v"), scale).alias("value"))


def report_from_rows(rows: DataFrame, q: ReportQuery, storage: str = "minute", scale: int | None = None) -> DataFrame:
    r = scoped_rows(rows, q)
    kind = "COMPOUND_SUM" if q.group_by else q.metric
    c = F.col("aggregation_type") == kind
    keys = ["timestamp"]
    if q.group_by:
        c = c & (F.col("compound_category_key") == q.group_by[0])
    if q.field and kind != "COUNT":
        c = c & (F.col("payload_field") == (q.field if kind in ("CATEGORY", "BOOLEAN") else base_field(q.field)))
    r = r.where(c).select(_bucketed(r, q, storage), F.col("payload_category").alias("category"), "value")
    if q.group_by or kind == "CATEGORY":
        keys.append("category")
    return r.groupBy(*keys).agg(exact_sum(F.col("value"), scale).alias("value"))


# --- dataset --------------------------------------------------------------------------------

_SHOWN = ("COUNT", "SUM", "CATEGORY", "COMPOUND_SUM")


def _subset(metrics: tuple[str, ...]) -> Column:
    """Counts always; other rows if their field is asked for, or no field is."""
    names = [base_field(m) for m in metrics if not m.endswith("_count")]
    if not names:
        return F.lit(True) if not metrics else F.col("aggregation_type") == "COUNT"
    return (F.col("aggregation_type") == "COUNT") | F.col("payload_field").isin(*names)


def dataset_rows(events: DataFrame, q: DatasetQuery, storage: str = "minute") -> DataFrame:
    """The metric rows of the events that a query is about."""
    return metric_rows(scoped(events, q, storage), storage, kinds=_SHOWN, attributions=False)


def dataset(events: DataFrame, q: DatasetQuery, storage: str = "minute", scale: int | None = None) -> DataFrame:
    """timestamp, metric_key, value, straight from events with declared payloads.

    Each event gives (number of the metric, category, value) for the metrics asked for; they
    are summed by number and category, and named only then.
    """
    e = scoped(events, q, storage)
    names = payload_fields(e)
    asked = {base_field(m) for m in q.metrics if not m.endswith("_count")}
    take = lambda n: not q.metrics or n in asked
    made: list[tuple[str, str, Column, Column]] = [("", "_count", F.col("event_type"), F.lit(1.0))]  # prefix, suffix, category, value
    none = F.lit(None).cast("string")
    for n in filter(take, names["numeric"]):
        made.append((f"{n}_sum", "", none, _number(e, n)))
        made += [(f"{n}_sum_by_{c}_", "", _text(e, c), F.when(_text(e, c).isNotNull(), _number(e, n))) for c in names["categorical"]]
    made += [(f"{c}_by_", "", _text(e, c), F.when(_text(e, c).isNotNull(), 1.0)) for c in filter(take, names["categorical"])]
    rows = F.array(*[F.struct(F.lit(i).alias("m"), c.alias("c"), v.alias("value")) for i, (_, _, c, v) in enumerate(made)])
    sums = e.select(_bucketed(e, q, storage), F.inline(rows)).where("value is not null").groupBy("timestamp", "m", "c").agg(exact_sum(F.col("value"), scale).alias("value"))
    part = lambda k: F.array(*[F.lit(x[k]) for x in made])[F.col("m")]
    return sums.select("timestamp", F.concat(part(0), F.coalesce("c", F.lit("")), part(1)).alias("metric_key"), "value")


def dataset_long(rows: DataFrame, q: DatasetQuery, storage: str = "minute", scale: int | None = None) -> DataFrame:
    """timestamp, metric_key, value, from scoped metric rows."""
    key = metric_key(F.col("aggregation_type"), F.col("event_type"), F.col("payload_field"), F.col("compound_category_key"), F.col("payload_category"))
    r = rows.where(F.col("aggregation_type").isin(*_SHOWN) & _subset(q.metrics))
    return r.select(_bucketed(r, q, storage), key.alias("metric_key"), "value").groupBy("timestamp", "metric_key").agg(exact_sum(F.col("value"), scale).alias("value"))


#: Columns of a wide dataset at most; with more metric keys, the map form serves.
MAX_KEYS = 10_000


def dataset_wide(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row a bucket, one column a metric key; null where a bucket lacks it.

    Without `keys`, one more job over `long` finds them; it should then be a table that is there, not one to be worked out.
    """
    if keys is None:
        keys = sorted(r[0] for r in long.select("metric_key").distinct().limit(MAX_KEYS + 1).collect() if r[0] is not None)
        if len(keys) > MAX_KEYS:
            raise ValueError(f"more than {MAX_KEYS} metric keys: ask for fewer metrics, or take dataset_map")
        if not keys:
            return long.select("timestamp").distinct()
    return long.groupBy("timestamp").pivot("metric_key", keys).agg(F.first("value"))


def dataset_map(long: DataFrame) -> DataFrame:
    """timestamp, metrics: one row a bucket with a map of its metric keys, in one pass and for any number of keys."""
    return long.groupBy("timestamp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_key", "value")))).alias("metrics"))


def boolean_facts(events: DataFrame, q: DatasetQuery, storage: str = "minute") -> DataFrame:
    """timestamp, name, value, at: the boolean facts of each bucket, one a row."""
    e = scoped(events, q, storage)
    names = payload_fields(e)["boolean"]
    facts = F.array(*[F.struct(F.lit(n).alias("name"), F.col("payload")[n].alias("value"), F.col("ts").alias("at")) for n in names]) if names else F.array().cast("array<struct<name:string,value:boolean,at:timestamp>>")
    return e.select(_bucketed(e, q, storage), F.inline(facts)).where("value is not null")


def boolean_groups(events: DataFrame, q: DatasetQuery, storage: str = "minute") -> DataFrame:
    """timestamp, $boolean_groups: the same, a sorted array for each bucket.  A bucket's facts come together in one row."""
    return _gather(boolean_facts(events, q, storage).select("timestamp", F.struct("name", "value", F.col("at").alias("timestamp")).alias("f")))


def boolean_groups_from_rows(rows: DataFrame, q: DatasetQuery, storage: str = "minute") -> DataFrame:
    low, high = raw_range(*q.time_range, storage)
    kind, value = q.attribution or (TOTAL, TOTAL)
    r = rows.where((F.col("aggregation_type") == "BOOLEAN") & (F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high)) & (F.col("attribution_type") == kind) & (F.col("attribution_value") == value))
    if q.sources:
        r = r.where(F.col("source_id").isin(*q.sources))
    if q.events:
        r = r.where(F.col("event_type").isin(*q.events))
    f = F.struct(F.col("payload_field").alias("name"), (F.col("value") == 1).alias("value"), F.col("ts").alias("timestamp"))
    return _gather(r.select(_bucketed(r, q, storage), f.alias("f")))


def _gather(facts: DataFrame) -> DataFrame:
    by_time = lambda a, b: F.when(_before(a, b), -1).when(_before(b, a), 1).otherwise(0)
    return facts.groupBy("timestamp").agg(F.array_sort(F.collect_list("f"), by_time).alias("$boolean_groups"))


def _before(a: Column, b: Column) -> Column:
    key = lambda x: F.struct(x["timestamp"], x["name"], ~x["value"])
    return key(a) < key(b)


def ordered(df: DataFrame, sort_by: str | None, descending: bool) -> DataFrame:
    """By a column, the greatest first unless told otherwise, nulls last; by time without one."""
    if sort_by is None or sort_by not in df.columns:
        return df.orderBy("timestamp")
    c = F.col(f"`{sort_by}`")
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "timestamp")


# --- groups ---------------------------------------------------------------------------------


def _split(metrics: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """(fields to sum, event types to count)"""
    return [base_field(m) for m in metrics if not m.endswith("_count")], [m.removesuffix("_count") for m in metrics if m.endswith("_count")]


def groups_long(events: DataFrame, q: GroupsQuery, storage: str = "minute", scale: int | None = None) -> DataFrame:
    """timestamp, dim, name, and a column a metric: totals (dim null) and one breakdown for each field, by grouping sets."""
    sums, counts = _split(q.metrics)
    e = scoped(events, q, storage)
    dims = list(dict.fromkeys(q.group_by))
    flat = e.select(_bucketed(e, q, storage), "event_type", *[_text(e, d).alias(f"_d{i}") for i, d in enumerate(dims)], *[_number(e, s).alias(f"_s{i}") for i, s in enumerate(sums)])
    cols = [F.col(f"_d{i}") for i in range(len(dims))]
    sets = [[F.col("timestamp")], *[[F.col("timestamp"), c] for c in cols]]
    # each combination of the fields is summed first: what the sets multiply is that, not events
    exact = (lambda v: v) if scale is None else (lambda v: v.cast(f"decimal(20,{scale})"))
    first = [F.sum(exact(F.col(f"_s{i}"))).alias(f"_s{i}") for i in range(len(sums))] + [F.sum((F.col("event_type") == t).cast("long")).alias(f"_n{i}") for i, t in enumerate(counts)]
    flat = flat.groupBy("timestamp", *cols).agg(*first) if first else flat.select("timestamp", *cols).distinct()
    aggs = [F.sum(f"_s{i}").cast("double").alias(f"{s}_sum") for i, s in enumerate(sums)]
    aggs += [F.sum(f"_n{i}").cast("double").alias(f"{t}_count") for i, t in enumerate(counts)]
    g = flat.groupingSets(sets, F.col("timestamp"), *cols).agg(F.grouping_id().alias("_g"), *aggs)
    # grouping_id has a 0 bit for each column that a set keeps; a null that is grouped by isn't a group
    full = (1 << len(dims)) - 1
    dim = reduce(lambda w, i: w.when(F.col("_g") == full - (1 << (len(dims) - 1 - i)), F.lit(dims[i])), range(len(dims)), F.when(F.lit(False), F.lit("")))
    name = F.coalesce(*cols) if cols else F.lit(None).cast("string")
    out = g.select("timestamp", dim.alias("dim"), name.alias("name"), *[F.col(f"`{s}_sum`") for s in sums], *[F.col(f"`{t}_count`") for t in counts])
    return out.where("dim is null or name is not null")


def groups_long_from_rows(rows: DataFrame, q: GroupsQuery, storage: str = "minute", scale: int | None = None) -> DataFrame:
    sums, counts = _split(q.metrics)
    r = scoped_rows(rows, q)
    kind, fld, key = F.col("aggregation_type"), F.col("payload_field"), F.col("compound_category_key")
    dims = list(q.group_by)
    total = kind.isin("SUM", "COUNT")
    by = (kind == "COMPOUND_SUM") & key.isin(*dims) | (kind == "CATEGORY") & fld.isin(*dims) if dims else F.lit(False)
    dim = F.when(kind == "COMPOUND_SUM", key).when(kind == "CATEGORY", fld)
    counted, summed = kind.isin("COUNT", "CATEGORY"), kind.isin("SUM", "COMPOUND_SUM")
    aggs = [exact_sum(F.when(summed & (fld == s), F.col("value")), scale).alias(f"{s}_sum") for s in sums]
    aggs += [F.coalesce(F.sum(F.when(counted & (F.col("event_type") == t), F.col("value"))), F.lit(0.0)).alias(f"{t}_count") for t in counts]
    at = _bucketed(r, q, storage)
    return r.where(total | by).groupBy(at, dim.alias("dim"), F.col("payload_category").alias("name")).agg(*aggs)


def groups_nested(long: DataFrame, q: GroupsQuery, fill: bool = False) -> DataFrame:
    """One row a bucket: totals, and `group_by_<f>` arrays of {name, metrics}; with `fill`, missing metrics are 0."""
    metrics = [c for c in long.columns if c not in ("timestamp", "dim", "name")]
    if fill:
        long = long.select("timestamp", "dim", "name", *[F.coalesce(F.col(f"`{m}`"), F.lit(0.0)).alias(m) for m in metrics])
    item = F.struct("name", *[F.col(f"`{m}`") for m in metrics])
    aggs = [F.first(F.when(F.col("dim").isNull(), F.col(f"`{m}`")), ignorenulls=True).alias(m) for m in metrics]
    aggs += [F.array_sort(F.collect_list(F.when(F.col("dim") == d, item))).alias(f"group_by_{d}") for d in dict.fromkeys(q.group_by)]
    out = long.groupBy("timestamp").agg(*aggs)
    return ordered(out, "timestamp", q.descending) if q.sort_by == "timestamp" else out


# --- flat groups ----------------------------------------------------------------------------


def flat_groups(events: DataFrame, q: FlatGroupsQuery, storage: str = "minute", scale: int | None = None) -> DataFrame:
    """The tree of sums over the fields of group_by, flattened in pre-order (see hierarchy)."""
    e = scoped(events, q, storage)
    field, levels = base_field(q.metric), list(q.group_by)
    kind = e.schema["ts"].dataType
    grains = list(q.group_by_granularity)
    if grains and storage not in grains:
        e = e.where(F.lit(False))
    leaf = e.select(*[_text(e, g).alias(g) for g in levels], _number(e, field).alias("_v"), bucket(F.col("ts"), storage, kind).alias("_t")).where("_v is not null")
    leaf = leaf.groupBy(*levels).agg(exact_sum(F.col("_v"), scale).alias("_v"), F.max("_t").alias("_t"))
    if grains:
        leaf, levels = leaf.withColumn("granularity", F.lit(storage)), ["granularity", *levels]
    return tree(leaf, levels, q, scale)


def flat_groups_from_rows(rows: DataFrame, q: FlatGroupsQuery, scale: int | None = None) -> DataFrame:
    """The same from rollup rows; with group_by_granularity each storage granularity is a branch of its own."""
    r = scoped_rows(rows, q).where((F.col("aggregation_type") == "LEAF_SUM") & (F.col("payload_field") == base_field(q.metric)))
    levels = list(q.group_by)
    if q.group_by_granularity:
        r = r.where(F.col("granularity").isin(*q.group_by_granularity))
    value = lambda g: F.get(F.transform(F.filter("leaf_key", lambda e: e["k"] == g), lambda e: e["v"]), F.lit(0))
    cols = [value(g).alias(g) for g in levels]
    if q.group_by_granularity:
        cols, levels = [F.col("granularity"), *cols], ["granularity", *levels]
    leaf = r.select(*cols, F.col("value").alias("_v"), F.col("ts").alias("_t")).groupBy(*levels).agg(exact_sum(F.col("_v"), scale).alias("_v"), F.max("_t").alias("_t"))
    return tree(leaf, levels, q, scale)
