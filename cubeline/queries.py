"""One query an operator, each with SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeline.functions import filters, formula
from cubeline.functions.granularity import GRANULARITIES, bucket, ordinal, to_ms
from cubeline.functions.naming import safe_name
from cubeline.model import CubeDef, DatasetQuery, FlatGroupsQuery, GroupsQuery, ReportQuery
from cubeline.operators import rollup, shapes
from cubeline.operators.fanout import accepts, metric_rows
from cubeline.plans.metadata import catalogue
from cubeline.sources import events as ev
from cubeline.sources import tables
from cubeline.streaming import realtime

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}

EVERYTHING = (dt.datetime(1990, 1, 1), dt.datetime(2030, 1, 1))
SCALE = 4


def query(name: str, sql: str) -> Callable[[Q], Q]:
    def put(f: Q) -> Q:
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


def at(ts: str, g: str) -> str:
    """A bucket's start in SQL, on whole microseconds."""
    us = to_ms(g) * 1000
    return f"make_timestamp(epoch_us({ts}) - ((epoch_us({ts}) % {us}) + {us}) % {us})"


def exact(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(20,{SCALE}))) AS DOUBLE)"


# The event streams in SQL.
ACTIVITY = """act AS (SELECT CAST(event_id AS VARCHAR) AS uuid, event_type, ts, CAST(user_id AS VARCHAR) AS usr, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS band, value > 50 AS big FROM events)"""
SHIPPED = """shp AS (SELECT l_shipdate AS ts, 'line_shipped' AS event_type, CAST(l_suppkey AS VARCHAR) AS supplier, l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount,
  l_tax AS tax, l_returnflag AS returnflag, l_linestatus AS linestatus, l_discount > 0.05 AS discounted FROM lineitem)"""
PLACES = """plc AS (SELECT o_orderdate AS ts, o_totalprice AS totalprice, r_name AS region, n_name AS nation, c_mktsegment AS mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _report(name: str, stream: Callable, q: ReportQuery, sql: str) -> None:
    query(name, sql)(lambda s, d: shapes.report(stream(s, d), q, "minute", SCALE))


# --- reports --------------------------------------------------------------------------------

_A = ReportQuery(EVERYTHING, "6hour")
_S = ReportQuery(EVERYTHING, "7day", metric="SUM", field="extendedprice")
_report("report_count", tables.activity, _A, f"WITH {ACTIVITY} SELECT {at('ts', '6hour')} AS timestamp, CAST(count(*) AS DOUBLE) AS value FROM act GROUP BY 1")
_report("report_sum", tables.line_shipped, _S, f"WITH {SHIPPED} SELECT {at('ts', '7day')} AS timestamp, {exact('extendedprice')} AS value FROM shp GROUP BY 1")
_report("report_category", tables.line_shipped, replace(_S, granularity="30day", metric="CATEGORY", field="returnflag"), f"WITH {SHIPPED} SELECT {at('ts', '30day')} AS timestamp, returnflag AS category, CAST(count(*) AS DOUBLE) AS value FROM shp GROUP BY 1, 2")
_report("report_group_by", tables.line_shipped, replace(_S, granularity="30day", group_by=("linestatus",)), f"WITH {SHIPPED} SELECT {at('ts', '30day')} AS timestamp, linestatus AS category, {exact('extendedprice')} AS value FROM shp GROUP BY 1, 2")
_report("report_boolean", tables.activity, replace(_A, metric="BOOLEAN", field="big"), f"WITH {ACTIVITY} SELECT {at('ts', '6hour')} AS timestamp, CAST(sum(CAST(big AS INT)) AS DOUBLE) AS value FROM act GROUP BY 1")
_report("report_compound_sum", tables.line_shipped, replace(_S, metric="COMPOUND_SUM", field="quantity"), f"WITH {SHIPPED} SELECT {at('ts', '7day')} AS timestamp, {exact('quantity * 3')} AS value FROM shp GROUP BY 1")
_report("report_leaf_sum", tables.line_shipped, replace(_S, metric="LEAF_SUM", field="quantity"), f"WITH {SHIPPED} SELECT {at('ts', '7day')} AS timestamp, {exact('quantity')} AS value FROM shp GROUP BY 1")
_report("report_all_fields", tables.order_placed, replace(_S, granularity="90day", field=None), f"SELECT {at('o_orderdate', '90day')} AS timestamp, {exact('o_totalprice')} AS value FROM orders GROUP BY 1")
_report("report_attribution", tables.activity, replace(_A, metric="SUM", field="value", attribution=("user", "7")), f"WITH {ACTIVITY} SELECT {at('ts', '6hour')} AS timestamp, {exact('value')} AS value FROM act WHERE usr = '7' GROUP BY 1")
_report("report_event_filter", tables.activity, replace(_A, metric="SUM", field="value", events=("purchase", "click")), f"WITH {ACTIVITY} SELECT {at('ts', '6hour')} AS timestamp, {exact('value')} AS value FROM act WHERE event_type IN ('purchase', 'click') GROUP BY 1")
_report(
    "report_time_range_inclusive", tables.activity, replace(_A, granularity="hour", time_range=(dt.datetime(2024, 1, 5, 3, 30, 20), dt.datetime(2024, 1, 9, 18, 0))),
    f"WITH {ACTIVITY} SELECT {at('ts', 'hour')} AS timestamp, CAST(count(*) AS DOUBLE) AS value FROM act WHERE {at('ts', 'minute')} BETWEEN TIMESTAMP '2024-01-05 03:30:20' AND TIMESTAMP '2024-01-09 18:00:00' GROUP BY 1",
)


@query("report_multi_source", f"WITH u AS (SELECT o_orderdate AS ts FROM orders UNION ALL SELECT l_shipdate FROM lineitem) SELECT {at('ts', '30day')} AS timestamp, CAST(count(*) AS DOUBLE) AS value FROM u GROUP BY 1")
def report_multi_source(s, d):
    cols = ["uuid", "source_id", "event_type", "ts", "attributions"]
    both = tables.order_placed(s, d).select(*cols).unionByName(tables.line_shipped(s, d).select(*cols)).withColumn("payload", F.struct(F.lit(None).cast("double").alias("none")))
    return shapes.report(both, ReportQuery(EVERYTHING, "30day", sources=("sales", "shipping")), "minute", SCALE)


for _g in GRANULARITIES:

    def _bucketed(s, d, g=_g):
        e = tables.activity(s, d)
        return shapes.report(e, ReportQuery(EVERYTHING, g), "100ms" if g.endswith("ms") else "minute" if g != "second" else "second", SCALE) if to_ms(g) not in (200, 250, 500) else shapes.report(e, ReportQuery(EVERYTHING, g), g, SCALE)

    query(f"bucket_{_g}", f"SELECT {at('ts', _g)} AS timestamp, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1")(_bucketed)


@query("partition_ordinal", "SELECT CAST(floor(epoch_ms(ts) / 600000.0) AS BIGINT) AS idx, 'cells_' || CAST(CAST(floor(epoch_ms(ts) / 600000.0) AS BIGINT) AS VARCHAR) AS name, count(*) AS n FROM (SELECT date_trunc('second', ts) AS ts FROM events) GROUP BY 1, 2")
def partition_ordinal(s, d):
    idx = ordinal(F.col("ts"), "minute", 10)
    return tables.activity(s, d).groupBy(idx.alias("idx")).agg(F.count("*").alias("n")).select("idx", F.concat_ws("_", F.lit("cells"), F.col("idx").cast("string")).alias("name"), "n")


_CUBE = CubeDef("r", "c", "hour", partitioned=True, partition_length=24)
_MID = (dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9, 18))


@query("partition_pruned_sum", f"SELECT {at('ts', 'day')} AS timestamp, {exact('value')} AS value FROM events WHERE {at('ts', 'hour')} BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 18:00:00' GROUP BY 1")
def partition_pruned_sum(s, d):
    rows = rollup.pruned(rollup.build(tables.activity(s, d), _CUBE, SCALE), _CUBE, *_MID)
    return shapes.report_from_rows(rows, ReportQuery(_MID, "day", metric="SUM", field="value"), "hour", SCALE)


# --- fan-out and rollup ---------------------------------------------------------------------


@query(
    "fanout_counts",
    """SELECT t AS aggregation_type, CAST(2 * count(*) * n AS BIGINT) AS n_rows FROM events, (VALUES ('COUNT', 1), ('SUM', 2), ('CATEGORY', 2), ('BOOLEAN', 1), ('COMPOUND_SUM', 4), ('LEAF_SUM', 2)) v(t, n) GROUP BY t, n""",
)
def fanout_counts(s, d):
    return metric_rows(tables.activity(s, d)).groupBy("aggregation_type").agg(F.count("*").alias("n_rows"))


@query(
    "fanout_variant_table",
    """WITH e AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
    SELECT event_type, 'SUM' AS aggregation_type, 'k' AS payload_field, sum(k) AS value FROM e GROUP BY 1
    UNION ALL SELECT event_type, 'LEAF_SUM', 'k', sum(k) FROM e GROUP BY 1 UNION ALL SELECT event_type, 'COUNT', NULL, count(*) FROM e GROUP BY 1""",
)
def fanout_variant_table(s, d):
    """The table's own JSON column as it stands, its kinds found value by value."""
    e = s.read.parquet(f"{d}/events.parquet").select(F.lit("v").alias("source_id"), "event_type", "ts", F.array().cast(ev.ATTRIBUTIONS).alias("attributions"), F.parse_json("props").alias("payload"))
    return metric_rows(e, "day").groupBy("event_type", "aggregation_type", "payload_field").agg(F.sum("value").alias("value"))


@query(
    "fanout_variant",
    """WITH e AS (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
    SELECT 'COUNT' AS aggregation_type, CAST(NULL AS VARCHAR) AS payload_field, CAST(count(*) AS DOUBLE) AS value FROM e
    UNION ALL SELECT 'SUM', 'k', CAST(sum(k) AS DOUBLE) FROM e
    UNION ALL SELECT 'CATEGORY', 'type', CAST(count(*) AS DOUBLE) FROM e
    UNION ALL SELECT 'CATEGORY', 'odd', CAST(count(*) AS DOUBLE) FROM e
    UNION ALL SELECT 'BOOLEAN', 'odd', CAST(sum(CAST(k AS INT) % 2) AS DOUBLE) FROM e
    UNION ALL SELECT 'COMPOUND_SUM', 'k', CAST(2 * sum(k) AS DOUBLE) FROM e
    UNION ALL SELECT 'LEAF_SUM', 'k', CAST(sum(k) AS DOUBLE) FROM e""",
)
def fanout_variant(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    js = F.concat(F.lit('{"k": '), k.cast("string"), F.lit(', "type": "'), F.col("event_type"), F.lit('", "odd": '), (k % 2 == 1).cast("string"), F.lit(', "none": null, "list": [1], "obj": {"a": 1}}'))
    e = s.read.parquet(f"{d}/events.parquet").select(F.lit("v").alias("source_id"), "event_type", "ts", F.array().cast(ev.ATTRIBUTIONS).alias("attributions"), F.parse_json(js).alias("payload"))
    return metric_rows(e, "day").groupBy("aggregation_type", "payload_field").agg(F.sum("value").alias("value"))


@query(
    "fanout_rollup",
    f"""WITH {ACTIVITY}, b AS (SELECT *, {at('ts', 'day')} AS t FROM act), w AS (SELECT *, '_total' AS attribution_type, '_total' AS attribution_value FROM b UNION ALL SELECT *, 'user', usr FROM b)
    SELECT event_type, t AS ts, attribution_type, attribution_value, 'COUNT' AS aggregation_type, CAST(NULL AS VARCHAR) AS payload_field, CAST(NULL AS VARCHAR) AS payload_category, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY ALL
    UNION ALL SELECT event_type, t, attribution_type, attribution_value, 'SUM', 'value', NULL, {exact('value')} FROM w GROUP BY ALL
    UNION ALL SELECT event_type, t, attribution_type, attribution_value, 'SUM', 'k', NULL, {exact('k')} FROM w GROUP BY ALL
    UNION ALL SELECT event_type, t, attribution_type, attribution_value, 'CATEGORY', 'band', band, CAST(count(*) AS DOUBLE) FROM w GROUP BY ALL
    UNION ALL SELECT event_type, t, attribution_type, attribution_value, 'CATEGORY', 'big', CAST(big AS VARCHAR), CAST(count(*) AS DOUBLE) FROM w GROUP BY ALL""",
)
def fanout_rollup(s, d):
    cells = rollup.merge(metric_rows(tables.activity(s, d), "day", kinds=("COUNT", "SUM", "CATEGORY")), SCALE)
    return cells.select("event_type", "ts", "attribution_type", "attribution_value", "aggregation_type", "payload_field", "payload_category", "value")


@query("late_correction", f"WITH u AS (SELECT ts, value FROM events UNION ALL SELECT ts, -value FROM events WHERE event_type = 'error') SELECT {at('ts', 'day')} AS timestamp, {exact('value')} AS value FROM u GROUP BY 1")
def late_correction(s, d):
    e = tables.activity(s, d)
    late = e.where("event_type = 'error'").withColumn("payload", F.struct((-F.col("payload.value")).alias("value"), "payload.k", "payload.band", "payload.big"))
    cube = CubeDef("r", "c", "day")
    both = rollup.build(e, cube, SCALE).unionByName(rollup.build(late, cube, SCALE))  # two batches of one table
    return shapes.report_from_rows(rollup.merge(both, SCALE), ReportQuery(EVERYTHING, "day", metric="SUM", field="value"), "day", SCALE)


# --- events ---------------------------------------------------------------------------------


@query("dedupe_uuid", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS uuid FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_returnflag = 'R' AND x.l_orderkey = lineitem.l_orderkey AND x.l_linenumber = lineitem.l_linenumber)")
def dedupe_uuid(s, d):
    e = tables.line_shipped(s, d)
    return ev.dedupe(e, e.where("payload.returnflag = 'R'")).select("uuid")


@query("event_type_validation", "SELECT CAST(event_id AS VARCHAR) AS uuid FROM events WHERE event_type NOT IN ('view', 'click', 'signup')")
def event_type_validation(s, d):
    types = s.createDataFrame([("activity", t) for t in ("view", "click", "signup")], "source_id string, event_type string")
    return ev.unknown_types(tables.activity(s, d), types).select("uuid")


@query("recent_events_topk", "SELECT CAST(event_id AS VARCHAR) AS uuid, ts FROM events ORDER BY ts DESC, uuid LIMIT 20")
def recent_events_topk(s, d):
    return ev.recent(tables.activity(s, d), "activity").select("uuid", "ts")


@query("raw_counts", "SELECT 'activity' AS source_id, count(*) AS n_events FROM events UNION ALL SELECT 'idle', 0")
def raw_counts(s, d):
    return ev.raw_counts(tables.activity(s, d), s.createDataFrame([("activity",), ("idle",)], "source_id string"))


@query("default_timestamp", "SELECT count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS filled FROM events")
def default_timestamp(s, d):
    e = tables.activity(s, d).withColumn("ts", F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp")))
    filled = e.select(F.col("ts").isNull().alias("gap"), ev.with_default_ts(F.col("ts")).alias("ts")).where("ts is not null")
    return filled.agg(F.count("*").alias("n"), F.count(F.when(F.col("gap"), 1)).alias("filled"))


@query("name_sanitizer", "SELECT DISTINCT regexp_replace(lower(o_orderpriority), '[^a-z0-9_]', '_', 'g') AS name FROM orders")
def name_sanitizer(s, d):
    return s.read.parquet(f"{d}/orders.parquet").select(safe_name(F.col("o_orderpriority")).alias("name")).distinct()


# --- datasets -------------------------------------------------------------------------------

_D = DatasetQuery(EVERYTHING, "day")
_LONG = f"""b AS (SELECT *, {at('ts', 'day')} AS t FROM act), long AS (
    SELECT t AS timestamp, event_type || '_count' AS metric_key, CAST(count(*) AS DOUBLE) AS value FROM b GROUP BY ALL
    UNION ALL SELECT t, 'value_sum', {exact('value')} FROM b GROUP BY ALL UNION ALL SELECT t, 'k_sum', {exact('k')} FROM b GROUP BY ALL
    UNION ALL SELECT t, 'band_by_' || band, CAST(count(*) AS DOUBLE) FROM b GROUP BY ALL UNION ALL SELECT t, 'big_by_' || CAST(big AS VARCHAR), CAST(count(*) AS DOUBLE) FROM b GROUP BY ALL
    UNION ALL SELECT t, 'value_sum_by_band_' || band, {exact('value')} FROM b GROUP BY ALL UNION ALL SELECT t, 'k_sum_by_band_' || band, {exact('k')} FROM b GROUP BY ALL
    UNION ALL SELECT t, 'value_sum_by_big_' || CAST(big AS VARCHAR), {exact('value')} FROM b GROUP BY ALL UNION ALL SELECT t, 'k_sum_by_big_' || CAST(big AS VARCHAR), {exact('k')} FROM b GROUP BY ALL)"""


def _long(s, d, q=_D):
    return shapes.dataset(tables.activity(s, d), q, "minute", SCALE)


@query("dataset_long", f"WITH {ACTIVITY}, {_LONG} SELECT timestamp, metric_key, value FROM long")
def dataset_long(s, d):
    return _long(s, d)


_KEYS = ["click_count", "value_sum", "k_sum", "band_by_low", "value_sum_by_band_high", "k_sum_by_big_true"]


@query("dataset_wide", f"WITH {ACTIVITY}, {_LONG} SELECT timestamp, " + ", ".join(f"max(CASE WHEN metric_key = '{k}' THEN value END) AS {k}" for k in _KEYS) + " FROM long GROUP BY 1")
def dataset_wide(s, d):
    return shapes.dataset_wide(_long(s, d), _KEYS)


@query("dataset_subset", f"WITH {ACTIVITY}, {_LONG} SELECT timestamp, metric_key, value FROM long WHERE metric_key LIKE '%\\_count' ESCAPE '\\' OR metric_key = 'value_sum' OR metric_key LIKE 'value\\_sum\\_by%' ESCAPE '\\'")
def dataset_subset(s, d):
    return _long(s, d, replace(_D, metrics=("value",)))


@query("dataset_sorted", f"WITH {ACTIVITY}, {_LONG}, w AS (SELECT timestamp, max(CASE WHEN metric_key = 'value_sum' THEN value END) AS value_sum FROM long GROUP BY 1) SELECT timestamp, value_sum, CAST(row_number() OVER (ORDER BY value_sum DESC, timestamp) AS INT) AS place FROM w ORDER BY place LIMIT 10")
def dataset_sorted(s, d):
    from pyspark.sql import Window

    wide = shapes.ordered(shapes.dataset_wide(_long(s, d), ["value_sum"]), "value_sum", True).limit(10)
    return wide.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value_sum"), "timestamp")))


@query("dataset_boolean_groups", f"WITH {ACTIVITY} SELECT {at('ts', 'hour')} AS timestamp, 'big' AS name, big AS value, ts AS at FROM act")
def dataset_boolean_groups(s, d):
    q = replace(_D, granularity="hour")
    return shapes.boolean_facts(tables.activity(s, d), q)


@query("dataset_boolean_arrays", f"WITH {ACTIVITY} SELECT {at('ts', 'hour')} AS timestamp, 'big' AS name, big AS value, ts AS at FROM act")
def dataset_boolean_arrays(s, d):
    q = replace(_D, granularity="hour")
    return shapes.boolean_groups(tables.activity(s, d), q).select("timestamp", F.inline("$boolean_groups").alias("name", "value", "at"))


@query("dataset_map", f"WITH {ACTIVITY}, {_LONG} SELECT timestamp, metric_key, value FROM long")
def dataset_map(s, d):
    """Any number of metric keys, as a map for each bucket."""
    return shapes.dataset_map(_long(s, d)).select("timestamp", F.explode("metrics").alias("metric_key", "value"))


@query("dataset_wide_found", f"WITH {ACTIVITY}, {_LONG} SELECT timestamp, metric_key, value FROM long")
def dataset_wide_found(s, d):
    """The columns of a wide dataset found in the data."""
    wide = shapes.dataset_wide(_long(s, d))
    keys = [c for c in wide.columns if c != "timestamp"]
    return wide.unpivot(["timestamp"], [F.col(f"`{k}`") for k in keys], "metric_key", "value").where("value is not null")


@query("dataset_from_fanout", f"WITH {ACTIVITY}, {_LONG} SELECT timestamp, metric_key, value FROM long")
def dataset_from_fanout(s, d):
    return shapes.dataset_long(shapes.dataset_rows(tables.activity(s, d), _D), _D, "minute", SCALE)


@query("dataset_from_rollup", f"WITH {ACTIVITY}, {_LONG} SELECT timestamp, metric_key, value FROM long")
def dataset_from_rollup(s, d):
    cells = rollup.build(tables.activity(s, d), CubeDef("r", "c", "hour"), SCALE)
    return shapes.dataset_long(shapes.scoped_rows(cells, _D), _D, "hour", SCALE)


# --- groups ---------------------------------------------------------------------------------

_G = GroupsQuery(EVERYTHING, "90day", metrics=("extendedprice", "quantity", "line_shipped_count"), group_by=("returnflag", "linestatus"))
_GSUM = f"{exact('extendedprice')} AS extendedprice_sum, {exact('quantity')} AS quantity_sum, CAST(count(*) AS DOUBLE) AS line_shipped_count"
_GSQL = f"""WITH {SHIPPED}, b AS (SELECT *, {at('ts', '90day')} AS timestamp FROM shp)
  SELECT timestamp, CAST(NULL AS VARCHAR) AS dim, CAST(NULL AS VARCHAR) AS name, {_GSUM} FROM b GROUP BY ALL
  UNION ALL SELECT timestamp, 'returnflag', returnflag, {_GSUM} FROM b GROUP BY ALL UNION ALL SELECT timestamp, 'linestatus', linestatus, {_GSUM} FROM b GROUP BY ALL"""


@query("groups_long", _GSQL)
def groups_long(s, d):
    return shapes.groups_long(tables.line_shipped(s, d), _G, "minute", SCALE)


@query("groups_from_rollup", _GSQL)
def groups_from_rollup(s, d):
    cells = rollup.build(tables.line_shipped(s, d), CubeDef("r", "c", "day"), SCALE)
    return shapes.groups_long_from_rows(cells, _G, "day", SCALE)


@query("groups_multi_dim", f"""WITH {PLACES}, b AS (SELECT *, {at('ts', '90day')} AS timestamp FROM plc)
  SELECT timestamp, 'region' AS dim, region AS name, {exact('totalprice')} AS totalprice_sum FROM b GROUP BY ALL
  UNION ALL SELECT timestamp, 'nation', nation, {exact('totalprice')} FROM b GROUP BY ALL UNION ALL SELECT timestamp, 'mktsegment', mktsegment, {exact('totalprice')} FROM b GROUP BY ALL""")
def groups_multi_dim(s, d):
    q = GroupsQuery(EVERYTHING, "90day", metrics=("totalprice",), group_by=("region", "nation", "mktsegment"))
    return shapes.groups_long(tables.orders_by_place(s, d), q, "minute", SCALE).where("dim is not null")


@query("groups_nested", f"WITH {SHIPPED} SELECT {at('ts', '90day')} AS timestamp, {exact('quantity')} AS quantity_sum, CAST(count(DISTINCT returnflag) AS INT) AS n_flags, min(returnflag) AS first_flag FROM shp GROUP BY 1")
def groups_nested(s, d):
    n = shapes.groups_nested(shapes.groups_long(tables.line_shipped(s, d), _G, "minute", SCALE), _G)
    return n.select("timestamp", "quantity_sum", F.size("group_by_returnflag").alias("n_flags"), F.col("group_by_returnflag")[0]["name"].alias("first_flag"))


# --- flat groups ----------------------------------------------------------------------------


def _flat(df: DataFrame, metric: str) -> DataFrame:
    return df.select(
        F.col("rank").cast("long").alias("rank"), "id", F.array_join("$parent_id", ",").alias("parents"), F.col("$group_by").alias("group_by"), F.col("$group_level").cast("int").alias("level"),
        F.col("$is_group_root").alias("is_root"), F.col(metric).alias("value"), "timestamp",
    )


def _flat_sql(with_: str, table: str, levels: list[str], value: str, where: str = "TRUE") -> str:
    """Prefix sums of possibly ragged paths, numbered in pre-order, in SQL."""
    items = ", ".join(f"{{'x': CAST({g} AS VARCHAR), 'lvl': {i}}}" for i, g in enumerate(levels))
    names = "[" + ", ".join(f"'{g}'" for g in levels) + "]"
    return f"""WITH {with_}, leaf AS (SELECT list_filter([{items}], lambda e: e.x IS NOT NULL) AS p, {value} AS v, ts FROM {table} WHERE {where} AND {value} IS NOT NULL),
    pre AS (SELECT p, v, ts, unnest(range(1, len(p) + 1)) AS i FROM leaf),
    node AS (SELECT list_slice(p, 1, i) AS node, {exact('v')} AS value, max({at('ts', 'minute')}) AS timestamp, bool_or(len(p) > i) AS is_root FROM pre GROUP BY 1),
    num AS (SELECT *, row_number() OVER (ORDER BY node) AS rank FROM node),
    up AS (SELECT a.rank, string_agg('ji-' || CAST(b.rank AS VARCHAR), ',' ORDER BY b.rank) AS parents FROM num a JOIN num b ON len(b.node) < len(a.node) AND list_slice(a.node, 1, len(b.node)) = b.node GROUP BY 1)
    SELECT num.rank, 'ji-' || CAST(num.rank AS VARCHAR) AS id, parents, {names}[node[-1].lvl + 1] AS group_by, CAST(node[-1].lvl AS INT) AS level, is_root, value, timestamp FROM num LEFT JOIN up ON num.rank = up.rank"""


@query("flat_groups_2", _flat_sql(SHIPPED, "shp", ["returnflag", "linestatus"], "extendedprice"))
def flat_groups_2(s, d):
    q = FlatGroupsQuery(EVERYTHING, "minute", metrics=("extendedprice",), group_by=("returnflag", "linestatus"))
    return _flat(shapes.flat_groups(tables.line_shipped(s, d), q, "minute", SCALE), "extendedprice")


_F3 = FlatGroupsQuery(EVERYTHING, "minute", metrics=("totalprice",), group_by=("region", "nation", "mktsegment"))


@query("flat_groups_3", _flat_sql(PLACES, "plc", ["region", "nation", "mktsegment"], "totalprice"))
def flat_groups_3(s, d):
    return _flat(shapes.flat_groups(tables.orders_by_place(s, d), _F3, "minute", SCALE), "totalprice")


@query("flat_groups_sorted", _flat_sql(PLACES, "plc", ["region", "nation", "mktsegment"], "totalprice"))
def flat_groups_sorted(s, d):
    return _flat(shapes.flat_groups(tables.orders_by_place(s, d), replace(_F3, sort_by="nation", binary_order=True), "minute", SCALE), "totalprice")


@query("flat_groups_from_rollup", _flat_sql(SHIPPED, "shp", ["returnflag", "linestatus"], "extendedprice"))
def flat_groups_from_rollup(s, d):
    cells = rollup.build(tables.line_shipped(s, d), CubeDef("r", "c", "day"), SCALE)
    q = FlatGroupsQuery(EVERYTHING, "day", metrics=("extendedprice",), group_by=("returnflag", "linestatus"))
    return _flat(shapes.flat_groups_from_rows(cells, q, SCALE), "extendedprice")


@query("flat_groups_granularity", _flat_sql(SHIPPED + ", g AS (SELECT *, 'day' AS granularity FROM shp UNION ALL SELECT *, '7day' FROM shp)", "g", ["granularity", "returnflag"], "quantity").replace(f"max({at('ts', 'minute')})", f"max(CASE p[1].x WHEN 'day' THEN {at('ts', 'day')} ELSE {at('ts', '7day')} END)"))
def flat_groups_granularity(s, d):
    e = tables.line_shipped(s, d)
    cells = rollup.build(e, CubeDef("r", "a", "day"), SCALE).unionByName(rollup.build(e, CubeDef("r", "b", "7day"), SCALE))
    q = FlatGroupsQuery(EVERYTHING, "day", metrics=("quantity",), group_by=("returnflag",), group_by_granularity=("day", "7day"))
    return _flat(shapes.flat_groups_from_rows(cells, q, SCALE), "quantity")


_RAGGED = PLACES + ", rag AS (SELECT ts, totalprice, CASE WHEN region <> 'ASIA' THEN region END AS region, CASE WHEN mktsegment <> 'MACHINERY' THEN nation END AS nation, CASE WHEN totalprice > 100000 THEN mktsegment END AS mktsegment FROM plc)"


@query("flat_groups_ragged", _flat_sql(_RAGGED, "rag", ["region", "nation", "mktsegment"], "totalprice"))
def flat_groups_ragged(s, d):
    p = F.col("payload")
    e = tables.orders_by_place(s, d).withColumn("payload", F.struct(
        p["totalprice"].alias("totalprice"), F.when(p["region"] != "ASIA", p["region"]).alias("region"), F.when(p["mktsegment"] != "MACHINERY", p["nation"]).alias("nation"),
        F.when(p["totalprice"] > 100000, p["mktsegment"]).alias("mktsegment")))
    return _flat(shapes.flat_groups(e, replace(_F3, binary_order=True), "minute", SCALE), "totalprice")


# --- filters --------------------------------------------------------------------------------


def _orders(s, d):
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


for _n, _spec, _where in (
    ("eq", {"o_orderpriority": [{"operator": "EQ", "value": "1-URGENT"}]}, "o_orderpriority = '1-URGENT'"),
    ("neq", {"o_orderstatus": [{"operator": "NEQ", "value": "F"}]}, "o_orderstatus <> 'F'"),
    ("gt", {"o_totalprice": [{"operator": "GT", "value": 300000}]}, "o_totalprice > 300000"),
    ("gte", {"o_totalprice": [{"operator": "GTE", "value": 300000.5}]}, "o_totalprice >= 300000.5"),
    ("lt", {"o_orderpriority": [{"operator": "LT", "value": "2"}]}, "o_orderpriority < '2'"),
    ("lte", {"o_totalprice": [{"operator": "LTE", "value": 9000}]}, "o_totalprice <= 9000"),
    ("contains", {"o_orderpriority": [{"operator": "CONTAINS", "value": "HIGH"}]}, "contains(o_orderpriority, 'HIGH')"),
    ("not_contains", {"o_orderpriority": [{"operator": "NOT_CONTAINS", "value": "HIGH"}, {"operator": "NEQ", "value": 5}]}, "NOT contains(o_orderpriority, 'HIGH')"),
    ("type_mismatch", {"o_totalprice": [{"operator": "NEQ", "value": "x"}], "o_orderstatus": [{"OR": [{"operator": "GT", "value": 1}, {"operator": "EQ", "value": "P"}]}]}, "o_orderstatus = 'P'"),
    (
        "and_or", {"o_totalprice": [{"OR": [{"operator": "LT", "value": 20000}, {"AND": [{"operator": "GT", "value": 200000}, {"operator": "LTE", "value": 210000}]}]}], "o_orderstatus": [{"operator": "EQ", "value": "O"}]},
        "(o_totalprice < 20000 OR (o_totalprice > 200000 AND o_totalprice <= 210000)) AND o_orderstatus = 'O'",
    ),
):
    query(f"filter_{_n}", f"SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders WHERE {_where}")(lambda s, d, spec=_spec: filters.apply_filter(_orders(s, d), spec))


@query("filter_missing_field", "SELECT 'missing' AS field, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'no condition', count(*) FROM orders UNION ALL SELECT 'beside another', 0")
def filter_missing_field(s, d):
    """A field that rows lack fails every condition, alone or beside one that holds; no condition on it asks for nothing."""
    some = {"missing": {"nothing": [{"operator": "NEQ", "value": 1}]}, "no condition": {"nothing": []}, "beside another": {"nothing": [{"operator": "EQ", "value": 1}], "o_totalprice": [{"operator": "GT", "value": 0}]}}
    out = None
    for name, spec in some.items():
        n = filters.apply_filter(_orders(s, d), spec).agg(F.lit(name).alias("field"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("filter_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def filter_limit_offset(s, d):
    o = _orders(s, d).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return filters.apply_filter(o, {"o_totalprice": [{"operator": "GT", "value": 100000}]}, offset=10, limit=25)


# --- formulas -------------------------------------------------------------------------------

_INF, _NAN = "CAST('inf' AS DOUBLE)", "CAST('nan' AS DOUBLE)"
_ROUND = "round({x}, 9)"
_FORMULAS = {
    "arith": ("(a + b) * 2 - a / 4", "(a + b) * 2 - a / 4"),
    "div_zero": ("a / (b - b)", "0.0 * a"),
    "literal": ("-1.5e1 * a + .5", "-15.0 * a + 0.5"),
    "pow": ("pow(b, 2)", "pow(b, 2)"),
    "sqrt": ("sqrt(a)", "sqrt(a)"),
    "max": ("max(a, b * 1000, 7)", "greatest(a, b * 1000, 7.0)"),
    "min": ("min(a, b * 1000)", "least(a, b * 1000)"),
    "abs": ("abs(b - 25)", "abs(b - 25)"),
    "round": ("round(a / 10)", "round(a / 10)"),
    "ceil": ("ceil(a / 10)", "ceil(a / 10)"),
    "floor": ("floor(a / 10)", "floor(a / 10)"),
    "sin": ("sin(b)", "sin(b)"),
    "cos": ("cos(b)", "cos(b)"),
    "tan": ("tan(b)", "tan(b)"),
    "log": ("log(b)", "ln(b)"),
    "log_edges": ("log(b - 1)", f"CASE WHEN b = 1 THEN -{_INF} ELSE ln(b - 1) END"),
    "log10": ("log10(a)", "log10(a)"),
    "exp": ("exp(b / 50)", "exp(b / 50)"),
}
_LOOSE = ("sin", "cos", "tan", "log", "log_edges", "log10", "exp", "sqrt", "pow")  # libraries may differ in the last bit
for _n, (_text, _expr) in _FORMULAS.items():
    _x = f"CASE WHEN isinf({_expr}) THEN {_expr} ELSE round({_expr}, 9) END" if _n in _LOOSE else f"CAST({_expr} AS DOUBLE)"
    query(f"formula_{_n}", f"SELECT key, {_x} AS result FROM (SELECT l_orderkey AS key, l_extendedprice AS a, l_quantity AS b FROM lineitem)")(
        lambda s, d, text=_text, loose=_n in _LOOSE: formula.compute(
            s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("a"), F.col("l_quantity").alias("b")), {"result": text}
        ).select("key", F.when(F.abs("result") == float("inf"), F.col("result")).otherwise(F.round("result", 9)).alias("result") if loose else F.col("result"))
    )


@query("formula_on_dataset", f"WITH {ACTIVITY}, {_LONG}, w AS (SELECT timestamp, max(CASE WHEN metric_key = 'value_sum' THEN value END) AS value_sum, max(CASE WHEN metric_key = 'click_count' THEN value END) AS click_count FROM long GROUP BY 1) SELECT timestamp, value_sum, click_count, value_sum / click_count AS per_click, value_sum * 2 AS twice FROM w WHERE value_sum * 2 > 10000")
def formula_on_dataset(s, d):
    w = shapes.dataset_wide(_long(s, d), ["value_sum", "click_count"])
    return filters.apply_filter(formula.compute(w, {"per_click": "value_sum / click_count", "twice": "value_sum * 2"}), {"twice": [{"operator": "GT", "value": 10000}]})


@query("formula_on_flat_groups", f"SELECT id, round(value * 0.75, 6) AS net FROM ({_flat_sql(PLACES, 'plc', ['region', 'nation', 'mktsegment'], 'totalprice')})")
def formula_on_flat_groups(s, d):
    t = formula.compute(shapes.flat_groups(tables.orders_by_place(s, d), _F3, "minute", SCALE), {"net": "totalprice * 0.75"})
    return t.select("id", F.round("net", 6).alias("net"))


# --- streams, counters, retention -------------------------------------------------------------

_NOW = "TIMESTAMP '2024-01-20 12:00:00'"


@query("realtime_admission", f"SELECT CAST(event_id AS VARCHAR) AS uuid FROM events WHERE ts >= {_NOW} - INTERVAL 300 SECOND")
def realtime_admission(s, d):
    return realtime.admitted(tables.activity(s, d), 300, F.expr("TIMESTAMP_NTZ '2024-01-20 12:00:00'")).select("uuid")


@query("every_tenth_trigger", "SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(count(*) / 10.0) AS BIGINT) AS triggers FROM events GROUP BY 1")
def every_tenth_trigger(s, d):
    return realtime.every_nth(tables.activity(s, d), realtime.owner_of("user"))


def _hits(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id")


for _n, _g, _quota in (("second", "second", 1), ("day", "day", 2), ("total", None, 50)):
    _w = f", {at('ts', _g)} AS \"window\"" if _g else ""
    query(f"rate_limit_{_n}", f"SELECT user_id AS key{_w}, least(count(*), {_quota}) AS accepted, count(*) - least(count(*), {_quota}) AS rejected FROM events GROUP BY ALL")(
        lambda s, d, g=_g, quota=_quota: realtime.window_counts(_hits(s, d), "user_id", "ts", quota, g)
    )


@query("rate_limit_hits", f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, {at('ts', 'day')} ORDER BY ts, event_id) > 2 AS rejected FROM events")
def rate_limit_hits(s, d):
    return realtime.over_quota(_hits(s, d), "user_id", "ts", 2, "day").select("user_id", "event_id", "rejected")


@query("rate_limit_hits_total", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hit FROM events")
def rate_limit_hits_total(s, d):
    return realtime.over_quota(_hits(s, d), "user_id", "ts", 50, None).select("user_id", "event_id", "hit")


@query("usage_snapshot", f"SELECT user_id AS key, CAST(sum(CASE WHEN date_trunc('second', ts) = {_NOW} THEN 1 ELSE 0 END) AS BIGINT) AS this_second, CAST(sum(CASE WHEN date_trunc('day', ts) = date_trunc('day', {_NOW}) THEN 1 ELSE 0 END) AS BIGINT) AS this_day, count(*) AS total FROM events WHERE ts <= {_NOW} GROUP BY 1")
def usage_snapshot(s, d):
    return realtime.usage(_hits(s, d), "user_id", "ts", F.expr("TIMESTAMP_NTZ '2024-01-20 12:00:00'"))


@query("report_metadata", "SELECT 'activity' AS source_id, 'event_type' AS kind, event_type AS name FROM events GROUP BY ALL UNION ALL SELECT 'activity', 'metric', event_type || '_count' FROM events GROUP BY ALL UNION ALL SELECT 'activity', 'metric', n FROM (VALUES ('value_sum'), ('k_sum')) v(n) UNION ALL SELECT 'activity', 'field', 'band'")
def report_metadata(s, d):
    return catalogue(tables.activity(s, d))


@query("cube_routing", "SELECT CAST(event_id AS VARCHAR) AS uuid FROM events WHERE event_type IN ('purchase', 'view')")
def cube_routing(s, d):
    return tables.activity(s, d).where(accepts(CubeDef("r", "c", sources=("activity",), events=("purchase", "view")))).select("uuid")


# --- the same through streams and the engine ---------------------------------------------------


def _work(s: SparkSession, name: str) -> str:
    """A new folder that the whole cluster shares."""
    return f"{(s.conf.get('spark.checkpoint.dir', None) or s.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/cubeline-{name}-{uuid.uuid4().hex}"


def _stream(s: SparkSession, d: str) -> DataFrame:
    """`events` as a stream of canonical events."""
    raw = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events*.parquet")
    return tables.activity_of(raw)


def _drained(stream: DataFrame, mode: str, work: str) -> DataFrame:
    """What a stream comes to once all there is has been read: the last batch of a complete one, all batches of another.

    A batch is a folder under its number, so one that is repeated replaces what it wrote.
    """

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{work}/out/batch={number if mode == 'append' else 0}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{work}/out").select(*stream.columns)


@query("stream_daily_sum", f"SELECT {at('ts', 'day')} AS timestamp, {exact('value')} AS value FROM events GROUP BY 1")
def stream_daily_sum(s, d):
    e = _stream(s, d)
    sums = e.groupBy(bucket(F.col("ts"), "day", e.schema["ts"].dataType).alias("timestamp")).agg(rollup.exact_sum(F.col("payload.value"), SCALE).alias("value"))
    return _drained(sums, "complete", _work(s, "sum"))


@query("stream_dedupe", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_dedupe(s, d):
    from cubeline.streaming.ingest import deduped

    e = _stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = e.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    return _drained(deduped(twice, "60 days").select("event_type"), "append", _work(s, "dedupe")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_every_tenth", "SELECT CAST(user_id AS VARCHAR) AS key, count(*) // 10 AS triggers FROM events GROUP BY 1 HAVING count(*) >= 10")
def stream_every_tenth(s, d):
    fired = realtime.every_nth_stream(_stream(s, d), realtime.owner_of("user"))
    return _drained(fired, "append", _work(s, "tenth")).groupBy("key").agg(F.count("*").alias("triggers"))


@query("stream_ingest_report", f"SELECT {at('ts', 'day')} AS timestamp, band AS category, {exact('value')} AS value FROM (SELECT *, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS band FROM events) GROUP BY ALL")
def stream_ingest_report(s, d):
    """A stream through the engine into a rollup, and a report from that."""
    from cubeline.model import EventSource, Report
    from cubeline.plans.engine import Engine
    from cubeline.streaming.ingest import ingest

    work = _work(s, "ingest")
    engine = Engine(s, work, scale=SCALE)
    engine.registry.create_source(EventSource("activity"))
    for kind in ("signup", "purchase", "view", "click", "error"):
        engine.registry.create_event_type("activity", kind)
    engine.registry.create_report(Report("r"))
    engine.registry.create_cube(CubeDef("r", "hourly", "hour", partitioned=True, partition_length=24))
    ingest(engine, "activity", _stream(s, d), f"{work}/checkpoint").awaitTermination()
    return engine.get_report("r", ReportQuery(EVERYTHING, "day", metric="SUM", field="value", group_by=("band",)))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """The all-metrics dataset by day, from raw events."""
    return _long(s, d)


from cubeline import engine_queries  # noqa: E402, F401  adds the queries that go through an engine
