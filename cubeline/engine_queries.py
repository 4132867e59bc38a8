"""Queries that go through a running engine: ingest, cells, buffer, cache, retention, plugins, subscriptions.

Each engine lives in a new folder that the whole cluster shares.  Those that several queries
read are made once for a session and a folder of tables.
"""

from __future__ import annotations

import datetime as dt
import http.server
import json
import threading
from collections.abc import Callable
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeline.functions import filters, formula
from cubeline.functions.granularity import period
from cubeline.model import Condition, CubeDef, DatasetQuery, EventSource, FlatGroupsQuery, GroupsQuery, Report, ReportQuery, Retention, Subscription
from cubeline.operators.fanout import metric_rows
from cubeline.operators.rollup import exact_sum
from cubeline.plans import registry as reg
from cubeline.plans.cache import ResultCache
from cubeline.plans.engine import Engine
from cubeline.plans.plugins import to_parquet
from cubeline.queries import _LONG, ACTIVITY, EVERYTHING, PLACES, SCALE, _stream, _work, at, exact, query
from cubeline.sources import events as ev
from cubeline.sources import tables
from cubeline.streaming import ingest, realtime

KINDS = ("signup", "purchase", "view", "click", "error")
NOW = dt.datetime(2024, 1, 20, 12)
#: The realtime buffer's age in these queries, and the first time it lets in.
AGE_S, EDGE = 5 * 86_400, "TIMESTAMP '2024-01-15 12:00:00'"

_READY: dict[tuple[str, str, str], Engine] = {}


def _once(s: SparkSession, d: str, name: str, make: Callable[[], Engine]) -> Engine:
    key = (s.sparkContext.applicationId, d, name)
    if key not in _READY:
        _READY[key] = make()
    return _READY[key]


def _engine(s: SparkSession, name: str, cubes: tuple[CubeDef, ...], *, source: EventSource | None = None, **kw) -> Engine:
    e = Engine(s, _work(s, name), scale=SCALE, **{"buffer_age_s": None, "clock": lambda: NOW} | kw)
    e.registry.create_source(source or EventSource("activity"))
    for k in KINDS:
        e.registry.create_event_type("activity", k)
    for c in cubes:
        e.registry.create_report(Report(c.report))
        e.registry.create_cube(c)
    return e


def _halves(s: SparkSession, d: str) -> list[DataFrame]:
    """Two batches: the events of even ids, then all of them, so that half come again."""
    e = tables.activity(s, d)
    return [e.where(F.col("uuid").cast("long") % 2 == 0), e]


DAILY, HOURLY = CubeDef("r", "daily", "day"), CubeDef("r", "hourly", "hour", partitioned=True, partition_length=24)
DAY_SUM = ReportQuery(EVERYTHING, "day", metric="SUM", field="value")


def _running(s: SparkSession, d: str) -> Engine:
    """Two reports, four cubes, two batches, a buffer of five days."""

    def make():
        views = CubeDef("two", "views", "day", events=("view",))
        e = _engine(s, "engine", (DAILY, HOURLY, views, CubeDef("two", "others", "day", events=tuple(k for k in KINDS if k != "view"))), buffer_age_s=AGE_S)
        for n, part in enumerate(_halves(s, d)):
            e.record("activity", part, n)
        return e

    return _once(s, d, "running", make)


def _rows(s: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    return reg.local(s, rows, **columns)


# --- cells ------------------------------------------------------------------------------------


@query("engine_report", f"WITH {ACTIVITY} SELECT {at('ts', 'day')} AS timestamp, band AS category, {exact('value')} AS value FROM act GROUP BY ALL")
def engine_report(s, d):
    """Of two cubes that fit, the coarser answers; events that came twice count once."""
    return _running(s, d).get_report("r", replace(DAY_SUM, group_by=("band",)))


@query("engine_report_hours", f"SELECT {at('ts', '6hour')} AS timestamp, CAST(count(*) AS DOUBLE) AS value FROM events WHERE {at('ts', 'hour')} BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 18:00:00' GROUP BY 1")
def engine_report_hours(s, d):
    return _running(s, d).get_report("r", ReportQuery((dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9, 18)), "6hour"))


@query("rollup_boolean", f"WITH {ACTIVITY} SELECT {at('ts', 'day')} AS timestamp, CAST(sum(CAST(big AS INT)) AS DOUBLE) AS value FROM act GROUP BY 1")
def rollup_boolean(s, d):
    """Boolean facts are read from the cells."""
    return _running(s, d).get_report("r", ReportQuery(EVERYTHING, "day", metric="BOOLEAN", field="big"))


@query("engine_dataset_two_cubes", f"WITH {ACTIVITY}, {_LONG} SELECT timestamp, metric_key, value FROM long")
def engine_dataset_two_cubes(s, d):
    """Cubes of different events, put together in one dataset."""
    wide = _running(s, d).get_dataset("two", DatasetQuery(EVERYTHING, "day"))
    keys = [c for c in wide.columns if c not in ("timestamp", "$boolean_groups")]
    return wide.unpivot(["timestamp"], [F.col(f"`{k}`") for k in keys], "metric_key", "value").where("value is not null")


_G = GroupsQuery(EVERYTHING, "day", metrics=("value", "click_count"), group_by=("band",), sort_by="timestamp")
_GROUP_SQL = f"{exact('value')} AS value_sum, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS click_count"


def _flat_groups(df: DataFrame) -> DataFrame:
    return df.select("timestamp", F.inline("group_by_band"))


@query("groups_sorted", f"WITH {ACTIVITY}, b AS (SELECT *, {at('ts', 'day')} AS timestamp FROM act) SELECT timestamp, band AS name, {_GROUP_SQL} FROM b WHERE timestamp IN (SELECT DISTINCT timestamp FROM b ORDER BY 1 DESC LIMIT 3) GROUP BY ALL")
def groups_sorted(s, d):
    """Groups by time, the latest first, the first three."""
    return _flat_groups(_running(s, d).get_groups("r", replace(_G, limit=3)))


@query("flat_groups_paths", f"WITH {PLACES} SELECT region, nation, mktsegment, {exact('totalprice')} AS value, CASE WHEN mktsegment IS NOT NULL THEN 'mktsegment' WHEN nation IS NOT NULL THEN 'nation' ELSE 'region' END AS group_by FROM plc GROUP BY GROUPING SETS ((region), (region, nation), (region, nation, mktsegment))")
def flat_groups_paths(s, d):
    """Every node carries the fields of its path."""
    from cubeline.operators import shapes

    q = FlatGroupsQuery(EVERYTHING, "minute", metrics=("totalprice",), group_by=("region", "nation", "mktsegment"))
    t = shapes.flat_groups(tables.orders_by_place(s, d), q, "minute", SCALE)
    return t.select("region", "nation", "mktsegment", F.col("totalprice").alias("value"), F.col("$group_by").alias("group_by"))


@query("engine_compute", f"SELECT {at('ts', 'day')} AS timestamp, round({exact('value')} / count(*), 6) AS mean FROM events GROUP BY 1")
def engine_compute(s, d):
    e = _running(s, d)
    both = e.get_report("r", DAY_SUM).join(e.get_report("r", ReportQuery(EVERYTHING, "day")).withColumnRenamed("value", "n"), "timestamp")
    return e.compute(both, {"mean": "value / n"}).select("timestamp", F.round("mean", 6).alias("mean"))


@query("engine_stats", "SELECT 'hourly' AS cube, count(DISTINCT date_trunc('day', ts)) AS n_partitions, CAST(2 AS BIGINT) AS n_batches FROM events UNION ALL SELECT unnest(['daily', 'views', 'others']), 1, 2")
def engine_stats(s, d):
    return _running(s, d).stats().select("cube", "n_partitions", "n_batches")


@query("engine_recent", "SELECT CAST(event_id AS VARCHAR) AS uuid FROM events ORDER BY ts DESC, uuid LIMIT 20")
def engine_recent(s, d):
    return _running(s, d).recent("activity").select("uuid")


@query("compacted_report", f"SELECT {at('ts', 'day')} AS timestamp, {exact('value')} AS value FROM events GROUP BY 1")
def compacted_report(s, d):
    """Five batches summed into one, then one of them and the last again."""
    e = _engine(s, "compact", (DAILY,))
    act = tables.activity(s, d)
    parts = [act.where(F.col("uuid").cast("long") % 5 == k) for k in range(5)]
    for n, part in enumerate(parts):
        e.record("activity", part, n)
    e.compact(DAILY)
    e.record("activity", parts[1], 1)
    e.record("activity", parts[4], 4)
    return e.get_report("r", DAY_SUM)


@query("reprocess_report", f"SELECT {at('ts', 'day')} AS timestamp, {exact('value')} AS value FROM events GROUP BY 1")
def reprocess_report(s, d):
    """Cells that were lost are built anew from raw events; a batch that comes again afterwards counts once."""
    e = _engine(s, "reprocess", (HOURLY,))
    halves = _halves(s, d)
    for n, part in enumerate(halves):
        e.record("activity", part, n)
    e.store.delete(f"{e.cube_path(HOURLY)}/batch=activity-0")
    e.reprocess(HOURLY, *EVERYTHING)
    e.record("activity", halves[1], 1)
    return e.get_report("r", DAY_SUM)


# --- what came in lately -------------------------------------------------------------------------


@query("realtime_buffer", f"SELECT g AS granularity, t AS aggregation_type, CAST(2 * count(*) * n AS BIGINT) AS n_rows FROM events, (VALUES ('COUNT', 1), ('SUM', 2), ('CATEGORY', 2), ('BOOLEAN', 1), ('COMPOUND_SUM', 4), ('LEAF_SUM', 2)) v(t, n), (VALUES ('hour'), ('day')) w(g) WHERE ts >= {EDGE} GROUP BY g, t, n")
def realtime_buffer(s, d):
    """Metric rows of events young enough, for each cube of the report, in the stored buffer."""
    return _running(s, d).buffered("r").groupBy("granularity", "aggregation_type").agg(F.count("*").alias("n_rows"))


@query("realtime_report", f"WITH {ACTIVITY} SELECT {at('ts', 'day')} AS timestamp, band AS category, {exact('value')} AS value FROM act WHERE ts >= {EDGE} GROUP BY ALL")
def realtime_report(s, d):
    return _running(s, d).realtime_report("r", replace(DAY_SUM, group_by=("band",)))


@query("realtime_dataset", f"WITH {ACTIVITY.replace('FROM events', f'FROM events WHERE ts >= {EDGE}')}, {_LONG} SELECT timestamp, metric_key, value FROM long")
def realtime_dataset(s, d):
    wide = _running(s, d).realtime_dataset("r", DatasetQuery(EVERYTHING, "day"))
    keys = [c for c in wide.columns if c not in ("timestamp", "$boolean_groups")]
    return wide.unpivot(["timestamp"], [F.col(f"`{k}`") for k in keys], "metric_key", "value").where("value is not null")


@query("realtime_boolean_groups", f"WITH {ACTIVITY} SELECT {at('ts', 'day')} AS timestamp, 'big' AS name, big AS value, ts AS at FROM act WHERE ts >= {EDGE}")
def realtime_boolean_groups(s, d):
    wide = _running(s, d).realtime_dataset("r", DatasetQuery(EVERYTHING, "day"))
    return wide.select("timestamp", F.inline("$boolean_groups").alias("name", "value", "at"))


@query("realtime_groups", f"WITH {ACTIVITY}, b AS (SELECT *, {at('ts', 'day')} AS timestamp FROM act WHERE ts >= {EDGE}) SELECT timestamp, band AS name, {_GROUP_SQL}, CAST(0 AS DOUBLE) AS none_count FROM b GROUP BY ALL")
def realtime_groups(s, d):
    """Metrics that a group lacks are 0."""
    return _flat_groups(_running(s, d).realtime_groups("r", replace(_G, metrics=("value", "click_count", "none_count"))))


@query("realtime_flat_groups", f"WITH {ACTIVITY} SELECT band, CAST(big AS VARCHAR) AS big, {exact('value')} AS value, max({at('ts', 'hour')}) AS timestamp FROM act WHERE ts >= {EDGE} GROUP BY GROUPING SETS ((band), (band, big))")
def realtime_flat_groups(s, d):
    q = FlatGroupsQuery(EVERYTHING, "hour", metrics=("value",), group_by=("band", "big"))
    return _running(s, d).realtime_flat_groups("r", q).select("band", "big", "value", "timestamp")


@query("change_notifications", f"SELECT 'aggregation:written' AS type, CAST(2 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS changes UNION ALL SELECT 'realtime:metrics', 2, CAST(24 * count(*) AS BIGINT) FROM events WHERE ts >= {EDGE}")
def change_notifications(s, d):
    """What listeners of a report's channel are told while two batches come in: 24 metric rows an event."""
    e = _engine(s, "told", (DAILY,), buffer_age_s=AGE_S)
    told: list[dict] = []
    e.broadcast.listen("report:updates:r", told.append)
    e.broadcast.listen("report:updates:r", lambda m: 1 / 0)  # one that fails is dropped
    for n, part in enumerate(_halves(s, d)):
        e.record("activity", part, n)
    kinds = sorted({m["type"] for m in told})
    rows = [(k, sum(m["type"] == k for m in told), sum(m["changes"] for m in told if m["type"] == k) if k == "realtime:metrics" else None) for k in kinds]
    return _rows(s, rows, type=pa.string(), n=pa.int64(), changes=pa.int64())


# --- subscriptions ---------------------------------------------------------------------------------

_FIRED = f"WITH {ACTIVITY}, {_LONG}, w AS (SELECT timestamp, max(CASE WHEN metric_key = 'value_sum' THEN value END) AS value_sum FROM long GROUP BY 1)"


def _fired(s: SparkSession, d: str, *subscriptions: Subscription, send: Callable[[dict], None] = lambda m: None, again: int = 1) -> list[dict]:
    e = _running(s, d)
    report = "alerts-" + "-".join(x.name for x in subscriptions)
    e.registry.create_report(Report(report, active=False))
    e.registry.create_cube(replace(DAILY, report=report, name=report))
    e.store.delete(f"{e.root}/_facts/fired/{report}")
    for x in subscriptions:
        e.registry.subscribe(report, x)
    watched, e._watched = e._watched, lambda _, x, since, now: watched("r", x, since, now)  # the cells of report r
    try:
        return [m for _ in range(again) for m in e.notify(report, send, *EVERYTHING)]
    finally:
        e._watched = watched
        e.registry.delete_report(report)


@query("threshold_alert", f"{_FIRED} SELECT 'high' AS subscription, timestamp, value_sum AS value FROM w WHERE timestamp = (SELECT max(timestamp) FROM w)")
def threshold_alert(s, d):
    """The latest point alone is judged, all conditions must hold, and a window fires once however often it is looked at."""
    high = Subscription("high", "threshold", "day", (Condition("value_sum", "GT", 1), Condition("view_count", "GTE", 0)))
    low = Subscription("low", "threshold", "day", (Condition("value_sum", "LT", 1),))
    fired = _fired(s, d, high, low, again=2)
    return _rows(s, [(m["subscription"], m["timestamp"], m["value_sum"]) for m in fired], subscription=pa.string(), timestamp=pa.timestamp("us"), value=pa.float64())


@query("batch_completed", f"SELECT DISTINCT 'done' AS subscription, {at('ts', 'day')} AS timestamp FROM events")
def batch_completed(s, d):
    """Every bucket is told once."""
    fired = _fired(s, d, Subscription("done", "completed", "day"), again=2)
    return _rows(s, [(m["subscription"], m["timestamp"]) for m in fired], subscription=pa.string(), timestamp=pa.timestamp("us"))


@query("webhook_alerts", f"{_FIRED} SELECT 'hook' AS subscription, strftime(max(timestamp), '%Y-%m-%dT%H:%M:%S') AS timestamp FROM w")
def webhook_alerts(s, d):
    """What a listener on a socket of the driver gets posted."""
    got: list[dict] = []

    class Listener(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Listener)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        _fired(s, d, Subscription("hook", "threshold", "day", (Condition("value_sum", "GT", 1),)), send=realtime.webhook(f"http://127.0.0.1:{server.server_port}/"))
    finally:
        server.shutdown()
        server.server_close()
    return _rows(s, [(m["subscription"], m["timestamp"]) for m in got], subscription=pa.string(), timestamp=pa.string())


# --- retention ---------------------------------------------------------------------------------------


def _retained(s: SparkSession, d: str) -> Engine:
    """Events kept 7 days, cells 5, in partitions of a day that are archived; afterwards a batch comes again."""

    def make():
        cube = CubeDef("r", "kept", "hour", partitioned=True, partition_length=24, retention=Retention(5, "archive"))
        e = _engine(s, "retention", (cube,), source=EventSource("activity", retention=Retention(7)))
        e.offloaders.register("archive", to_parquet(f"{e.root}/archive"))
        halves = _halves(s, d)
        for n, part in enumerate(halves):
            e.record("activity", part, n)
        e.apply_retention(NOW)
        return e

    return _once(s, d, "retained", make)


_DAYS = "CAST(floor(epoch_ms(ts) / 86400000.0) AS BIGINT)"
_FIRST = "CAST(floor(epoch_ms(TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 5 DAY) / 86400000.0) AS BIGINT)"


@query("retention_partitions", f"SELECT {at('ts', 'day')} AS timestamp, CAST(count(*) AS DOUBLE) AS value FROM events WHERE {_DAYS} >= {_FIRST} GROUP BY 1")
def retention_partitions(s, d):
    """What a report shows once old partitions are dropped."""
    return _retained(s, d).get_report("r", ReportQuery(EVERYTHING, "day"))


@query("retention_archive", f"SELECT {_DAYS} AS partition_idx, CAST(count(*) AS DOUBLE) AS value FROM events WHERE {_DAYS} < {_FIRST} GROUP BY 1")
def retention_archive(s, d):
    """What the offloader was given."""
    e = _retained(s, d)
    cells = s.read.parquet(f"{e.root}/archive/kept").where("aggregation_type = 'COUNT' and attribution_type = '_total'")
    return cells.groupBy(F.col("partition_idx").cast("long").alias("partition_idx")).agg(F.sum("value").alias("value"))


@query("retention_events", "SELECT CAST(event_id AS VARCHAR) AS uuid FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY")
def retention_events(s, d):
    return _retained(s, d).events().select("uuid")


@query("retention_replay", f"SELECT {at('ts', 'day')} AS timestamp, {exact('value')} AS value FROM events GROUP BY 1")
def retention_replay(s, d):
    """Batches that come again after raw events were dropped change no cell."""
    e = _engine(s, "replay", (DAILY,), source=EventSource("activity", retention=Retention(7)))
    halves = _halves(s, d)
    for n, part in enumerate(halves):
        e.record("activity", part, n)
    e.apply_retention(NOW)
    e.record("activity", halves[0], 0)
    return e.get_report("r", DAY_SUM)


# --- result cache --------------------------------------------------------------------------------------

_MODES = f"""WITH e AS (SELECT {at('ts', 'day')} AS timestamp, value, event_id % 2 = 0 AS early FROM events)
SELECT mode, timestamp, {exact('value')} AS value FROM e, (VALUES ('kept'), ('rebuilt'), ('controlled'), ('asked'), ('expired'), ('chunks')) m(mode)
WHERE CASE mode WHEN 'kept' THEN early WHEN 'asked' THEN early WHEN 'chunks' THEN early OR NOT (timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05' OR timestamp BETWEEN TIMESTAMP '2024-01-09' AND TIMESTAMP '2024-01-11') ELSE TRUE END
GROUP BY ALL"""


@query("cache_modes", _MODES)
def cache_modes(s, d):
    """A report asked for before and after a second batch: kept results and chunks show the first state, all others the second."""
    e = _engine(s, "cache", (HOURLY,))
    now = [0.0]
    clock = lambda: now[0]
    make = lambda name, **kw: ResultCache(s, f"{e.root}/results/{name}", clock=clock, **kw)
    ask = replace(DAY_SUM, sources=("activity",))
    some = lambda a, b: replace(ask, time_range=(dt.datetime(2024, 1, a), dt.datetime(2024, 1, b, 23)))
    # name -> (cache, in parts, what is asked for before, and after)
    plans = {
        "kept": (make("kept"), False, [ask], ask), "rebuilt": (make("rebuilt"), False, [ask], replace(ask, rebuild_cache=True)),
        "controlled": (make("controlled", controlled=True), False, [ask], ask), "asked": (make("asked", controlled=True), False, [replace(ask, cache=True)], replace(ask, cache=True)),
        "expired": (make("expired", ttl_s=60), False, [ask], ask), "chunks": (make("chunks"), True, [some(3, 5), some(9, 11)], ask),
    }
    halves = _halves(s, d)
    e.record("activity", halves[0], 0)
    for cache, parts, before, _ in plans.values():
        e.cache, e.partial_cache = cache, parts
        for q in before:
            e.get_report("r", q).write.format("noop").mode("overwrite").save()
    e.record("activity", halves[1], 1)
    now[0], out = 100.0, None
    for name, (cache, parts, _, after) in plans.items():
        e.cache, e.partial_cache = cache, parts
        df = e.get_report("r", after).select(F.lit(name).alias("mode"), "timestamp", "value")
        out = df if out is None else out.unionByName(df)
    return out


@query("cache_partial_merge", f"SELECT {at('ts', 'day')} AS timestamp, metric_key, {exact('value')} AS value FROM (SELECT ts, 'value_sum' AS metric_key, value FROM events UNION ALL SELECT ts, event_type || '_count', 1 FROM events) WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-21' AND metric_key IN ('value_sum', 'view_count') GROUP BY ALL")
def cache_partial_merge(s, d):
    """A dataset put together from two chunks that a cache holds and the gaps between them."""
    e = _running(s, d)
    held = (e.cache, e.partial_cache)
    e.cache, e.partial_cache = ResultCache(s, _work(s, "chunks")), True
    try:
        for a, b in ((1, 5), (9, 12), (3, 20)):
            wide = e.get_dataset("r", DatasetQuery((dt.datetime(2024, 1, a), dt.datetime(2024, 1, b, 23)), "day", metrics=("value",)))
    finally:
        e.cache, e.partial_cache = held
    return wide.unpivot(["timestamp"], ["value_sum", "view_count"], "metric_key", "value").where("value is not null")


# --- definitions -----------------------------------------------------------------------------------------


def _places(s: SparkSession, d: str) -> Engine:
    """A source for each nation, owned by its region; a report for each region, with a cube a nation.  Read anew from its folder."""

    def make():
        n = s.read.parquet(f"{d}/nation.parquet").join(s.read.parquet(f"{d}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = sorted((r.n_name, r.r_name) for r in n.select("n_name", "r_name").collect())  # 25 nations
        e = Engine(s, _work(s, "places"), buffer_age_s=None)
        for nation, region in rows:
            e.registry.create_source(EventSource(nation, owners=("nobody",)))
            e.registry.update_source(nation, owners=(region, "world"))
            e.registry.create_report(Report(region, owners=(region,)))
            e.registry.create_cube(CubeDef(region, f"of_{nation}", "day", sources=(nation,)))
        e.registry.update_report("EUROPE", active=False)
        e.delete_report("AFRICA")
        e.delete_source("NATION_7")
        return Engine(s, e.root, buffer_age_s=None)

    return _once(s, d, "places", make)


_NR = "FROM nation JOIN region ON n_regionkey = r_regionkey"


@query("registry_restart", f"SELECT n_name AS source_id, r_name || ',world' AS owners {_NR} WHERE n_name <> 'NATION_7'")
def registry_restart(s, d):
    """Sources after changes, a deletion and a restart."""
    return _places(s, d).registry.sources_table(s).select("source_id", F.array_join("owners", ",").alias("owners"))


@query("registry_owned", f"SELECT n_name AS source_id {_NR} WHERE r_name = 'ASIA' AND n_name <> 'NATION_7'")
def registry_owned(s, d):
    return reg.owned(_places(s, d).registry.sources_table(s), "ASIA").select("source_id")


@query("registry_cubes", f"SELECT r_name AS report, 'of_' || n_name AS cube, 'day' AS granularity {_NR} WHERE r_name <> 'AFRICA'")
def registry_cubes(s, d):
    """Each report's cubes; a report's deletion took its own along."""
    r = _places(s, d).registry
    return reg.report_cubes(r.reports_table(s), r.cubes_table(s))


@query("registry_active", f"SELECT r_name AS report, 'of_' || n_name AS cube, 'day' AS granularity {_NR} WHERE r_name NOT IN ('AFRICA', 'EUROPE')")
def registry_active(s, d):
    r = _places(s, d).registry
    return reg.report_cubes(r.reports_table(s), r.cubes_table(s), only_active=True)


@query("events_with_types", "SELECT CAST(event_id AS VARCHAR) AS uuid, event_type FROM events WHERE event_type IN ('view', 'click', 'signup')")
def events_with_types(s, d):
    """Events that name their type by id; those of unknown types have no name and go."""
    e = tables.activity(s, d).withColumn("event_type_id", F.md5("event_type")).drop("event_type")
    types = _rows(s, [("activity", t) for t in ("view", "click", "signup")], source_id=pa.string(), event_type=pa.string()).withColumn("event_type_id", F.md5("event_type"))
    return ev.with_type_names(e, types).select("uuid", "event_type")


@query("events_with_sources", "SELECT 'Activity log' AS name, count(*) AS n FROM events")
def events_with_sources(s, d):
    """Events of registered sources; those of others go."""
    a = tables.activity(s, d).select("uuid", "source_id")
    sources = _rows(s, [("activity", "Activity log"), ("idle", "Idle")], source_id=pa.string(), name=pa.string())
    return ev.of_sources(a.unionByName(a.withColumn("source_id", F.lit("unknown"))), sources).groupBy("name").agg(F.count("*").alias("n"))


def _two_sources(s: SparkSession, d: str) -> Engine:
    def make():
        e = _engine(s, "sources", ())
        e.registry.create_source(EventSource("sales"))
        e.registry.create_event_type("sales", "order_placed")
        e.registry.create_report(Report("both", active=False))
        e.registry.create_cube(CubeDef("both", "both", "day", sources=("activity", "sales")))
        e.registry.create_report(Report("one", active=False))
        e.registry.create_cube(CubeDef("one", "one", "day", sources=("sales",)))
        e.record("activity", tables.activity(s, d), 0)
        e.record("sales", tables.order_placed(s, d), 0)
        return e

    return _once(s, d, "sources", make)


@query("report_metadata_union", """WITH n AS (SELECT DISTINCT event_type FROM events UNION SELECT 'order_placed'), m AS (
  SELECT 'event_type' AS kind, event_type AS name FROM n UNION ALL SELECT 'metric', event_type || '_count' FROM n UNION ALL SELECT 'metric', unnest(['value_sum', 'k_sum', 'totalprice_sum'])
  UNION ALL SELECT 'field', unnest(['band', 'orderstatus', 'orderpriority']) UNION ALL SELECT 'source', unnest(['activity', 'sales']))
  SELECT kind, string_agg(name, ',' ORDER BY name) AS names FROM m GROUP BY 1""")  # fmt: skip
def report_metadata_union(s, d):
    """What a report over two sources can show: the union of their catalogues."""
    return _two_sources(s, d).metadata("both").select("kind", F.array_join("names", ",").alias("names"))


@query("source_counts", "SELECT 'activity' AS source_id, count(*) AS n_events FROM events UNION ALL SELECT 'sales', count(*) FROM orders")
def source_counts(s, d):
    return _two_sources(s, d).counts()


@query("cascade_delete", "SELECT 'activity' AS source_id, count(*) AS n_events FROM events")
def cascade_delete(s, d):
    """A source's deletion takes its types and its events along."""
    e = _engine(s, "cascade", ())
    e.registry.create_source(EventSource("copy"))
    for k in KINDS:
        e.registry.create_event_type("copy", k)
    for source in ("activity", "copy"):
        e.record(source, tables.activity(s, d), 0)
    e.delete_source("copy")
    return e.counts()


# --- plugins -----------------------------------------------------------------------------------------------


class _Everything:
    """A plugin with every hook; `calls` counts them."""

    def __init__(self):
        self.calls: dict[str, int] = {}

    def _hit(self, name: str) -> None:
        self.calls[name] = self.calls.get(name, 0) + 1

    def on_engine_init(self, engine):
        self._hit("on_engine_init")

    def on_engine_shutdown(self, engine):
        self._hit("on_engine_shutdown")

    def register_engine_methods(self, engine):
        return {"greet": lambda: self._hit("greet"), "record": None}

    def before_event_record(self, df, source):
        self._hit("before_event_record")
        p = F.col("payload")
        return df.withColumn("payload", F.struct((p["value"] * 2).alias("value"), p["k"].alias("k"), p["band"].alias("band"), p["big"].alias("big")))

    def after_event_record(self, df, source):
        self._hit("after_event_record")

    def on_get_metrics(self, events):
        return metric_rows(events, "day", kinds=("COUNT",), attributions=False).withColumn("event_type", F.lit("extra"))

    def before_metrics_written(self, cells, cube):
        self._hit("before_metrics_written")

    def after_metrics_written(self, cube, batch):
        self._hit("after_metrics_written")

    def after_aggregation_written(self, cube, batch):
        self._hit("after_aggregation_written")

    def after_realtime_metrics_generated(self, report, rows):
        self._hit("after_realtime_metrics_generated")

    def before_aggregate_generated(self, q, report):
        self._hit("before_aggregate_generated")
        return replace(q, granularity="day") if q.granularity == "hour" else q

    def after_aggregate_generated(self, df, q):
        self._hit("after_aggregate_generated")
        return df.withColumn("mark", F.lit("seen"))


def _plugged(s: SparkSession, d: str) -> Engine:
    def make():
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # a method that exists already
            e = _engine(s, "plugins", (DAILY,), plugins=(_Everything(),), buffer_age_s=AGE_S)
        for n, part in enumerate(_halves(s, d)):
            e.record("activity", part, n)
        return e

    return _once(s, d, "plugged", make)


@query("plugin_waterfalls", f"SELECT {at('ts', 'day')} AS timestamp, {exact('value * 2')} AS value, 'seen' AS mark FROM events GROUP BY 1")
def plugin_waterfalls(s, d):
    """A plugin changes events as they come in, a query (hours to days) and its result."""
    return _plugged(s, d).get_report("r", replace(DAY_SUM, granularity="hour"))


@query("plugin_metrics", f"SELECT 'cells' AS way, {at('ts', 'day')} AS timestamp, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL UNION ALL SELECT 'buffer', {at('ts', 'day')}, count(*) FROM events WHERE ts >= {EDGE} GROUP BY ALL UNION ALL SELECT 'anew', {at('ts', 'day')}, count(*) FROM events GROUP BY ALL")
def plugin_metrics(s, d):
    """Metric rows that a plugin adds: in cells, in the buffer, and in cells built anew."""
    e, q = _plugged(s, d), ReportQuery(EVERYTHING, "day", events=("extra",))
    cells = s.createDataFrame(e.get_report("r", q).collect(), "timestamp timestamp, value double, mark string")
    buffer = s.createDataFrame(e.realtime_report("r", q).collect(), "timestamp timestamp, value double, mark string")
    e.reprocess(DAILY, *EVERYTHING)
    anew = e.get_report("r", q)
    return cells.withColumn("way", F.lit("cells")).unionByName(buffer.withColumn("way", F.lit("buffer"))).unionByName(anew.withColumn("way", F.lit("anew"))).select("way", "timestamp", "value")


@query("plugin_hooks", "SELECT unnest(['on_engine_init', 'on_engine_shutdown', 'greet', 'before_event_record', 'after_event_record', 'before_metrics_written', 'after_metrics_written', 'after_aggregation_written', 'after_realtime_metrics_generated', 'before_aggregate_generated', 'after_aggregate_generated']) AS hook")
def plugin_hooks(s, d):
    """Every hook is called; a method that exists already is not replaced."""
    e = _plugged(s, d)
    e.greet()
    e.get_report("r", DAY_SUM)
    e.shutdown()
    return _rows(s, [(h,) for h in sorted(e.plugins.plugins[0].calls)], hook=pa.string())


@query("plugin_redirect", f"SELECT {at('ts', 'day')} AS timestamp, {exact('value')} AS value FROM events GROUP BY 1")
def plugin_redirect(s, d):
    """A plugin sends a cube's cells to another one."""
    other = CubeDef("s", "elsewhere", "day")

    class Redirect:
        def before_metrics_written(self, cells, cube):
            return cells, other

    e = _engine(s, "redirect", (DAILY,), plugins=(Redirect(),))
    e.registry.create_report(Report("s", active=False))
    e.registry.create_cube(other)
    for n, part in enumerate(_halves(s, d)):
        e.record("activity", part, n)
    return e.get_report("s", DAY_SUM)


# --- ingest ---------------------------------------------------------------------------------------------------


@query("json_ingest", f"WITH e AS (SELECT {at('ts', 'day')} AS ts, event_type, value FROM events) SELECT ts AS timestamp, event_type, CAST(count(*) AS DOUBLE) AS n, {exact('value')} AS value FROM e GROUP BY ALL")
def json_ingest(s, d):
    """Events as JSON lines, read with uuids checked and payloads of any kind, fanned out."""
    raw = s.read.parquet(f"{d}/events.parquet")
    h = F.md5(F.col("event_id").cast("string"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    lines = raw.select(F.to_json(F.struct(
        F.concat_ws("-", *parts).alias("uuid"), F.col("event_type").alias("eventType"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.to_json(F.struct(F.col("value"), F.lit("x").alias("kind"))).alias("payload"),
        F.array(F.struct(F.lit("user").alias("type"), F.col("user_id").cast("string").alias("value"))).alias("attributions"),
    )).alias("value"))
    path = _work(s, "json")
    lines.write.text(path)
    e = ev.read_json(s, path, "web")
    rows = metric_rows(e, "day", kinds=("COUNT", "SUM"), attributions=False)
    n = F.sum(F.when(F.col("aggregation_type") == "COUNT", F.col("value")))
    return rows.groupBy(F.col("ts").alias("timestamp"), "event_type").agg(n.alias("n"), exact_sum(F.when(F.col("aggregation_type") == "SUM", F.col("value")), SCALE).alias("value"))


@query("retry_delays", "SELECT CAST(k AS BIGINT) AS attempt, 0.25 * pow(2, k - 2) AS delay_s FROM range(2, 16) t(k)")
def retry_delays(s, d):
    """The waits before the 2nd to the 15th attempt."""
    waited: list[float] = []
    ingest.retrying(lambda: 1 / 0, sleep=waited.append)
    return _rows(s, list(enumerate(waited, 2)), attempt=pa.int64(), delay_s=pa.float64())


@query("dead_letters", "SELECT 'type' AS why, event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY 2 UNION ALL SELECT 'failed', event_type, count(*) FROM events GROUP BY 2")
def dead_letters(s, d):
    """Events of unknown types, and a batch that keeps failing, are put aside."""
    e = _engine(s, "quarantine", (DAILY,))
    e.registry.types["activity"] -= {"error", "view"}
    e.record = lambda *a: (_ for _ in ()).throw(RuntimeError("down"))
    ingest.ingest(e, "activity", _stream(s, d), f"{e.root}/checkpoint", quarantine=f"{e.root}/aside", attempts=2, sleep=lambda x: None).awaitTermination()
    typed = s.read.parquet(f"{e.root}/aside/types").select(F.lit("type").alias("why"), "event_type")
    failed = s.read.parquet(f"{e.root}/aside/failed").select(F.lit("failed").alias("why"), "event_type")
    return typed.unionByName(failed).groupBy("why", "event_type").agg(F.count("*").alias("n"))


@query("stream_recovery", f"SELECT {at('ts', 'day')} AS timestamp, {exact('value')} AS value FROM events GROUP BY 1")
def stream_recovery(s, d):
    """A stream that dies after its batch was written takes it up again, and counts it once."""
    e = _engine(s, "recovery", (DAILY,))

    def die(df, n):
        raise RuntimeError("died")

    first = ingest.ingest(e, "activity", _stream(s, d), f"{e.root}/checkpoint", attempts=1, on_batch=die)
    try:
        first.awaitTermination()
        raise AssertionError("the stream should have died")
    except AssertionError:
        raise
    except Exception:  # noqa: BLE001  what it died of comes wrapped
        pass
    ingest.ingest(e, "activity", _stream(s, d), f"{e.root}/checkpoint").awaitTermination()
    return e.get_report("r", DAY_SUM)


@query("stream_closed_windows", f"WITH w AS (SELECT {at('ts', 'day')} AS timestamp, count(*) AS n FROM events GROUP BY 1) SELECT timestamp, CAST(n AS DOUBLE) AS value FROM w WHERE timestamp + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 5 MINUTE FROM events)")
def stream_closed_windows(s, d):
    """Running cells leave the state, and come out, once the watermark has passed their bucket."""
    stream = _stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    work = _work(s, "closed")
    cells = realtime.running_cells(stream, "day").where("aggregation_type = 'COUNT' and attribution_type = '_total'")
    q = cells.select("window.start", "value").writeStream.outputMode("append").format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema("start timestamp, value double").parquet(f"{work}/out").groupBy(F.col("start").alias("timestamp")).agg(F.sum("value").alias("value"))


# --- usage ----------------------------------------------------------------------------------------------------


def _requests(s: SparkSession, d: str) -> DataFrame:
    """`events` as requests of users to an API: one over a user's two a day is refused, errors fail."""
    hits = realtime.over_quota(s.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", 2, "day")
    code = F.when(F.col("rejected"), 429).when(F.col("event_type") == "error", 500).otherwise(200)
    return realtime.usage_events(hits, "user_id", "ts", code, F.concat(F.lit("/api/"), F.col("event_type")), F.lit("GET"))


_HITS = f"hit AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, {at('ts', 'day')} ORDER BY ts, event_id, event_type) > 2 THEN 'limited' WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status FROM events)"


@query("usage_by_status", f"WITH {_HITS} SELECT {at('ts', 'day')} AS timestamp, status AS category, CAST(count(*) AS DOUBLE) AS value FROM hit WHERE user_id = 7 GROUP BY ALL")
def usage_by_status(s, d):
    """A user's requests by day and status, from the events that requests make."""
    from cubeline.operators import shapes

    return shapes.report(_requests(s, d), ReportQuery(EVERYTHING, "day", metric="CATEGORY", field="status", attribution=("owner", "7")), "second", SCALE)


@query("usage_dataset", f"WITH {_HITS} SELECT {at('ts', '7day')} AS timestamp, 'status_by_' || status AS metric_key, CAST(count(*) AS DOUBLE) AS value FROM hit GROUP BY ALL UNION ALL SELECT {at('ts', '7day')}, 'api_request_count', count(*) FROM hit GROUP BY ALL")
def usage_dataset(s, d):
    from cubeline.operators import shapes

    return shapes.dataset(_requests(s, d), DatasetQuery(EVERYTHING, "7day", metrics=("status",)), "minute", SCALE)


# --- small languages ---------------------------------------------------------------------------------------------


@query("language_errors", """SELECT * FROM (VALUES ('filter operator', 'ValueError'), ('formula function', 'FormulaError'), ('formula arguments', 'FormulaError'), ('formula name', 'FormulaError'), ('formula syntax', 'FormulaError'),
  ('granularity', 'ValueError'), ('metric', 'ValueError'), ('period', 'ValueError'), ('range', 'ValueError')) t("case", error)""")  # fmt: skip
def language_errors(s, d):
    """What is refused, and how."""
    o = s.read.parquet(f"{d}/orders.parquet")
    cases = {
        "filter operator": lambda: filters.apply_filter(o, {"o_totalprice": [{"operator": "LIKE", "value": 1}]}),
        "formula function": lambda: formula.compute(o, {"x": "sinh(o_totalprice)"}), "formula arguments": lambda: formula.compute(o, {"x": "pow(o_totalprice)"}),
        "formula name": lambda: formula.compute(o, {"x": "nothing + 1"}), "formula syntax": lambda: formula.compute(o, {"x": "(1 + "}),
        "granularity": lambda: ReportQuery(EVERYTHING, "fortnight"), "metric": lambda: ReportQuery(EVERYTHING, metric="MEDIAN"), "period": lambda: period("3y", NOW),
        "range": lambda: ReportQuery(EVERYTHING[::-1]),
    }
    rows = []
    for name, f in cases.items():
        try:
            f()
        except Exception as e:  # noqa: BLE001
            rows.append((name, type(e).__name__))
    return _rows(s, rows, **{"case": pa.string(), "error": pa.string()})


@query("formula_execute", "SELECT * FROM (VALUES ('a + b * 2', 11.0), ('a / 0', 0.0), ('log(0)', 0.0), ('sqrt(0 - 1)', 0.0), ('missing + 1', 0.0), ('max(a, b) - min(a, b)', 1.0), ('pow(10, 400)', 0.0), ('round(0 - 2.5)', -3.0)) t(formula, result)")
def formula_execute(s, d):
    """One formula over one set of numbers: unknown names and results that aren't finite give 0."""
    texts = ["a + b * 2", "a / 0", "log(0)", "sqrt(0 - 1)", "missing + 1", "max(a, b) - min(a, b)", "pow(10, 400)", "round(0 - 2.5)"]
    return _rows(s, [(t, float(formula.execute(t, {"a": 3.0, "b": 4.0}))) for t in texts], formula=pa.string(), result=pa.float64())


@query("relative_periods", "SELECT p AS period, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL (h) HOUR AND ts <= TIMESTAMP '2024-01-20 12:00:00') AS n FROM events, (VALUES ('6h', 6), ('3d', 72), ('1w', 168), ('1m', 720)) v(p, h) GROUP BY 1 UNION ALL SELECT 'custom:2024-01-02T00:00:00Z_2024-01-04T00:00:00Z', count(*) FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-04'")
def relative_periods(s, d):
    """Events within periods back from a time."""
    e, out = tables.activity(s, d), None
    for p in ("6h", "3d", "1w", "1m", "custom:2024-01-02T00:00:00Z_2024-01-04T00:00:00Z"):
        a, b = period(p, NOW)
        one = e.where(F.col("ts").between(F.lit(a), F.lit(b))).agg(F.lit(p).alias("period"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
