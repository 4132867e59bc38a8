import datetime as dt
import warnings

import pytest
from helpers import engine, events, t
from pyspark.sql import functions as F

from cubeline.model import CubeDef, DatasetQuery, EventSource, FlatGroupsQuery, GroupsQuery, Report, ReportQuery, Retention
from cubeline.operators import rollup
from cubeline.plans.plugins import to_parquet
from cubeline.sources import events as ev

DAY = (t("2024-01-01T00:00:00"), t("2024-01-01T23:59:00"))


def some(spark, rows, first=0):
    e = events(spark, "value:double,category:string", rows)
    return e.withColumn("uuid", F.concat(F.lit(f"{first}-"), "uuid"))


def total(df):
    return sum(r.value for r in df.collect())


def test_ingest(spark, tmp_path):
    e = engine(spark, tmp_path)
    assert e.registry.create_source(EventSource("src")) is e.registry.sources["src"]
    q = ReportQuery(DAY, "day", metric="SUM", field="value")
    rows = some(spark, [(t("2024-01-01T10:00:00"), (60.0, "A")), (t("2024-01-01T10:00:05"), (40.0, "B"))])
    assert e.record("src", rows, 0).count() == 2
    assert total(e.get_report("r", q)) == 100
    again = rows.unionByName(some(spark, [(t("2024-01-01T10:00:00"), (-30.0, "A"))], 1))  # a late correction among known events
    assert e.record("src", again, 1).count() == 1
    assert total(e.get_report("r", q)) == 70 and total(e.get_report("r", ReportQuery(DAY, "day"))) == 3
    assert e.record("src", again, 1).count() == 1 and total(e.get_report("r", q)) == 70  # a batch that is repeated
    with pytest.raises(ValueError, match="is not defined"):
        e.record("src", rows.withColumn("event_type", F.lit("other")), 2)
    with pytest.raises(KeyError):
        e.record("gone", rows, 2)
    assert [r.ts for r in e.recent("src", 1).collect()] == [t("2024-01-01T10:00:05")]
    e.registry.create_source(EventSource("idle"))
    assert {r.source_id: r.n_events for r in e.counts().collect()} == {"src": 3, "idle": 0}
    meta = {r.kind: r.names for r in e.metadata("r").collect()}
    assert meta == {"metric": ["test_event_count", "value_sum"], "field": ["category"], "event_type": ["test_event"], "source": ["src"]}
    assert [(r.cube, r.n_batches) for r in e.stats().collect()] == [("c", 2)] and e.compute(spark.range(1), {"x": "id + 1"}).first().x == 1
    assert ev.already_stored(rows, e.events()).count() == 2
    e.delete_report("r")
    assert not e.registry.cubes and not (tmp_path / "cubes" / "c").exists()
    e.delete_source("src")
    assert "src" not in e.registry.sources and not (tmp_path / "events" / "source_id=src").exists()


def test_shapes_and_twins(spark, tmp_path):
    e = engine(spark, tmp_path, cubes=(("c", "hour"),))
    rows = some(spark, [(t("2024-01-01T10:00:00"), (100.0, "A")), (t("2024-01-01T11:00:00"), (50.0, "B")), (t("2024-01-01T11:30:00"), (200.0, "A"))])
    e.record("src", rows, 0)
    q = ReportQuery(DAY, "hour", metric="SUM", field="value", filter={"value": [{"operator": "GT", "value": 100}]})
    assert [r.value for r in e.get_report("r", q).collect()] == [250] == [r.value for r in e.realtime_report("r", q, rows).collect()]
    d = DatasetQuery(DAY, "day", compute={"mean": "value_sum / test_event_count"}, filter={"mean": [{"operator": "GT", "value": 1}]})
    for df in (e.get_dataset("r", d), e.realtime_dataset("r", d, rows)):
        (p,) = df.collect()
        assert (p.value_sum, p.mean, p.value_sum_by_category_A) == (350, pytest.approx(350 / 3), 300)
    g = GroupsQuery(DAY, "day", metrics=("value", "test_event_count"), group_by=("category",))
    for df in (e.get_groups("r", g), e.realtime_groups("r", g, rows)):
        (p,) = df.collect()
        assert [tuple(x) for x in p.group_by_category] == [("A", 300, 2), ("B", 50, 1)]
    f = FlatGroupsQuery(DAY, "hour", metrics=("value",), group_by=("category",), limit=1)
    for df in (e.get_flat_groups("r", f), e.realtime_flat_groups("r", f, rows)):
        assert [(r.id, r.category, r.value) for r in df.collect()] == [("ji-1", "A", 300)]
    with pytest.raises(LookupError):
        e.get_flat_groups("r", FlatGroupsQuery(DAY, "day", metrics=("value",), group_by=("category",)))


def test_partitions_pruned_and_reprocessed(spark, tmp_path):
    e = engine(spark, tmp_path, cubes=())
    cube = e.registry.create_cube(CubeDef("r", "p", "minute", partitioned=True, partition_length=10))
    e.record("src", some(spark, [(t(f"2023-10-26T10:{m}:00"), (v, "A")) for m, v in (("29", 10.0), ("25", 20.0), ("19", 30.0), ("08", 40.0))]), 0)
    assert rollup.read(spark, e.cube_path(cube)).select("partition_idx").distinct().count() == 3
    r = (t("2023-10-26T10:00:00"), t("2023-10-26T10:30:00"))
    q = ReportQuery(r, "hour", metric="SUM", field="value")
    assert total(e.get_report("r", q)) == 100
    late = ReportQuery((t("2023-10-26T10:20:00"), t("2023-10-26T10:30:00")), "hour", metric="SUM", field="value")
    plan = e.get_report("r", late)._jdf.queryExecution().executedPlan().toString()
    assert total(e.get_report("r", late)) == 30 and "partition_idx" in plan and "PartitionFilters" in plan
    for _ in range(2):
        e.reprocess(cube, *r)
        assert total(e.get_report("r", q)) == 100
    assert rollup.answers(cube, "hour") and not rollup.answers(CubeDef("r", "x", "hour"), "minute")


def test_retention(spark, tmp_path):
    e = engine(spark, tmp_path, cubes=(), sources=())
    e.registry.create_source(EventSource("src", retention=Retention(7)))
    e.registry.create_event_type("src", "test_event")
    e.registry.create_cube(CubeDef("r", "old", "day", partitioned=True, partition_length=1, retention=Retention(3, "archive")))
    e.offloaders.register("archive", to_parquet(str(tmp_path / "archive")))
    now = t("2024-02-01T12:00:00")
    e.record("src", some(spark, [(now - dt.timedelta(days=9), (1.0, "A")), (now - dt.timedelta(days=4), (123.0, "A")), (now, (5.0, "A"))]), 0)
    gone = e.apply_retention(now)
    assert len(gone["old"]) == 2 and e.events().count() == 2
    assert spark.read.parquet(str(tmp_path / "archive" / "old")).where("aggregation_type = 'SUM' and value = 123").count() == 1
    left = e.get_report("r", ReportQuery((now - dt.timedelta(days=30), now), "day", metric="SUM", field="value"))
    assert total(left) == 5


def test_plugins(spark, tmp_path):
    calls = []

    class Plugin:
        def on_engine_init(self, engine):
            calls.append("init")

        def on_engine_shutdown(self, engine):
            calls.append("shutdown")

        def before_event_record(self, df, source):
            return df.withColumn("payload", F.struct((F.col("payload.value") * 2).alias("value"), F.col("payload.category").alias("category")))

        def after_event_record(self, df, source):
            calls.append("recorded")

        def on_get_metrics(self, e):
            from cubeline.operators.fanout import metric_rows

            return metric_rows(e, kinds=("COUNT",), attributions=False).withColumn("event_type", F.lit("extra"))

        def before_metrics_written(self, cells, cube):
            calls.append("before")

        def after_metrics_written(self, cube, batch):
            calls.append("written")

        def after_aggregation_written(self, cube, batch):
            calls.append("aggregation")

        def before_aggregate_generated(self, q, report):
            calls.append("query")

        def after_aggregate_generated(self, df, q):
            return df.withColumn("mark", F.lit(1))

        def register_engine_methods(self, engine):
            return {"greet": lambda who: f"Hello, {who}!", "record": None}

    class Second:
        def before_event_record(self, df, source):
            return df.withColumn("payload", F.struct((F.col("payload.value") + 1).alias("value"), F.col("payload.category").alias("category")))

    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        e = engine(spark, tmp_path, plugins=(Plugin(), Second()))
    assert e.greet("world") == "Hello, world!" and any("record" in str(x.message) for x in w)
    e.record("src", some(spark, [(t("2024-01-01T10:00:00"), (10.0, "A"))]), 0)
    (r,) = e.get_report("r", ReportQuery(DAY, "day", metric="SUM", field="value")).collect()
    assert (r.value, r.mark) == (21, 1)  # the second plugin got what the first returned
    assert total(e.get_report("r", ReportQuery(DAY, "day", events=("extra",)))) == 1
    e.shutdown()
    assert {"init", "shutdown", "recorded", "before", "written", "aggregation", "query"} <= set(calls)


def test_inactive_reports_take_nothing(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.registry.create_report(Report("off", active=False))
    e.registry.create_cube(CubeDef("off", "dead"))
    e.record("src", some(spark, [(t("2024-01-01T10:00:00"), (1.0, "A"))]), 0)
    assert not (tmp_path / "cubes" / "dead").exists() and e.registry.owned_by("nobody") == []


def test_json_events(spark, tmp_path):
    good = '{"uuid": "123e4567-e89b-12d3-a456-426614174000", "eventType": "x", "timestamp": "2024-01-01T00:00:00Z", "payload": {"n": 1.5, "s": "a", "b": true, "z": null, "o": {"k": 1}}}\n{"uuid": "123e4567-e89b-12d3-a456-426614174001", "eventType": "x"}\n'
    (tmp_path / "a.json").write_text(good)
    e = ev.read_json(spark, str(tmp_path / "a.json"), "web")
    from cubeline.operators.fanout import metric_rows

    rows = {(r.aggregation_type, r.payload_field, r.payload_category, r.value) for r in metric_rows(e, "day").collect()}
    assert {("SUM", "n", None, 1.5), ("CATEGORY", "s", "a", 1.0), ("CATEGORY", "b", "true", 1.0), ("BOOLEAN", "b", None, 1.0), ("COMPOUND_SUM", "n", "a", 1.5)} <= rows and len(rows) == 8
    assert e.where("ts is null").count() == 0
    (tmp_path / "b.json").write_text('{"uuid": "nope", "eventType": "x"}\n')
    with pytest.raises(Exception, match="not a UUID"):
        ev.read_json(spark, str(tmp_path / "b.json"), "web").collect()
