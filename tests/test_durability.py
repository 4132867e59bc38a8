"""What survives: repeated batches, crashes, restarts, compaction."""

import datetime as dt

import pytest
from helpers import engine, events, t
from pyspark.sql import functions as F

from cubeline.model import Condition, CubeDef, DatasetQuery, EventSource, FlatGroupsQuery, GroupsQuery, Report, ReportQuery, Retention, Subscription, extend_queries
from cubeline.operators import rollup
from cubeline.operators.fanout import metric_rows
from cubeline.plans import registry as R
from cubeline.plans.engine import Engine
from cubeline.plans.store import Store

DAY = (t("2024-01-01T00:00:00"), t("2024-01-01T23:59:00"))
SUM = ReportQuery(DAY, "day", metric="SUM", field="value")


def some(spark, rows, first=0):
    return events(spark, "value:double,category:string", rows).withColumn("uuid", F.concat(F.lit(f"{first}-"), "uuid"))


def total(df):
    return sum(r.value for r in df.collect())


def two_batches(spark, e):
    made = [some(spark, [(t(f"2024-01-01T1{k}:00:00"), (10.0, "A"))], k) for k in range(2)]
    for k, b in enumerate(made):
        e.record("src", b, k)
    return made


def test_replay_after_retention(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.registry.update_source("src", retention=Retention(7))
    one, two = two_batches(spark, e)
    assert total(e.get_report("r", SUM)) == 20
    e.apply_retention(t("2024-01-02T00:00:00"))
    for k, b in enumerate((one, two)):
        e.record("src", b, k)
        assert total(e.get_report("r", SUM)) == 20 and e.events().count() == 2
    e.apply_retention(t("2024-02-02T00:00:00"))
    assert e.events().count() == 0 and total(e.get_report("r", SUM)) == 20
    e.record("src", two, 1)
    assert e.events().count() == 0 and total(e.get_report("r", SUM)) == 20
    with pytest.raises(ValueError, match="no longer kept"):
        e.reprocess(e.registry.cubes["c"], *DAY)


def test_one_batch_replayed_stays(spark, tmp_path):
    e = engine(spark, tmp_path)
    b = some(spark, [(t("2024-01-01T10:00:00"), (10.0, "A"))])
    e.record("src", b, 0)
    e.record("src", b, 1)  # nothing new: an empty batch
    e.record("src", b, 0)
    assert total(e.get_report("r", SUM)) == 10 and e.events().count() == 1


def test_replay_after_reprocess(spark, tmp_path):
    e = engine(spark, tmp_path)
    one, two = two_batches(spark, e)
    for _ in range(2):
        e.reprocess(e.registry.cubes["c"], *DAY)
        assert total(e.get_report("r", SUM)) == 20
    e.record("src", two, 1)
    e.record("src", one, 0)
    assert total(e.get_report("r", SUM)) == 20


def test_reprocess_touches_its_partitions_alone(spark, tmp_path):
    e = engine(spark, tmp_path, cubes=())
    cube = e.registry.create_cube(CubeDef("r", "p", "minute", partitioned=True, partition_length=60))
    two_batches(spark, e)
    e._delete(e.cube_path(cube) + "/batch=src-0")  # lost cells come back, where they are asked for
    e.reprocess(cube, t("2024-01-01T11:00:00"), t("2024-01-01T11:30:00"))
    assert total(e.get_report("r", SUM)) == 10
    e.reprocess(cube, *DAY)
    assert total(e.get_report("r", SUM)) == 20
    # cells whose events are gone go
    e._delete(e._events_path("src") + "/batch=1")
    e.reprocess(cube, t("2024-01-01T11:00:00"), t("2024-01-01T11:30:00"))
    assert total(e.get_report("r", SUM)) == 10


def test_compaction(spark, tmp_path):
    e = engine(spark, tmp_path)
    cube = e.registry.cubes["c"]
    made = [some(spark, [(t("2024-01-01T10:00:00"), (1.0 + k, "A"))], k) for k in range(4)]
    for k, b in enumerate(made):
        e.record("src", b, k)
    assert e.compact(cube) == 3 and len(e.store.names(e.cube_path(cube))) == 2
    assert total(e.get_report("r", SUM)) == 10
    e.record("src", made[1], 1)  # a summed batch is in it for good
    e.record("src", made[3], 3)
    assert total(e.get_report("r", SUM)) == 10 and e.compact(cube) == 0
    e.reprocess(cube, *DAY)
    assert total(e.get_report("r", SUM)) == 10
    e.record("src", some(spark, [(t("2024-01-01T12:00:00"), (5.0, "B"))], 9), 4)
    # a compaction that breaks off before its fact is put leaves all as it was
    put, e.store.put = e.store.put, lambda *a: (_ for _ in ()).throw(RuntimeError("crash"))
    with pytest.raises(RuntimeError):
        e.compact(cube)
    e.store.put = put
    assert total(e.get_report("r", SUM)) == 15 and e.compact(cube) == 2 and total(e.get_report("r", SUM)) == 15
    assert rollup.compacted(rollup.read(spark, e.cube_path(cube), e._batches(cube), "timestamp")).where("aggregation_type = 'COUNT' and attribution_type = '_total'").agg(F.sum("value")).first()[0] == 5


def test_crash_between_events_and_cells(spark, tmp_path):
    e = engine(spark, tmp_path)
    b = some(spark, [(t("2024-01-01T10:00:00"), (10.0, "A"))])
    roll, e.roll = e.roll, lambda *a: (_ for _ in ()).throw(RuntimeError("crash"))
    with pytest.raises(RuntimeError):
        e.record("src", b, 0)
    e.roll = roll
    e.record("src", b, 0)
    assert total(e.get_report("r", SUM)) == 10 and not e.store.names(f"{tmp_path}/staging")


def test_restart(spark, tmp_path):
    e = engine(spark, tmp_path, buffer_age_s=None)
    e.registry.update_source("src", owners=("ann", "bob"), dedupe_days=3)
    e.registry.create_cube(CubeDef("r", "daily", "day", events=("test_event",), partitioned=True, partition_length=2, retention=Retention(9, "x")))
    e.registry.update_cube("daily", sources=("src",))
    e.registry.subscribe("r", Subscription("low", "threshold", "hour", (Condition("value_sum", "LT", 100),)))
    e.registry.create_report(Report("gone"))
    e.delete_report("gone")
    two_batches(spark, e)
    f = Engine(spark, str(tmp_path))
    for kind in ("sources", "types", "reports", "cubes", "subscriptions"):
        assert getattr(f.registry, kind) == getattr(e.registry, kind), kind
    assert total(f.get_report("r", SUM)) == 20 and [s.id for s in f.registry.owned_by("bob")] == ["src"] and f.registry.owned_by("carl") == []
    with pytest.raises(ValueError):
        f.registry.update_cube("daily", granularity="hour")
    f.registry.delete_cube("daily")
    f.registry.unsubscribe("r", "low")
    f.registry.update_report("r", active=False)
    g = Engine(spark, str(tmp_path)).registry
    assert list(g.cubes) == ["c"] and g.subscriptions == {"r": {}} and g.active_cubes() == []
    e.heartbeat()
    f.heartbeat()
    assert e.instances() == 2 and e.instances(ttl_s=-1) == 0
    f.shutdown()


def test_facts(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.get("a/b") is None
    for k in range(4):
        s.put("a/b", {"k": k, "text": "é"})
    assert s.get("a/b") == {"k": 3, "text": "é"} and len([n for n in s.names(f"{tmp_path}/_facts/a/b") if n.isdigit()]) <= 2


def test_lookups_are_kept_until_something_changes(spark):
    r = R.Registry()
    r.create_report(Report("r"))
    assert r.cubes_of("r") == [] and r.cubes_of("r") is r.cubes_of("r")
    r.create_cube(CubeDef("r", "c"))
    assert [c.name for c in r.cubes_of("r")] == ["c"]


def test_the_cube_that_fits_answers(spark, tmp_path):
    e = engine(spark, tmp_path, cubes=(("fine", "minute"), ("mid", "hour"), ("coarse", "day")))
    two_batches(spark, e)
    pick = lambda g: [c.name for c in e._cubes("r", ReportQuery(DAY, g), ())]
    assert [pick(g) for g in ("30day", "day", "6hour", "hour", "5minute", "second")] == [["coarse"], ["coarse"], ["mid"], ["mid"], ["fine"], ["fine"]]
    assert total(e.get_report("r", SUM)) == 20  # and not three times that
    e.registry.create_cube(CubeDef("r", "own", "day", events=("test_event",)))
    e.record("src", some(spark, [(t("2024-01-01T15:00:00"), (1.0, "A"))], 5), 5)
    assert pick("day") == ["coarse"] and total(e.get_report("r", SUM)) == 21  # another cube has all of its events
    e.registry.create_report(Report("s"))
    for kind in ("test_event", "other"):
        e.registry.create_event_type("src", kind)
        e.registry.create_cube(CubeDef("s", f"of_{kind}", "day", events=(kind,)))
    e.record("src", some(spark, [(t("2024-01-01T16:00:00"), (2.0, "A"))], 6).withColumn("event_type", F.lit("other")), 6)
    e.record("src", some(spark, [(t("2024-01-01T16:00:00"), (3.0, "A"))], 7), 7)
    assert total(e.get_report("s", SUM)) == 5  # cubes of other events are added


def test_buffer(spark, tmp_path):
    now = [t("2024-01-01T10:04:00")]
    e = engine(spark, tmp_path, clock=lambda: now[0])
    told = []
    e.broadcast.listen("report:updates:r", told.append)
    batch = some(spark, [(t("2024-01-01T10:00:00"), (10.0, "A")), (t("2024-01-01T10:03:00"), (5.0, "B")), (t("2024-01-01T09:00:00"), (99.0, "A"))])
    e.record("src", batch, 0)
    hour = ReportQuery(DAY, "hour", metric="SUM", field="value")
    for _ in range(2):
        assert [r.value for r in e.realtime_report("r", hour).collect()] == [15.0]  # the old event was not let in
        e.record("src", batch, 0)  # a repeated batch replaces its own
    assert total(e.get_report("r", hour)) == 114
    assert {m["type"] for m in told} == {"aggregation:written", "realtime:metrics"} and all(m["changes"] == e.buffered("r").count() for m in told if m["type"] == "realtime:metrics")
    (p,) = e.realtime_dataset("r", DatasetQuery(DAY, "day")).collect()
    assert p.value_sum == 15 and p.test_event_count == 2
    (p,) = e.realtime_groups("r", GroupsQuery(DAY, "day", metrics=("value", "none_count"), group_by=("category",))).collect()
    assert [tuple(x) for x in p.group_by_category] == [("A", 10.0, 0.0), ("B", 5.0, 0.0)]
    assert [r.value for r in e.realtime_flat_groups("r", FlatGroupsQuery(DAY, "minute", metrics=("value",), group_by=("category",))).collect()] == [10.0, 5.0]
    now[0] = t("2024-01-01T10:30:00")
    assert e.realtime_report("r", hour).count() == 0
    e.record("src", some(spark, [(t("2024-01-01T10:29:00"), (1.0, "C"))], 7), 1)
    assert e.store.names(f"{tmp_path}/buffer/c") == ["batch=src-1"]  # what is too old has been dropped
    with pytest.raises(LookupError):
        Engine(spark, str(tmp_path / "none"), buffer_age_s=None).realtime_report("r", hour)


def test_plugins_on_every_path(spark, tmp_path):
    class Extra:
        def on_get_metrics(self, e):
            return metric_rows(e, kinds=("COUNT",), attributions=False).withColumn("event_type", F.lit("extra"))

        def before_aggregate_generated(self, q, report):
            calls.append(type(q).__name__)

        def before_metrics_written(self, cells, cube):
            calls.append("cells")

        def before_realtime_metrics_written(self, cells, cube):
            calls.append("realtime")

    calls = []
    e = engine(spark, tmp_path, plugins=(Extra(),), clock=lambda: t("2024-01-01T11:01:00"), buffer_age_s=86_400)
    two_batches(spark, e)
    extra = ReportQuery(DAY, "day", events=("extra",))
    assert total(e.get_report("r", extra)) == 2 == total(e.realtime_report("r", extra))
    n = len(calls)
    e.reprocess(e.registry.cubes["c"], *DAY)
    assert calls[n:] == ["cells"] and total(e.get_report("r", extra)) == 2
    e.realtime_groups("r", GroupsQuery(DAY, "day", metrics=("value",)))
    assert {"cells", "realtime", "ReportQuery", "GroupsQuery"} == set(calls)


def test_cells_redirected(spark, tmp_path):
    class Redirect:
        def before_metrics_written(self, cells, cube):
            return cells, e.registry.cubes["other"]

    e = engine(spark, tmp_path)
    e.registry.create_report(Report("s", active=False))
    e.registry.create_cube(CubeDef("s", "other", "minute"))
    e.plugins.plugins.append(Redirect())
    two_batches(spark, e)
    assert total(e.get_report("s", SUM)) == 20
    with pytest.raises(LookupError):
        e.get_report("r", SUM)


def test_query_extensions():
    def check(v):
        if not isinstance(v, int):
            raise ValueError("not a number")

    with pytest.raises(ValueError, match="no plugin"):
        ReportQuery(DAY, extensions={"zoom_": 1})
    extend_queries("zoom_", check)
    assert ReportQuery(DAY, extensions={"zoom_": 1}).extensions["zoom_"] == 1
    with pytest.raises(ValueError, match="not a number"):
        ReportQuery(DAY, extensions={"zoom_": "x"})


def test_subscriptions_of_a_report(spark, tmp_path):
    e = engine(spark, tmp_path, cubes=(("c", "minute"),))
    e.registry.subscribe("r", Subscription("low", "threshold", "hour", (Condition("value_sum", "LT", 100), Condition("test_event_count", "EQ", 1))))
    e.registry.subscribe("r", Subscription("done", "completed", "hour"))
    two_batches(spark, e)
    sent = []
    fired = e.notify("r", sent.append, *DAY)
    assert fired == sent and [f["subscription"] for f in sent] == ["low", "done", "done"] and sent[0]["timestamp"] == t("2024-01-01T11:00:00")
    assert e.notify("r", sent.append, *DAY) == [] == Engine(spark, str(tmp_path)).notify("r", sent.append, *DAY)
    e.record("src", some(spark, [(t("2024-01-01T12:00:00"), (1.0, "A"))], 9), 9)
    assert [f["subscription"] for f in e.notify("r", sent.append, *DAY)] == ["low", "done"]


def test_dedupe_within_days(spark, tmp_path):
    e = engine(spark, tmp_path, sources=())
    e.registry.create_source(EventSource("src", dedupe_days=2))
    e.registry.create_event_type("src", "test_event")
    same = lambda day: some(spark, [(t(f"2024-01-{day}T10:00:00"), (1.0, "A"))])
    assert [e.record("src", same(d), k).count() for k, d in enumerate(("01", "03", "09"))] == [1, 0, 1]


def test_schemas_that_widen(spark, tmp_path):
    e = engine(spark, tmp_path, sources=("src", "two"))
    e.record("src", events(spark, "value:double", [(t("2024-01-01T10:00:00"), (1.0,))]), 0)
    e.record("src", events(spark, "value:double,kind:string", [(t("2024-01-01T10:00:00"), (2.0, "x"))]).withColumn("uuid", F.lit("n")), 1)
    e.record("two", events(spark, "other:long", [(t("2024-01-01T10:00:00"), (3,))], "two"), 0)
    got = {(r.source_id, r.batch): r.payload.asDict() for r in e.events().collect()}
    assert got == {("src", 0): {"value": 1.0, "kind": None, "other": None}, ("src", 1): {"value": 2.0, "kind": "x", "other": None}, ("two", 0): {"value": None, "kind": None, "other": 3}}
    assert e.recent("two").first().payload.other == 3 and {r.source_id: r.n_events for r in e.counts().collect()} == {"src": 2, "two": 1}
    assert dt.date.today() > dt.date(2024, 1, 1)
