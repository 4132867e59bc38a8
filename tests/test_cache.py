import dataclasses

from helpers import engine, events, t

from cubeline.model import DatasetQuery, ReportQuery
from cubeline.plans.cache import ResultCache, gaps, query_key


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def test_gaps_and_keys():
    d = [t(f"2024-01-{i:02}T00:00:00") for i in range(1, 10)]
    assert gaps((d[0], d[5]), [(d[1], d[2]), (d[3], d[4])]) == [(d[0], d[1]), (d[2], d[3]), (d[4], d[5])]
    assert gaps((d[1], d[2]), [(d[0], d[5])]) == [] and gaps((d[0], d[1]), [(d[2], d[3])]) == [(d[0], d[1])]
    assert gaps((d[0], d[5]), [(d[0], d[3]), (d[2], d[4])]) == [(d[4], d[5])]
    a = ReportQuery((d[0], d[1]))
    assert query_key(a) == query_key(dataclasses.replace(a, cache=True, rebuild_cache=True)) != query_key(dataclasses.replace(a, time_range=(d[0], d[2])))
    assert query_key(a, base=True) == query_key(dataclasses.replace(a, time_range=(d[0], d[2])), base=True)


def value(df):
    return sum(r.value for r in df.collect())


def test_whole_results(spark, tmp_path):
    clock = Clock()
    e = engine(spark, tmp_path / "e", cache=ResultCache(spark, str(tmp_path / "cache"), ttl_s=2, clock=clock))
    q = ReportQuery((t("2024-01-01T00:00:00"), t("2024-01-02T00:00:00")), "hour", metric="SUM", field="value")
    e.record("src", events(spark, "value:double", [(t("2024-01-01T10:00:00"), (100.0,)), (t("2024-01-01T10:01:00"), (50.0,))]), 0)
    assert value(e.get_report("r", q)) == 150
    e.record("src", events(spark, "value:double", [(t("2024-01-01T11:00:00"), (849.0,))], kind="test_event").withColumn("uuid", __import__("pyspark").sql.functions.lit("new")), 1)
    assert value(e.get_report("r", q)) == 150  # kept
    assert value(e.get_report("r", dataclasses.replace(q, rebuild_cache=True))) == 999
    clock.now = 5
    assert value(e.get_report("r", q)) == 999
    e.cache.controlled = True
    e.cache.whole.clear()
    e.get_report("r", q)
    assert not e.cache.whole
    e.get_report("r", dataclasses.replace(q, cache=True))
    assert len(e.cache.whole) == 1


def test_small_results_are_local_and_files_of_old_ones_go(spark, tmp_path, monkeypatch):
    from cubeline.plans import cache as C

    clock, made = Clock(), []
    c = ResultCache(spark, str(tmp_path), ttl_s=10, clock=clock)
    q = ReportQuery((t("2024-01-01T00:00:00"), t("2024-01-02T00:00:00")), "hour")
    make = lambda: made.append(1) or spark.range(3).selectExpr("timestamp'2024-01-01 00:00:00' timestamp", "id value", "array(struct(id x)) a")
    first = c.get(q, make)
    assert "LocalTableScan" in first._jdf.queryExecution().executedPlan().toString() and first.schema.simpleString() == make().schema.simpleString()
    assert sorted(c.get(q, make).collect()) == sorted(make().collect()) and len(made) == 3
    clock.now = 11
    c.get(q, make)
    assert len(list(tmp_path.iterdir())) == 2  # what was handed out may still be read
    clock.now = 11 + C.GRACE_S + 11
    c.get(q, make)
    assert len(list(tmp_path.iterdir())) == 2 and first.count() == 3
    monkeypatch.setattr(C, "IN_MEMORY", 0)
    large = c.get(dataclasses.replace(q, granularity="day"), make)
    assert "FileScan" in large._jdf.queryExecution().executedPlan().toString()


def test_chunks(spark, tmp_path):
    e = engine(spark, tmp_path / "e", cubes=(("c", "hour"),), cache=ResultCache(spark, str(tmp_path / "cache")), partial_cache=True)
    e.record("src", events(spark, "value:double,items:double", [(t(f"2024-01-0{d}T10:00:00"), (v, i)) for d, v, i in ((1, 10.0, 1.0), (3, 30.0, 3.0), (5, 50.0, 5.0))]), 0)

    def ask(a, b, **kw):
        return ReportQuery((t(f"2024-01-0{a}T00:00:00"), t(f"2024-01-0{b}T23:00:00")), "day", metric="SUM", field="value", **kw)

    assert [value(e.get_report("r", ask(1, 1))), value(e.get_report("r", ask(3, 3)))] == [10, 30]
    (chunks,) = e.cache.chunks.values()
    assert len(chunks) == 2
    e._delete(e.cube_path(e.registry.cubes["c"]))
    e.registry.sources.pop("none", None)
    e.roll(e.registry.cubes["c"], events(spark, "value:double,items:double", [(t("2024-01-05T10:00:00"), (50.0, 5.0))]), "x")
    assert [r.value for r in e.get_report("r", ask(1, 5)).collect()] == [10, 30, 50]  # two chunks kept, the rest fetched
    assert [r.value for r in e.get_report("r", ask(2, 5)).collect()] == [30, 50]  # chunks are cut to the request
    assert value(e.get_report("r", ask(1, 5, rebuild_cache=True))) == 50
    d = DatasetQuery((t("2024-01-05T00:00:00"), t("2024-01-05T23:00:00")), "day", metrics=("value", "items"))
    (p,) = e.get_dataset("r", d).collect()
    assert (p.value_sum, p.items_sum, p.test_event_count) == (50, 5, 1)
    assert [x.value_sum for x in e.get_dataset("r", d).collect()] == [50]
