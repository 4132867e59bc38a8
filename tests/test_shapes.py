import random
from collections import defaultdict

import pytest
from helpers import events, t
from pyspark.sql import functions as F

from cubeline.functions.formula import compute
from cubeline.model import DatasetQuery, FlatGroupsQuery, GroupsQuery, ReportQuery
from cubeline.operators import shapes as S
from cubeline.operators.fanout import metric_rows
from cubeline.operators.rollup import merge


def series(df):
    return {(r.timestamp, *([r.category] if "category" in df.columns else [])): r.value for r in df.collect()}


def both(e, q, storage="minute"):
    """The answer from events, which must be the one from rollup rows."""
    a, b = series(S.report(e, q, storage)), series(S.report_from_rows(merge(metric_rows(e, storage)), q, storage))
    assert a == b
    return a


@pytest.fixture
def payments(spark):
    rows = [(100, "USD", "user_1", "11:59"), (150, "USD", "user_2", "11:58"), (50, "EUR", "user_1", "11:57"), (200, "USD", "user_2", "11:56"), (75, "GBP", "user_3", "11:55")]
    return events(spark, "amount:double,currency:string", [(t(f"2023-12-01T{h}:00"), (float(a), c), [("identity", u)]) for a, c, u, h in rows])


def test_payments(payments):
    r, hour = (t("2023-12-01T11:00:00"), t("2023-12-01T12:00:00")), t("2023-12-01T11:00:00")
    q = ReportQuery(r, "hour")
    assert both(payments, q) == {(hour,): 5}
    s = ReportQuery(r, "hour", metric="SUM", field="amount")
    assert both(payments, s) == {(hour,): 575}
    assert both(payments, ReportQuery(r, "hour", metric="CATEGORY", field="currency")) == {(hour, "USD"): 3, (hour, "EUR"): 1, (hour, "GBP"): 1}
    assert both(payments, ReportQuery(r, "hour", metric="SUM", field="amount", attribution=("identity", "user_1"))) == {(hour,): 150}
    assert both(payments, ReportQuery(r, "hour", metric="SUM", field="amount", group_by=("currency",)))[(hour, "USD")] == 450
    assert both(payments, ReportQuery(r, "hour", metric="COMPOUND_SUM")) == both(payments, ReportQuery(r, "hour", metric="LEAF_SUM")) == {(hour,): 575}
    assert both(payments, ReportQuery(r, "hour", metric="SUM", field="nothing")) == {}
    assert both(payments, ReportQuery(r, "hour", sources=("other",))) == {} == both(payments, ReportQuery(r, "hour", events=("x",)))


def test_granularity(spark):
    e = events(spark, "amount:double", [(t(f"2023-11-01T10:{m}:00"), (v,)) for m, v in ((29, 10.0), (24, 20.0), (23, 30.0), (18, 40.0))])
    q = ReportQuery((t("2023-11-01T10:10:00"), t("2023-11-01T10:30:00")), "5minute", metric="SUM", field="amount")
    assert both(e, q) == {(t("2023-11-01T10:15:00"),): 40, (t("2023-11-01T10:20:00"),): 50, (t("2023-11-01T10:25:00"),): 10}
    assert both(e, ReportQuery((t("2023-11-01T08:30:00"), t("2023-11-01T10:30:00")), "hour", metric="SUM", field="amount")) == {(t("2023-11-01T10:00:00"),): 100}
    assert len(both(e, ReportQuery((t("2023-11-01T10:10:00"), t("2023-11-01T10:30:00")), "second"))) == 4  # no finer than what is stored


def test_dataset(spark):
    rows = [("09:59", 100, 2, "USD"), ("09:58", 150, 3, "USD"), ("09:57", 50, 1, "EUR"), ("09:56", 200, None, "EUR")]
    e = events(spark, "amount:double,items:int,currency:string", [(t(f"2023-11-20T{h}:00"), (float(a), i, c)) for h, a, i, c in rows], kind="sale")
    r = (t("2023-11-20T09:00:00"), t("2023-11-20T10:00:00"))
    q = DatasetQuery(r, "hour")
    (p,) = S.dataset_wide(S.dataset(e, q)).collect()
    assert (p.sale_count, p.amount_sum, p.items_sum, p.amount_sum_by_currency_USD, p.amount_sum_by_currency_EUR) == (4, 500, 6, 250, 250)
    for names in (("amount",), ("amount_sum",)):
        sub = S.dataset_wide(S.dataset(e, DatasetQuery(r, "hour", metrics=names)))
        assert set(S.dataset_wide(S.dataset_long(S.dataset_rows(e, q), DatasetQuery(r, "hour", metrics=names))).columns) == set(sub.columns)
        assert set(sub.columns) == {"timestamp", "sale_count", "amount_sum", "amount_sum_by_currency_USD", "amount_sum_by_currency_EUR"}
    m = DatasetQuery(r, "minute", sort_by="amount_sum")
    got = S.ordered(S.dataset_wide(S.dataset_long(S.dataset_rows(e, m), m)), m.sort_by, m.descending).collect()
    assert [x.amount_sum for x in got] == [200, 150, 100, 50] and got[0].items_sum is None


def test_boolean_groups(spark):
    m1, m2 = "2024-01-01T10:00:0", "2024-01-01T10:01:0"
    e = events(spark, "is_premium:boolean,is_trial:boolean,score:double", [(t(m1 + "1"), (True, None, 100.0)), (t(m1 + "2"), (False, True, 50.0)), (t(m1 + "3"), (None, None, 25.0)), (t(m2 + "1"), (True, False, None))], kind="user_interaction")
    q = DatasetQuery((t(m1 + "0"), t(m2 + "0")), "minute", metrics=("score",))
    want = {t(m1 + "0"): [("is_premium", True, t(m1 + "1")), ("is_premium", False, t(m1 + "2")), ("is_trial", True, t(m1 + "2"))], t(m2 + "0"): [("is_premium", True, t(m2 + "1")), ("is_trial", False, t(m2 + "1"))]}
    for df in (S.boolean_groups(e, q), S.boolean_groups_from_rows(metric_rows(e), q)):
        assert {r.timestamp: [tuple(x) for x in r["$boolean_groups"]] for r in df.collect()} == want
    wide = {r.timestamp: r for r in S.dataset_wide(S.dataset_long(S.dataset_rows(e, q), q)).collect()}
    assert (wide[t(m1 + "0")].score_sum, wide[t(m1 + "0")].user_interaction_count, wide[t(m2 + "0")].score_sum) == (175, 3, None)


def test_groups(spark):
    e = events(spark, "amount:double,category:string,region:string", [(t(f"2025-10-16T10:0{i}:00"), (v, c, r)) for i, (v, c, r) in enumerate([(100.0, "A", "US"), (200.0, "A", "EU"), (300.0, "B", "US")])])
    r = (t("2025-10-16T09:00:00"), t("2025-10-16T11:00:00"))
    q = GroupsQuery(r, "hour", metrics=("amount", "test_event_count"), group_by=("category", "region"))
    for long in (S.groups_long(e, q), S.groups_long_from_rows(metric_rows(e), q)):
        (g,) = S.groups_nested(long, q, fill=True).collect()
        assert (g.amount_sum, g.test_event_count) == (600, 3)
        assert [tuple(x) for x in g.group_by_category] == [("A", 300, 2), ("B", 300, 1)] and [tuple(x) for x in g.group_by_region] == [("EU", 200, 1), ("US", 400, 2)]
    m = GroupsQuery(r, "minute", metrics=("amount",), group_by=("category",), sort_by="timestamp")
    assert [x.timestamp.minute for x in S.groups_nested(S.groups_long(e, m), m).collect()] == [2, 1, 0]
    none = GroupsQuery(r, "hour", metrics=("amount",))
    assert S.groups_long(e, none).count() == 1


TREE = [(100.0, "USA", "NYC", "Finance"), (200.0, "USA", "NYC", "Tech"), (300.0, "USA", "SF", "Tech"), (400.0, "Canada", "Toronto", "Finance")]
FLAT = FlatGroupsQuery((t("2025-10-16T09:00:00"), t("2025-10-16T11:00:00")), "minute", metrics=("amount",), group_by=("country", "city", "sector"))


def tree(df):
    return [(r.id, r["$parent_id"], r["$group_by"], r["$group_level"], r.country, r.city, r.sector, r.amount, r["$is_group_root"]) for r in df.collect()]


def test_flat_groups(spark):
    e = events(spark, "amount:double,country:string,city:string,sector:string", [(t("2025-10-16T10:00:00"), x) for x in TREE])
    want = [
        ("ji-1", None, "country", 0, "Canada", None, None, 400, True), ("ji-2", ["ji-1"], "city", 1, "Canada", "Toronto", None, 400, True), ("ji-3", ["ji-1", "ji-2"], "sector", 2, "Canada", "Toronto", "Finance", 400, False),
        ("ji-4", None, "country", 0, "USA", None, None, 600, True), ("ji-5", ["ji-4"], "city", 1, "USA", "NYC", None, 300, True), ("ji-6", ["ji-4", "ji-5"], "sector", 2, "USA", "NYC", "Finance", 100, False),
        ("ji-7", ["ji-4", "ji-5"], "sector", 2, "USA", "NYC", "Tech", 200, False), ("ji-8", ["ji-4"], "city", 1, "USA", "SF", None, 300, True), ("ji-9", ["ji-4", "ji-8"], "sector", 2, "USA", "SF", "Tech", 300, False),
    ]
    assert tree(S.flat_groups(e, FLAT)) == want == tree(S.flat_groups_from_rows(merge(metric_rows(e)), FLAT))
    net = {r.id: (r.amount_net, r.amount_tax) for r in compute(S.flat_groups(e, FLAT), {"amount_net": "amount * 0.75", "amount_tax": "amount * 0.25"}).collect()}
    assert net["ji-1"] == (300, 100) and net["ji-4"] == (450, 150)


def test_flat_groups_ragged(spark):
    rows = [*TREE, (7.0, "USA", None, "Tech"), (5.0, None, "NYC", "Tech"), (9.0, None, None, None)]
    e = events(spark, "amount:double,country:string,city:string,sector:string", [(t("2025-10-16T10:00:00"), x) for x in rows])
    got = tree(S.flat_groups(e, FLAT))
    assert [(g[0], g[1], g[2], g[7], g[8]) for g in got] == [
        ("ji-1", None, "country", 400, True), ("ji-2", ["ji-1"], "city", 400, True), ("ji-3", ["ji-1", "ji-2"], "sector", 400, False), ("ji-4", None, "city", 5, True), ("ji-5", ["ji-4"], "sector", 5, False),
        ("ji-6", None, "country", 607, True), ("ji-7", ["ji-6"], "city", 300, True), ("ji-8", ["ji-6", "ji-7"], "sector", 100, False), ("ji-9", ["ji-6", "ji-7"], "sector", 200, False),
        ("ji-10", ["ji-6"], "city", 300, True), ("ji-11", ["ji-6", "ji-10"], "sector", 300, False), ("ji-12", ["ji-6"], "sector", 7, False),
    ]


def test_ledger(spark):
    """Random events: the dataset over all buckets is the ledger kept while they were made, from events and from the rollup."""
    rng, ledger, rows = random.Random(19), defaultdict(float), []
    for i in range(400):
        price, volume, asset, market, day = rng.randint(1, 1000), rng.randint(1, 1000), rng.choice("ABCD"), rng.choice("ABCD"), rng.random() < 0.5
        kind = f"type{i % 5}"
        rows.append((t(f"2024-03-{rng.randint(1, 10):02}T{rng.randint(0, 23):02}:00:01"), (float(price), float(volume), asset, market, day), [("user", "u")], kind))
        ledger[f"{kind}_count"] += 1
        cats = {"asset": asset, "market": market, "time_of_day": str(day).lower()}
        for c, v in cats.items():
            ledger[f"{c}_by_{v}"] += 1
        for n, x in (("price", price), ("volume", volume)):
            ledger[f"{n}_sum"] += x
            for c, v in cats.items():
                ledger[f"{n}_sum_by_{c}_{v}"] += x
    e = events(spark, "price:double,volume:double,asset:string,market:string,time_of_day:boolean", rows)
    q = DatasetQuery((t("2024-03-01T00:00:00"), t("2024-03-11T00:00:00")), "day")
    cells = merge(metric_rows(e, "hour"))
    assert metric_rows(e).count() == 400 * 2 * (1 + 2 + 3 + 1 + 6 + 2)
    for long in (S.dataset(e, q), S.dataset_long(S.dataset_rows(e, q), q), S.dataset_long(S.scoped_rows(cells, q), q, "hour")):
        got = {x.metric_key: x.v for x in long.groupBy("metric_key").agg(F.sum("value").alias("v")).collect()}
        assert got == ledger


def test_query_checks():
    r = (t("2024-01-01T00:00:00"), t("2024-01-02T00:00:00"))
    for make in (lambda: ReportQuery(r, ["hour"]), lambda: ReportQuery(r, "hour", metric="AVG"), lambda: ReportQuery(r[::-1]), lambda: FlatGroupsQuery(r, metrics=("a", "b"), group_by=("x",)), lambda: FlatGroupsQuery(r, metrics=("a",))):
        with pytest.raises(ValueError):
            make()
