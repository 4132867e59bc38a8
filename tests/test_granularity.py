import datetime as dt

import pytest
from helpers import t
from pyspark.sql import functions as F

from cubeline.functions import granularity as G
from cubeline.functions.naming import label, safe_name


def test_buckets_match_plain_truncation(spark):
    times = [t("2023-11-01T10:29:00.123456"), t("1969-12-31T23:59:59.999999"), t("2000-02-29T00:00:00"), t("2024-01-31T13:37:01.250001")]
    df = spark.createDataFrame([(x, x) for x in times], "z timestamp, n timestamp_ntz")
    for g in G.GRANULARITIES:
        got = df.select(G.bucket(F.col("z"), g), G.bucket(F.col("n"), g, df.schema["n"].dataType)).collect()
        want = [G.truncate(x, g) for x in times]
        assert [r[0] for r in got] == want == [r[1] for r in got], g
        assert all((x - w) < dt.timedelta(milliseconds=G.to_ms(g)) and w <= x for x, w in zip(times, want))


def test_known_buckets():
    assert G.truncate(t("2023-11-01T10:29:00"), "5minute") == t("2023-11-01T10:25:00")
    assert G.truncate(t("2023-11-01T10:29:00.260"), "250ms") == t("2023-11-01T10:29:00.250")
    for bad in ("week", "2day", ["hour", "day"], None):
        with pytest.raises(ValueError):
            G.to_ms(bad)


def test_partitions():
    assert G.partition_name("test_aggr", G.ordinal_of(t("2023-01-01T12:05:00"), "minute", 10)) == "test_aggr_2787624"
    assert list(G.ordinals_between(t("2023-01-01T12:05:00"), t("2023-01-01T12:10:00"), "minute", 10)) == [2787624, 2787625]


def test_range_of_raw_times():
    low, high = G.raw_range(t("2024-01-01T10:00:30"), t("2024-01-01T11:00:00"), "minute")
    assert (low, high) == (t("2024-01-01T10:01:00"), t("2024-01-01T11:01:00"))


def test_periods():
    now = t("2024-01-31T00:00:00")
    assert G.period("6h", now) == (t("2024-01-30T18:00:00"), now)
    assert G.period("1w", now)[0] == t("2024-01-24T00:00:00") and G.period("1m", now)[0] == t("2024-01-01T00:00:00")
    assert G.period("custom:2024-01-01T00:00:00Z_2024-01-02T00:00:00Z", now) == (t("2024-01-01T00:00:00"), t("2024-01-02T00:00:00"))
    with pytest.raises(ValueError):
        G.period("7x", now)


def test_names(spark):
    assert spark.range(1).select(safe_name(F.lit("My Source-1"))).first()[0] == "my_source_1"
    assert label("amount_sum") == "Amount Sum" and label("amount_sum_by_currency_USD") == "Amount Sum (Currency: USD)"
