import pytest
from helpers import EVENT, engine, events, t
from pyspark.sql import functions as F

from cubeline.model import Condition, DatasetQuery, ReportQuery, Subscription
from cubeline.streaming import ingest as I
from cubeline.streaming import realtime as R

DAY = (t("2024-01-01T00:00:00"), t("2024-01-01T23:59:00"))
FIELDS = "value:double"


def feed(spark, path, batches):
    for n, rows in enumerate(batches):
        events(spark, FIELDS, rows).withColumn("uuid", F.concat(F.lit(f"{n}-"), "uuid")).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(EVENT.format(FIELDS)).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_ingest_drains_and_recovers(spark, tmp_path):
    e = engine(spark, tmp_path / "e")
    rows = [[(t("2024-01-01T10:00:00"), (float(k),)), (t("2024-01-01T10:01:00"), (1.0,), None, "unknown" if k == 2 else "test_event")] for k in range(3)]
    told = []
    stream = feed(spark, tmp_path / "in", rows)
    query = I.ingest(e, "src", stream, str(tmp_path / "ck"), quarantine=str(tmp_path / "q"), on_batch=lambda df, n: told.append(df.count()))
    query.awaitTermination()
    assert sum(told) == 5 and spark.read.parquet(str(tmp_path / "q" / "types")).count() == 1
    s = ReportQuery(DAY, "day", metric="SUM", field="value")
    assert [r.value for r in e.get_report("r", s).collect()] == [5.0]
    more = feed(spark, tmp_path / "in", [[(t("2024-01-01T12:00:00"), (10.0,))]])
    I.ingest(e, "src", more, str(tmp_path / "ck"), quarantine=str(tmp_path / "q")).awaitTermination()  # takes up where it was; the uuid is known
    assert [r.value for r in e.get_report("r", s).collect()] == [5.0]
    assert set(I.stats(query)) == {"batchId", "numInputRows", "inputRowsPerSecond", "processedRowsPerSecond", "waiting"}


def test_failing_batches_are_put_aside(spark, tmp_path):
    e = engine(spark, tmp_path / "e")
    e.record = lambda *a: (_ for _ in ()).throw(RuntimeError("down"))
    waits = []
    stream = feed(spark, tmp_path / "in", [[(t("2024-01-01T10:00:00"), (1.0,))]])
    I.ingest(e, "src", stream, str(tmp_path / "ck"), quarantine=str(tmp_path / "q"), attempts=4, sleep=waits.append).awaitTermination()
    assert I.dead_letters(e, str(tmp_path / "q")) == [0]
    assert waits == [0.25, 0.5, 1.0] and spark.read.parquet(str(tmp_path / "q" / "failed")).first().error == "down"
    assert I.delays()[-1] == 0.25 * 2**13


def test_streamed_triggers_and_cells(spark, tmp_path):
    rows = [[(t("2024-01-01T10:00:00"), (1.0,), [("owner", "a" if k % 3 else "b")]) for k in range(20)], [(t("2024-01-01T10:05:00"), (1.0,), [("owner", "a")]) for _ in range(20)]]
    stream = feed(spark, tmp_path / "in", rows)
    q = R.every_nth_stream(stream, R.owner_of()).writeStream.outputMode("append").format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "ck1")).trigger(availableNow=True).start()
    q.awaitTermination()
    fired = {r.key: r.n for r in spark.sql("select key, count(*) n from fired group by key").collect()}
    whole = events(spark, FIELDS, rows[0] + rows[1])
    assert fired == {r.key: r.triggers for r in R.every_nth(whole, R.owner_of()).collect() if r.triggers} == {"a": 3}
    c = R.running_cells(stream, "minute").writeStream.outputMode("update").format("memory").queryName("cells").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    c.awaitTermination()
    got = spark.sql("select max(value) v from cells where aggregation_type = 'SUM' and attribution_type = '_total' group by window").collect()
    assert [r.v for r in got] == [20.0, 20.0]
    d = I.deduped(stream.withColumn("uuid", F.lit("same"))).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "ck3")).trigger(availableNow=True).start()
    d.awaitTermination()
    assert spark.table("once").count() == 1


def test_subscriptions(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.record("src", events(spark, "deal_value:double", [(t("2024-01-01T10:00:00"), (500.0,)), (t("2024-01-01T11:00:00"), (50.0,))]), 0)
    sent = []
    low = R.Subscriber(Subscription("low", "threshold", "hour", (Condition("deal_value_sum", "LT", 100), Condition("test_event_count", "EQ", 1))), sent.append)
    data = lambda: e.get_dataset("r", DatasetQuery(DAY, "hour"))
    assert len(low.check(data())) == 1 and low.check(data()) == [] and sent[0]["deal_value_sum"] == 50
    done = R.Subscriber(Subscription("done", "completed", "hour"), sent.append)
    assert len(done.check(data())) == 2 and done.check(data()) == []
    with pytest.raises(ValueError):
        Subscription("x", "other", "hour")


def test_broadcast(spark):
    b, got = R.Broadcast(), []
    b.listen("report:updates:r", got.append)
    b.listen("report:updates:r", lambda m: 1 / 0)
    b.metrics_changed("r", spark.range(3))
    b.rollup_written("r")
    assert got == [{"type": "realtime:metrics", "changes": 3}, {"type": "aggregation:written"}] and len(b.listeners["report:updates:r"]) == 1


def test_quotas(spark):
    hits = spark.createDataFrame([("k", t(f"2024-01-01T10:00:00.{i}00000")) for i in range(4)], "key string, at timestamp")
    assert [tuple(r)[2:] for r in R.window_counts(hits, "key", "at", 2, "second").collect()] == [(2, 2)]
    assert sorted(r.rejected for r in R.over_quota(hits, "key", "at", 2, "second").collect()) == [False, False, True, True]
    assert R.window_counts(hits, "key", "at", 0, None).first().rejected == 0
