"""What came in lately: admission, running series, triggers, counters and subscriptions."""

from __future__ import annotations

import datetime as dt
import json
import operator
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeline.functions.granularity import bucket, to_ms
from cubeline.functions.naming import base_field
from cubeline.model import Subscription
from cubeline.operators.fanout import DIMENSIONS, metric_rows


def admitted(events: DataFrame, age_s: int, now: Column | None = None) -> DataFrame:
    """Events no older than the buffer's age."""
    return events.where(F.col("ts") >= (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {age_s} SECONDS"))


def running_cells(stream: DataFrame, granularity: str, age: str = "5 minutes") -> DataFrame:
    """A stream of rollup cells, updated as events come; buckets leave the state once the watermark passes them."""
    # windows go by the raw time: what is computed from it carries no watermark, and would stay in the state for ever
    raw = stream.withColumn("at", F.col("ts")).withWatermark("at", age)
    rows = metric_rows(raw, granularity, kinds=("COUNT", "SUM", "CATEGORY", "COMPOUND_SUM", "LEAF_SUM"), carry=("at",))
    w = F.window("at", f"{to_ms(granularity)} milliseconds")
    return rows.groupBy(w, *[d for d in DIMENSIONS if d != "ts"]).agg(F.sum("value").alias("value"))


def owner_of(kind: str = "owner") -> Column:
    """The value of an event's attribution of a kind."""
    return F.get(F.transform(F.filter("attributions", lambda a: a["type"] == kind), lambda a: a["value"]), F.lit(0))


def every_nth(events: DataFrame, key: Column, n: int = 10) -> DataFrame:
    """key, triggers: how often a counter that fires at n and starts again has fired."""
    return events.select(key.alias("key")).where("key is not null").groupBy("key").agg(F.floor(F.count("*") / n).alias("triggers"))


def every_nth_stream(stream: DataFrame, key: Column, n: int = 10) -> DataFrame:
    """The same as a stream: a row (key, count n) each time a key's counter fires."""

    def count(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((seen % n,))
        yield pd.DataFrame({"key": [k[0]] * (seen // n), "count": [n] * (seen // n)})

    keyed = stream.select(key.alias("key")).where("key is not null")
    return keyed.groupBy("key").applyInPandasWithState(count, "key string, count long", "n long", "append", "NoTimeout")


def over_quota(hits: DataFrame, key: str, ts: str, quota: int, granularity: str | None) -> DataFrame:
    """hits with their number within the key's window (none: of all time) and whether that is over the quota.

    Of all time, hits are numbered day by day and each day begins where those before it end, so that a task
    gets a key's day and never its history.
    """
    grain = granularity or "day"
    at = bucket(F.col(ts), grain)
    n = F.row_number().over(Window.partitionBy(key, at).orderBy(ts, *[c for c in hits.columns if c not in (key, ts)]))
    out = hits.withColumn("hit", n)
    if granularity is None:
        days = hits.groupBy(F.col(key).alias("_key"), at.alias("_day")).agg(F.count("*").alias("_n"))
        before = Window.partitionBy("_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
        days = days.select("_key", "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        out = out.withColumn("_at", at).join(days, F.col(key).eqNullSafe(F.col("_key")) & F.col("_at").eqNullSafe(F.col("_day")))
        out = out.select(*hits.columns, (F.col("hit") + F.col("_before")).alias("hit"))
    return out.withColumn("rejected", F.col("hit") > quota if quota > 0 else F.lit(False))


def window_counts(hits: DataFrame, key: str, ts: str, quota: int, granularity: str | None) -> DataFrame:
    """accepted and rejected hits of each key and window, by counting alone."""
    by = [F.col(key).alias("key")] + ([bucket(F.col(ts), granularity, hits.schema[ts].dataType).alias("window")] if granularity else [])
    n = F.count("*")
    ok = F.least(n, F.lit(quota)) if quota > 0 else n
    return hits.groupBy(*by).agg(ok.alias("accepted"), (n - ok).alias("rejected"))


def usage(hits: DataFrame, key: str, ts: str, now: Column) -> DataFrame:
    """key, this_second, this_day, total up to now."""
    past = hits.where(F.col(ts) <= now)
    same = lambda g: F.sum((bucket(F.col(ts), g) == bucket(now, g)).cast("long"))
    return past.groupBy(F.col(key).alias("key")).agg(same("second").alias("this_second"), same("day").alias("this_day"), F.count("*").alias("total"))


def usage_events(hits: DataFrame, key: str, ts: str, status_code: Column, path: Column, method: Column, source_id: str = "api") -> DataFrame:
    """Requests as events of their own: type api_request, by owner, with the status in words and as a code."""
    code = status_code.cast("int")
    status = F.when(code < 400, "success").when(code == 429, "limited").otherwise("error")
    owner = F.col(key).cast("string")
    return hits.select(
        F.sha2(F.concat_ws("|", owner, F.col(ts).cast("string"), *[F.col(c).cast("string") for c in hits.columns]), 256).alias("uuid"), F.lit(source_id).alias("source_id"), F.lit("api_request").alias("event_type"),
        F.col(ts).alias("ts"), F.array(F.struct(F.lit("owner").alias("type"), owner.alias("value"))).alias("attributions"),
        F.struct(status.alias("status"), code.cast("string").alias("statusCode"), path.alias("path"), method.alias("method"), owner.alias("owner")).alias("payload"),
    )


_COMPARE = {"GT": operator.gt, "GTE": operator.ge, "LT": operator.lt, "LTE": operator.le, "EQ": operator.eq}


class Subscriber:
    """Watches the datasets of a report; told after each batch, it says what fires."""

    def __init__(self, subscription: Subscription, send: Callable[[dict], None], last: dt.datetime | None = None):
        self.s, self.send, self.last = subscription, send, last

    def check(self, dataset: DataFrame) -> list[dict]:
        """dataset: wide, of the current window or since the last check.  Each window fires once."""
        seen = dataset if self.last is None else dataset.where(F.col("timestamp") > F.lit(self.last))
        if self.s.kind == "threshold":
            row = seen.orderBy(F.desc("timestamp")).first()  # the latest point alone
            rows = [row] if row is not None and self._holds(row.asDict()) else []
        else:
            rows = seen.select("timestamp").distinct().orderBy("timestamp").collect()  # buckets since the last check
        fired = [{"subscription": self.s.name, "timestamp": r["timestamp"], **{c.metric: r.asDict().get(c.metric) for c in self.s.conditions}} for r in rows]
        for f in fired:
            self.last = f["timestamp"]
            self.send(f)
        return fired

    def _holds(self, row: dict) -> bool:
        values = [(c, row.get(c.metric, row.get(f"{base_field(c.metric)}_sum"))) for c in self.s.conditions]
        return all(v is not None and _COMPARE[c.operator](v, c.value) for c, v in values)


def webhook(url: str, timeout_s: float = 10) -> Callable[[dict], None]:
    """A sender that posts what fires as JSON."""

    def send(message: dict) -> None:
        body = json.dumps(message, default=lambda x: x.isoformat() if isinstance(x, dt.datetime) else str(x)).encode()
        urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout_s).close()

    return send


class Broadcast:
    """Tells its listeners of a channel about each batch; a listener that fails is dropped."""

    def __init__(self):
        self.listeners: dict[str, list[Callable[[dict], None]]] = {}

    def listen(self, channel: str, f: Callable[[dict], None]) -> None:
        self.listeners.setdefault(channel, []).append(f)

    def send(self, channel: str, message: dict) -> None:
        for f in list(self.listeners.get(channel, [])):
            try:
                f(message)
            except Exception:  # noqa: BLE001
                self.listeners[channel].remove(f)

    def metrics_changed(self, report: str, rows: DataFrame) -> None:
        self.send(f"report:updates:{report}", {"type": "realtime:metrics", "changes": rows.count()})

    def rollup_written(self, report: str) -> None:
        self.send(f"report:updates:{report}", {"type": "aggregation:written"})
