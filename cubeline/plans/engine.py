"""The engine: ingest, rollups and queries over one folder of tables.

Raw events are kept as `events/source_id=S/batch=N/month=M`, cells as `cubes/C/batch=S-N/partition_idx=K`,
what came in lately as `buffer/C/batch=S-N/until=T`.  All that is written for a batch replaces what the batch
held, so a batch may be repeated at any time: after a crash, after retention, after a cube was built anew.
Definitions and the few facts that say how folders are to be read are kept in the same root (`Store`), so an
engine that is started over it goes on where the last one was.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampNTZType

from cubeline.functions.filters import apply_filter
from cubeline.functions.formula import compute
from cubeline.functions.granularity import EPOCH, coarser, raw_range, to_ms
from cubeline.model import CubeDef, DatasetQuery, FlatGroupsQuery, GroupsQuery, ReportQuery, Scope, Subscription
from cubeline.operators import rollup, shapes
from cubeline.operators.fanout import accepts, metric_rows
from cubeline.plans.cache import ResultCache
from cubeline.plans.metadata import report_metadata
from cubeline.plans.plugins import Offloaders, PluginManager
from cubeline.plans.registry import Registry
from cubeline.plans.store import Store
from cubeline.sources import events as ev
from cubeline.streaming.realtime import Broadcast, Subscriber

#: Seconds after which an engine that hasn't said so is taken for gone.
HEARTBEAT_TTL_S = 30


def _utcnow() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


def _micros(t: dt.datetime) -> int:
    return (t - EPOCH) // dt.timedelta(microseconds=1)


class Engine:
    """`root` is a folder that the whole cluster shares.  `scale` makes sums exact to so many decimal places.

    `buffer_age_s` is how long metrics stay in the realtime buffer (None: there is none).
    """

    def __init__(
        self, spark: SparkSession, root: str, *, plugins=(), cache: ResultCache | None = None, partial_cache: bool = False, scale: int | None = None, buffer_age_s: int | None = 300,
        clock: Callable[[], dt.datetime] = _utcnow,
    ):
        self.spark, self.root, self.scale, self.buffer_age_s, self.clock = spark, root.rstrip("/"), scale, buffer_age_s, clock
        self.store = Store(spark, self.root)
        self.registry, self.plugins, self.offloaders, self.broadcast = Registry(self.store), PluginManager(plugins), Offloaders(), Broadcast()
        self.cache, self.partial_cache = cache, partial_cache
        self.instance = uuid.uuid4().hex
        self.plugins.register_methods(self)
        self.plugins.action("on_engine_init", self)

    def compute(self, df: DataFrame, spec: dict[str, str]) -> DataFrame:
        """Computed metrics over any result."""
        return compute(df, spec)

    def stats(self) -> DataFrame:
        """cube, n_cells, n_partitions, n_batches of the rollups there are."""
        out = None
        for c in self.registry.cubes.values():
            if self._exists(self.cube_path(c)):
                n = self._cells(c).agg(F.count("*").alias("n_cells"), F.countDistinct("partition_idx").alias("n_partitions"), F.countDistinct("batch").alias("n_batches"))
                n = n.select(F.lit(c.name).alias("cube"), "*")
                out = n if out is None else out.unionByName(n)
        return self.spark.createDataFrame([], "cube string, n_cells long, n_partitions long, n_batches long") if out is None else out

    def heartbeat(self) -> None:
        """Say that this engine is there."""
        self.store.put(f"heartbeat/{self.instance}", time.time())

    def instances(self, ttl_s: float = HEARTBEAT_TTL_S) -> int:
        """How many engines over this root have said so lately; those long gone are forgotten."""
        alive, now = 0, time.time()
        for name in self.store.names(f"{self.root}/_facts/heartbeat"):
            if now - self.store.get(f"heartbeat/{name}", 0) <= ttl_s:
                alive += 1
            else:
                self.store.delete(f"{self.root}/_facts/heartbeat/{name}")
        return alive

    def shutdown(self) -> None:
        """Results that were handed out are no longer there afterwards."""
        self.store.delete(f"{self.root}/results/{self.instance}")
        self.store.delete(f"{self.root}/_facts/heartbeat/{self.instance}")
        self.plugins.action("on_engine_shutdown", self)

    # --- events -----------------------------------------------------------------------------

    def _exists(self, path: str) -> bool:
        return self.store.exists(path)

    def _delete(self, path: str) -> None:
        self.store.delete(path)

    def _events_path(self, source_id: str) -> str:
        return f"{self.root}/events/source_id={source_id}"

    def _read_events(self, source_id: str, kind: StructType | None = None) -> DataFrame:
        """The stored events of a source that are still hot, with `batch` and `month`; `kind`: a wider schema to read them by."""
        stored = kind or StructType.fromJson(self.store.get(f"schema/{source_id}"))
        df = self.spark.read.schema(stored.add("batch", "long").add("month", "date")).option("basePath", self._events_path(source_id)).parquet(self._events_path(source_id))
        df = df.withColumn("source_id", F.lit(source_id))
        hot = self.store.get(f"hot/{source_id}")
        if hot is not None:
            edge = EPOCH + dt.timedelta(microseconds=hot)
            df = df.where((F.col("month") >= F.lit(edge.date().replace(day=1))) & (F.col("ts") >= F.lit(edge)))
        return df

    def events(self, source_id: str | None = None) -> DataFrame:
        """The stored raw events, of one source or all, with the number of their batch."""
        ids = [source_id] if source_id is not None else [n.partition("=")[2] for n in self.store.names(f"{self.root}/events") if n.startswith("source_id=")]
        kinds = [StructType.fromJson(self.store.get(f"schema/{i}")) for i in ids]
        if not ids:
            raise LookupError("no events are stored")
        kind = kinds[0]
        for k in kinds[1:]:
            kind = _wider(kind, k)
        out = None
        for i in ids:
            part = self._read_events(i, StructType(list(kind.fields))).drop("month")
            out = part if out is None else out.unionByName(part)
        return out

    def _write_events(self, source_id: str, fresh: DataFrame, batch: int) -> DataFrame:
        """Write a batch by months, in place of what it held; the batch as it is now stored."""
        kind = fresh.drop("source_id").schema
        known = self.store.get(f"schema/{source_id}")
        wider = kind if known is None else _wider(StructType.fromJson(known), kind)
        if known is None or wider.jsonValue() != known:
            self.store.put(f"schema/{source_id}", wider.jsonValue())
        mine = f"{self._events_path(source_id)}/batch={batch}"
        fresh.drop("source_id").withColumn("month", F.trunc("ts", "month")).write.mode("overwrite").partitionBy("month").parquet(mine)
        return self.spark.read.schema(kind).parquet(mine).select(*kind.names, F.lit(source_id).alias("source_id"))

    def record(self, source_id: str, new: DataFrame, batch: int) -> DataFrame:
        """Take events in: checked types, no uuid twice, ts now by default; then every cube that wants them.

        Repeating a batch replaces what it wrote.  The rows that came in anew are returned.  A source
        with `dedupe_days` looks for known uuids only that far before the batch's first event.
        What comes in is staged once, so a stream's batch is evaluated once and its size is known.
        """
        if source_id not in self.registry.sources:
            raise KeyError(f"no source {source_id}")
        new = new.withColumn("source_id", F.lit(source_id)).withColumn("ts", ev.with_default_ts(F.col("ts")))
        new = self.plugins.waterfall("before_event_record", new, source_id)
        staging = f"{self.root}/staging/{source_id}-{batch}"
        try:
            new.write.mode("overwrite").parquet(staging)
            staged = self.spark.read.schema(new.schema).parquet(staging)
            ev.require_types(staged, self.registry.types_table(self.spark))
            stored = None
            if self._exists(self._events_path(source_id)) and self.store.get(f"schema/{source_id}") is not None:
                stored = self._read_events(source_id).where(F.col("batch") != batch)
                days = self.registry.sources[source_id].dedupe_days
                if days is not None and (first := staged.agg(F.min(F.to_date("ts"))).first()[0]) is not None:
                    stored = stored.where((F.col("month") >= F.lit((first - dt.timedelta(days=days)).replace(day=1))) & (F.col("ts") >= F.lit(first - dt.timedelta(days=days))))
                stored = stored.select("source_id", "uuid")
            kept = self._write_events(source_id, ev.dedupe(staged, stored), batch)
        finally:
            self._delete(staging)
        for cube in self.registry.active_cubes():
            self.roll(cube, kept, f"{source_id}-{batch}")
        self._buffer(kept, f"{source_id}-{batch}")
        self.plugins.action("after_event_record", kept, source_id)
        return kept

    def recent(self, source_id: str, limit: int = 20) -> DataFrame:
        return ev.recent(self.events(source_id), source_id, limit)

    def counts(self) -> DataFrame:
        return ev.raw_counts(self.events(), self.registry.sources_table(self.spark))

    def delete_source(self, source_id: str) -> None:
        self.registry.delete_source(source_id)
        self._delete(self._events_path(source_id))
        for fact in ("schema", "hot"):
            self._delete(f"{self.root}/_facts/{fact}/{source_id}")

    def delete_report(self, name: str) -> None:
        for cube in self.registry.delete_report(name):
            self._drop_cube(cube)

    def _drop_cube(self, cube: CubeDef) -> None:
        for path in (self.cube_path(cube), f"{self.root}/buffer/{cube.name}", f"{self.root}/_facts/live/{cube.name}"):
            self._delete(path)

    # --- rollups ----------------------------------------------------------------------------

    def cube_path(self, cube: CubeDef) -> str:
        return f"{self.root}/cubes/{cube.name}"

    def _live(self, cube: CubeDef) -> dict:
        """What compaction left: the name of the summed batch, and of each source the last batch in it."""
        return self.store.get(f"live/{cube.name}", {"sum": None, "upto": {}})

    def _batches(self, cube: CubeDef) -> list[str]:
        """The batches of a cube that count: the summed one, and those that are not in it."""
        live = self._live(cube)
        out = []
        for n in self.store.names(self.cube_path(cube)):
            name = n.partition("=")[2]
            if not n.startswith("batch="):
                continue
            if name.startswith("sum-"):
                out += [name] if name == live["sum"] else []
            else:
                source, _, number = name.rpartition("-")
                out += [name] if not (number.isdigit() and int(number) <= live["upto"].get(source, -1)) else []
        return out

    def _ts_kind(self) -> str:
        """The type of the times of stored events."""
        for n in self.store.names(f"{self.root}/_facts/schema"):
            kind = StructType.fromJson(self.store.get(f"schema/{n}"))["ts"].dataType
            return "timestamp_ntz" if isinstance(kind, TimestampNTZType) else "timestamp"
        return "timestamp"

    def _cells(self, cube: CubeDef) -> DataFrame:
        return rollup.read(self.spark, self.cube_path(cube), self._batches(cube), self._ts_kind())

    def roll(self, cube: CubeDef, events: DataFrame, batch: str) -> None:
        """Add a batch of events to a cube.  A batch that a compaction has summed is in it for good."""
        if cube.sources and not any(s in cube.sources for s in self.registry.sources):
            return
        source, _, number = batch.rpartition("-")
        if number.isdigit() and int(number) <= self._live(cube)["upto"].get(source, -1):
            return
        cells = rollup.build(events, cube, self.scale, self._more())
        cells, target = self._redirected(cells, cube)
        rollup.write_batch(cells, self.cube_path(target), batch)
        self.plugins.action("after_metrics_written", target, batch)
        self.plugins.action("after_aggregation_written", target, batch)
        self.broadcast.rollup_written(target.report)

    def _more(self) -> Callable[[DataFrame], DataFrame] | None:
        return self.plugins.metrics if self.plugins.has_metrics() else None

    def _redirected(self, cells: DataFrame, cube: CubeDef) -> tuple[DataFrame, CubeDef]:
        """What plugins make of the cells; one that returns (cells, cube) sends them to another cube."""
        made = self.plugins.waterfall("before_metrics_written", cells, cube)
        return made if isinstance(made, tuple) else (made, cube)

    def rows(self, cube: CubeDef, q: Scope) -> DataFrame:
        """The cells of a cube that a query may touch."""
        return rollup.pruned(self._cells(cube), cube, *q.time_range).drop("batch", "partition_idx")

    def reprocess(self, cube: CubeDef, start: dt.datetime, end: dt.datetime) -> None:
        """Build a cube anew for the partitions that a range touches, from raw events: the same however often it is done.

        Each batch's cells are written in place of what it had there, so a batch that is repeated later
        replaces its own.  What breaks off in between leaves some partitions old, and is mended by doing it again.
        A range whose raw events retention has dropped can't be built.
        """
        everything = self.events().where(accepts(cube))
        lo, hi = (rollup.ordinal_of(t, cube.granularity, cube.partition_length) for t in (start, end))
        for s in self.registry.sources:
            hot = self.store.get(f"hot/{s}")
            edge = None if hot is None else rollup.ordinal_of(EPOCH + dt.timedelta(microseconds=hot), cube.granularity, cube.partition_length)
            if edge is not None and (not cube.partitioned or lo <= edge) and (not cube.sources or s in cube.sources):
                raise ValueError(f"events of source {s} in that range are no longer kept")
        inside = rollup.partition_of(cube).between(lo, hi) if cube.partitioned else F.lit(True)
        live, path = self._live(cube), self.cube_path(cube)
        name = F.concat_ws("-", "source_id", F.col("batch").cast("string"))
        for source, last in live["upto"].items():
            name = F.when((F.col("source_id") == source) & (F.col("batch") <= last), F.lit(live["sum"])).otherwise(name)
        named = everything.where(inside).withColumn("batch", name)
        more = (lambda e: self._named_metrics(e)) if self.plugins.has_metrics() else None
        cells = rollup.build(named, cube, self.scale, more, carry=("batch",))
        cells, target = self._redirected(cells, cube)
        path = self.cube_path(target)
        staged = f"{self.root}/staging/cube-{target.name}"
        try:
            rollup.replace_partitions(cells, staged)
            made = {(b, p) for b in self.store.names(staged) if b.startswith("batch=") for p in self.store.names(f"{staged}/{b}")}
            if made:
                kind = rollup.SCHEMA.format(ts=self._ts_kind())
                rollup.replace_partitions(self.spark.read.schema(kind).option("basePath", staged).parquet(staged), path)
            for b in self.store.names(path):  # partitions that have no cells any more
                for p in self.store.names(f"{path}/{b}") if b.startswith("batch=") else []:
                    idx = p.partition("=")[2]
                    if p.startswith("partition_idx=") and (not cube.partitioned or lo <= int(idx) <= hi) and (b, p) not in made:
                        self._delete(f"{path}/{b}/{p}")
        finally:
            self._delete(staged)
        self.plugins.action("after_aggregation_written", target, "reprocess")
        self.broadcast.rollup_written(target.report)

    def _named_metrics(self, events: DataFrame) -> DataFrame:
        """Plugins' metric rows apart for each batch: a plugin sees the events of one batch at a time."""
        out = None
        for r in events.select("batch").distinct().collect():  # batches since the last compaction
            rows = self.plugins.metrics(events.where(F.col("batch") == r.batch)).withColumn("batch", F.lit(r.batch))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.plugins.metrics(events).withColumn("batch", F.lit(""))

    def compact(self, cube: CubeDef, keep: int = 1) -> int:
        """Sum a cube's batches into one, but for the last `keep` of each source, which a stream may repeat; how many were summed.

        The new batch counts from the moment its fact is put; the old ones are deleted after that.
        """
        live, path = self._live(cube), self.cube_path(cube)
        numbers: dict[str, list[int]] = {}
        for b in self._batches(cube):
            source, _, number = b.rpartition("-")
            if not b.startswith("sum-") and number.isdigit():
                numbers.setdefault(source, []).append(int(number))
        gone = {s: sorted(ns)[: len(ns) - keep] for s, ns in numbers.items() if len(ns) > keep}
        old = [f"{s}-{n}" for s, ns in gone.items() for n in ns] + ([live["sum"]] if live["sum"] else [])
        if not gone:
            return 0
        new = f"sum-{uuid.uuid4().hex}"
        rollup.write_batch(rollup.compacted(rollup.read(self.spark, path, old, self._ts_kind()), self.scale), path, new)
        self.store.put(f"live/{cube.name}", {"sum": new, "upto": live["upto"] | {s: ns[-1] for s, ns in gone.items()}})
        for b in old:
            self._delete(f"{path}/batch={b}")
        return len(old)

    def apply_retention(self, now: dt.datetime) -> dict[str, list[int]]:
        """Drop what is no longer hot: raw events of sources and partitions of cubes, offloaded first if a cube says so.

        Events before the edge count no longer from the moment its fact is put; the months before it are then
        deleted as whole folders, and nothing is written again.  Batches keep their numbers, so one that is
        repeated still replaces its own.
        """
        for s in self.registry.sources.values():
            path = self._events_path(s.id)
            if s.retention is not None and self._exists(path):
                edge = rollup.hot_since(now, s.retention.hot_days)
                if _micros(edge) > self.store.get(f"hot/{s.id}", -(2**63)):
                    self.store.put(f"hot/{s.id}", _micros(edge))
                for b in self.store.names(path):
                    for d in self.store.names(f"{path}/{b}") if b.startswith("batch=") else []:
                        if d.startswith("month=") and d.partition("=")[2] < edge.date().replace(day=1).isoformat():
                            self._delete(f"{path}/{b}/{d}")
        gone = {}
        for c in self.registry.cubes.values():
            if c.retention is not None and self._exists(self.cube_path(c)):
                send = self.offloaders.get(c.retention.offloader) if c.retention.offloader else None
                gone[c.name] = rollup.expire(self._cells(c), self.cube_path(c), c, now, self.store, (lambda df, n=c.name, f=send: f(n, df)) if send else None)
        return gone

    # --- queries ----------------------------------------------------------------------------

    def _cubes(self, report: str, q: Scope, grains: tuple[str, ...]) -> list[CubeDef]:
        """The cubes that answer a query: of those that take the same events, the coarsest whose buckets the query's are made of.

        If none is fine enough, the finest answers, at its own granularity.  A cube all of whose events another
        one has too is left out.  With `grains`, all cubes of these.
        """
        return self._chosen([c for c in self.registry.cubes_of(report) if self._exists(self.cube_path(c))], q, grains)

    @staticmethod
    def _chosen(have: list[CubeDef], q: Scope, grains: tuple[str, ...]) -> list[CubeDef]:
        if grains:
            return [c for c in have if c.granularity in grains]
        best: dict[tuple, CubeDef] = {}
        for c in sorted(have, key=lambda c: to_ms(c.granularity)):
            key = (frozenset(c.sources), frozenset(c.events))
            if key not in best or rollup.answers(c, q.granularity):
                best[key] = c
        covers = lambda a, b: not a or (bool(b) and a >= b)
        return [c for k, c in best.items() if not any(j != k and covers(j[0], k[0]) and covers(j[1], k[1]) for j in best)]

    def _from_cubes(self, report: str, q: Scope, grains: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
        """The rows of the cubes that answer as one table, and their granularity (the coarsest of them)."""
        cubes = self._cubes(report, q, grains)
        if not cubes:
            raise LookupError(f"report {report} has no rollup")
        out = None
        for c in cubes:
            part = self.rows(c, q)
            if c.sources:
                part = part.where(F.col("source_id").isin(*c.sources))
            if c.events:
                part = part.where(F.col("event_type").isin(*c.events))
            out = part if out is None else out.unionByName(part)
        return out, max((c.granularity for c in cubes), key=to_ms)

    def _asked(self, q: Scope, report: str) -> Scope:
        return self.plugins.waterfall("before_aggregate_generated", q, report)

    def _finish(self, df: DataFrame, q: Scope, order: str | None = None) -> DataFrame:
        """Computed metrics first, so that filters see them; then offset and limit."""
        df = self.plugins.waterfall("after_aggregate_generated", compute(df, q.compute) if q.compute else df, q)
        return apply_filter(df, q.filter, q.offset, q.limit)

    def _cached(self, q: Scope, storage: str, make: Callable[[Scope], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """make: rows of storage buckets; merge: to the query's buckets."""
        if self.cache is None:
            return merge(make(q))
        if not self.partial_cache:
            return self.cache.get(q, lambda: merge(make(q)))
        us = dt.timedelta(microseconds=1)
        return merge(self.cache.get_chunked(q, raw_range(*q.time_range, storage), lambda r: make(dataclasses.replace(q, time_range=(r[0], r[1] - us)))))

    def get_report(self, report: str, q: ReportQuery) -> DataFrame:
        q = self._asked(q, report)
        rows, storage = self._from_cubes(report, q)
        return self._finish(self._report(rows, q, storage).orderBy("timestamp"), q)

    def _report(self, rows: DataFrame, q: ReportQuery, storage: str) -> DataFrame:
        fine = lambda p: shapes.report_from_rows(rows, dataclasses.replace(p, granularity=storage), storage, self.scale)
        return self._cached(q, storage, fine, lambda df: self._again(df, q, storage, [c for c in ("category",) if c in df.columns]))

    def _again(self, df: DataFrame, q: Scope, storage: str, keys: list[str]) -> DataFrame:
        at = shapes.bucket(F.col("timestamp"), coarser(q.granularity, storage), df.schema["timestamp"].dataType).alias("timestamp")
        return df.select(at, *keys, "value").groupBy("timestamp", *keys).agg(rollup.exact_sum(F.col("value"), self.scale).alias("value"))

    def get_dataset(self, report: str, q: DatasetQuery) -> DataFrame:
        q = self._asked(q, report)
        rows, storage = self._from_cubes(report, q)
        return self._finish(self._dataset(rows, q, storage), q)

    def _dataset(self, rows: DataFrame, q: DatasetQuery, storage: str) -> DataFrame:
        fine = lambda p: shapes.dataset_long(shapes.scoped_rows(rows, p), dataclasses.replace(p, granularity=storage), storage, self.scale)
        long = self._cached(q, storage, fine, lambda df: self._again(df, q, storage, ["metric_key"]))
        wide = shapes.dataset_wide(self._settled(long))
        facts = shapes.boolean_groups_from_rows(rows, q, storage)
        return shapes.ordered(wide.join(facts, "timestamp", "full"), q.sort_by, q.descending)

    def _settled(self, long: DataFrame) -> DataFrame:
        """A long result as a table that is there: its keys and its pivot are then not two times the work."""
        if self.cache is not None:
            return long
        path = f"{self.root}/results/{self.instance}/{uuid.uuid4().hex}"
        long.write.parquet(path)
        return self.spark.read.schema(long.schema).parquet(path)

    def get_groups(self, report: str, q: GroupsQuery) -> DataFrame:
        q = self._asked(q, report)
        rows, storage = self._from_cubes(report, q)
        return self._finish(shapes.groups_nested(shapes.groups_long_from_rows(rows, q, storage, self.scale), q), q)

    def get_flat_groups(self, report: str, q: FlatGroupsQuery) -> DataFrame:
        q = self._asked(q, report)
        rows, _ = self._from_cubes(report, q, q.group_by_granularity or (q.granularity,))
        return self._finish(shapes.flat_groups_from_rows(rows, q, self.scale), q)

    def metadata(self, report: str) -> DataFrame:
        cubes = self.registry.cubes_of(report)
        names = {s for c in cubes for s in c.sources}
        return report_metadata(self.events(), tuple(sorted(names)) if all(c.sources for c in cubes) else ())

    # --- the same over what came in lately ----------------------------------------------------

    def _buffer(self, events: DataFrame, batch: str) -> None:
        """Keep the metric rows of events no older than the buffer's age, and drop the batches that are."""
        if self.buffer_age_s is None:
            return
        from cubeline.streaming.realtime import admitted

        now = self.clock()
        young = admitted(events, self.buffer_age_s, F.lit(now))
        last = young.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
        for c in self.registry.active_cubes():
            path = f"{self.root}/buffer/{c.name}"
            self._delete(f"{path}/batch={batch}")
            for b in self.store.names(path):
                for u in self.store.names(f"{path}/{b}"):
                    if u.startswith("until=") and int(u.partition("=")[2]) < _micros(now) - self.buffer_age_s * 1_000_000:
                        self._delete(f"{path}/{b}")
            if last is None:
                continue
            rows = metric_rows(young.where(accepts(c)), c.granularity, more=self._more())
            rows = self.plugins.waterfall("before_realtime_metrics_written", rows, c)
            made = f"{path}/batch={batch}/until={last}"
            rows.write.mode("overwrite").parquet(made)
            stored = self.spark.read.schema(rows.schema).parquet(made)
            self.plugins.action("after_realtime_metrics_generated", c.report, stored)
            self.broadcast.metrics_changed(c.report, stored)

    def buffered(self, report: str, cubes: list[CubeDef] | None = None) -> DataFrame:
        """The metric rows in the buffer, of all of a report's cubes or of those given."""
        if self.buffer_age_s is None:
            raise LookupError("this engine has no realtime buffer")
        now, out = self.clock(), None
        kind = ", ".join(x for x in rollup.SCHEMA.format(ts=self._ts_kind()).split(", ") if not x.startswith(("batch", "partition_idx")))
        for c in self.registry.cubes_of(report) if cubes is None else cubes:
            path = f"{self.root}/buffer/{c.name}"
            if not self.store.names(path):
                continue
            part = self.spark.read.schema(kind + ", until long").option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
            part = part.where(F.col("until") >= _micros(now) - self.buffer_age_s * 1_000_000).drop("until")
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], kind) if out is None else out

    def realtime_rows(self, report: str, q: Scope, buffer: DataFrame | None = None, grains: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
        """Metric rows of the cubes that answer a query, and their granularity: those of the stored buffer, or of events handed in."""
        cubes = self._chosen(self.registry.cubes_of(report), q, grains)
        if not cubes:
            raise LookupError(f"report {report} has no rollup")
        out = self.buffered(report, cubes) if buffer is None else None
        if buffer is not None:
            for c in cubes:
                part = metric_rows(buffer.where(accepts(c)), c.granularity, more=self._more())
                out = part if out is None else out.unionByName(part)
            self.plugins.action("after_realtime_metrics_generated", report, out)
        return out, max((c.granularity for c in cubes), key=to_ms)

    def realtime_report(self, report: str, q: ReportQuery, buffer: DataFrame | None = None) -> DataFrame:
        q = self._asked(q, report)
        rows, storage = self.realtime_rows(report, q, buffer)
        return self._finish(shapes.report_from_rows(rows, q, storage, self.scale).orderBy("timestamp"), q)

    def realtime_dataset(self, report: str, q: DatasetQuery, buffer: DataFrame | None = None) -> DataFrame:
        q = self._asked(q, report)
        rows, storage = self.realtime_rows(report, q, buffer)
        wide = shapes.dataset_wide(self._settled(shapes.dataset_long(shapes.scoped_rows(rows, q), q, storage, self.scale)))
        return self._finish(shapes.ordered(wide.join(shapes.boolean_groups_from_rows(rows, q, storage), "timestamp", "full"), q.sort_by, q.descending), q)

    def realtime_groups(self, report: str, q: GroupsQuery, buffer: DataFrame | None = None) -> DataFrame:
        q = self._asked(q, report)
        rows, storage = self.realtime_rows(report, q, buffer)
        return self._finish(shapes.groups_nested(shapes.groups_long_from_rows(rows, q, storage, self.scale), q, fill=True), q)

    def realtime_flat_groups(self, report: str, q: FlatGroupsQuery, buffer: DataFrame | None = None) -> DataFrame:
        q = self._asked(q, report)
        rows, _ = self.realtime_rows(report, q, buffer, q.group_by_granularity or (q.granularity,))
        return self._finish(shapes.flat_groups_from_rows(rows, q, self.scale), q)

    # --- subscriptions --------------------------------------------------------------------------

    def notify(self, report: str, send: Callable[[dict], None], since: dt.datetime, now: dt.datetime | None = None) -> list[dict]:
        """Look at a report's subscriptions and send what fires.  What has fired is remembered, by engines to come too."""
        now, fired = now or self.clock(), []
        for s in list(self.registry.subscriptions.get(report, {}).values()):
            fact = f"fired/{report}/{s.name}"
            last = self.store.get(fact)
            watch = Subscriber(s, send, None if last is None else EPOCH + dt.timedelta(microseconds=last))
            fired += watch.check(self._watched(report, s, since, now))
            if watch.last is not None and _micros(watch.last) != last:
                self.store.put(fact, _micros(watch.last))
        return fired

    def _watched(self, report: str, s: Subscription, since: dt.datetime, now: dt.datetime) -> DataFrame:
        q = DatasetQuery((since, now), s.granularity, events=s.events, cache=False)
        rows, storage = self._from_cubes(report, q)
        return shapes.dataset_wide(self._settled(shapes.dataset_long(shapes.scoped_rows(rows, q), q, storage, self.scale)))


def _wider(a: StructType, b: StructType) -> StructType:
    """A schema that both read as: the columns and payload fields of either."""
    out = StructType()
    theirs = {f.name: f for f in b.fields}
    for f in a.fields:
        g = theirs.pop(f.name, None)
        if g is None or g.dataType == f.dataType:
            out.add(StructField(f.name, f.dataType, True))
        elif isinstance(f.dataType, StructType) and isinstance(g.dataType, StructType):
            out.add(StructField(f.name, _wider(f.dataType, g.dataType), True))
        elif f.dataType.simpleString() == g.dataType.simpleString():
            out.add(StructField(f.name, f.dataType, True))
        else:
            raise ValueError(f"column {f.name} is {f.dataType.simpleString()} and {g.dataType.simpleString()}")
    for f in b.fields:
        if f.name in theirs:
            out.add(StructField(f.name, f.dataType, True))
    return out
