"""Definitions of sources, event types, reports, cubes and subscriptions.

With a store, every change is written there and a new registry over it begins with what it
finds; without one, definitions live as long as the object.
"""

from __future__ import annotations

import dataclasses

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeline.model import Condition, CubeDef, EventSource, Report, Retention, Subscription
from cubeline.plans.cache import Memo
from cubeline.plans.store import Store

#: Seconds for which definitions that are looked up by report are kept.
LOOKUP_TTL_S = 600


def local(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """Rows of the driver as a table whose size the optimiser knows."""
    cols = list(zip(*rows, strict=True)) or [()] * len(columns)
    return spark.createDataFrame(pa.table([pa.array(list(c), k) for c, k in zip(cols, columns.values(), strict=True)], names=list(columns)))


def _made(kind, d: dict | None):
    """A definition from its plain form."""
    if d is None:
        return None
    d = {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
    if d.get("retention"):
        d["retention"] = Retention(**d["retention"])
    if "conditions" in d:
        d["conditions"] = tuple(Condition(**c) for c in d["conditions"])
    return kind(**d)


class Registry:
    def __init__(self, store: Store | None = None):
        self.store = store
        self.sources: dict[str, EventSource] = {}
        self.types: dict[str, set[str]] = {}
        self.reports: dict[str, Report] = {}
        self.cubes: dict[str, CubeDef] = {}
        self.subscriptions: dict[str, dict[str, Subscription]] = {}
        self._lookups = Memo(LOOKUP_TTL_S)
        if store is not None:
            self.load()

    def load(self) -> None:
        """Take what the store holds in place of what is here."""
        d = self.store.get("registry", {})
        self.sources = {x["id"]: _made(EventSource, x) for x in d.get("sources", [])}
        self.types = {k: set(v) for k, v in d.get("types", {}).items()}
        self.reports = {x["name"]: _made(Report, x) for x in d.get("reports", [])}
        self.cubes = {x["name"]: _made(CubeDef, x) for x in d.get("cubes", [])}
        self.subscriptions = {r: {x["name"]: _made(Subscription, x) for x in xs} for r, xs in d.get("subscriptions", {}).items()}
        self._lookups.drop()

    def _changed(self) -> None:
        self._lookups.drop()
        if self.store is not None:
            plain = lambda xs: [dataclasses.asdict(x) for x in xs]
            self.store.put("registry", {
                "sources": plain(self.sources.values()), "types": {k: sorted(v) for k, v in self.types.items()}, "reports": plain(self.reports.values()),
                "cubes": plain(self.cubes.values()), "subscriptions": {r: plain(xs.values()) for r, xs in self.subscriptions.items()},
            })

    # --- sources and types --------------------------------------------------------------------

    def create_source(self, source: EventSource) -> EventSource:
        """The source of that name, made if there is none."""
        if any(s.name == source.name for s in self.sources.values()):
            return next(s for s in self.sources.values() if s.name == source.name)
        self.sources[source.id] = source
        self.types.setdefault(source.id, set())
        self._changed()
        return source

    def update_source(self, source_id: str, **changes) -> EventSource:
        self.sources[source_id] = dataclasses.replace(self.sources[source_id], **changes, id=source_id)
        self._changed()
        return self.sources[source_id]

    def create_event_type(self, source_id: str, name: str) -> None:
        if source_id not in self.sources:
            raise KeyError(f"no source {source_id}")
        if name not in self.types[source_id]:
            self.types[source_id].add(name)
            self._changed()

    def delete_source(self, source_id: str) -> None:
        """The source and its event types; its events are the engine's to drop."""
        del self.sources[source_id]
        self.types.pop(source_id, None)
        self._changed()

    # --- reports, cubes, subscriptions ----------------------------------------------------------

    def create_report(self, report: Report) -> Report:
        made = self.reports.setdefault(report.name, report)
        self._changed()
        return made

    def update_report(self, name: str, **changes) -> Report:
        self.reports[name] = dataclasses.replace(self.reports[name], **changes, name=name)
        self._changed()
        return self.reports[name]

    def delete_report(self, name: str) -> list[CubeDef]:
        """The report, its cubes and subscriptions; the cubes."""
        del self.reports[name]
        gone = [c for c in self.cubes.values() if c.report == name]
        for c in gone:
            del self.cubes[c.name]
        self.subscriptions.pop(name, None)
        self._changed()
        return gone

    def create_cube(self, cube: CubeDef) -> CubeDef:
        if cube.report not in self.reports:
            raise KeyError(f"no report {cube.report}")
        self.cubes[cube.name] = cube
        self._changed()
        return cube

    def update_cube(self, name: str, **changes) -> CubeDef:
        """Which events a cube takes and how long it keeps them; its granularity and partitions are what its cells have."""
        if fixed := {"granularity", "partitioned", "partition_length", "report", "name"} & changes.keys():
            raise ValueError(f"{', '.join(sorted(fixed))} of a cube can't change")
        self.cubes[name] = dataclasses.replace(self.cubes[name], **changes)
        self._changed()
        return self.cubes[name]

    def delete_cube(self, name: str) -> CubeDef:
        cube = self.cubes.pop(name)
        self._changed()
        return cube

    def subscribe(self, report: str, s: Subscription) -> None:
        if report not in self.reports:
            raise KeyError(f"no report {report}")
        self.subscriptions.setdefault(report, {})[s.name] = s
        self._changed()

    def unsubscribe(self, report: str, name: str) -> None:
        self.subscriptions.get(report, {}).pop(name, None)
        self._changed()

    # --- lookups ----------------------------------------------------------------------------------

    def cubes_of(self, report: str) -> list[CubeDef]:
        return self._lookups.get(("cubes", report), lambda: [c for c in self.cubes.values() if c.report == report])

    def active_cubes(self) -> list[CubeDef]:
        """The cubes whose report takes new events."""
        return self._lookups.get("active", lambda: [c for c in self.cubes.values() if self.reports[c.report].active])

    def owned_by(self, owner: str) -> list[EventSource]:
        return [s for s in self.sources.values() if owner in s.owners]

    # --- as tables ----------------------------------------------------------------------------------

    def types_table(self, spark: SparkSession) -> DataFrame:
        return local(spark, [(s, t) for s, ts in sorted(self.types.items()) for t in sorted(ts)], source_id=pa.string(), event_type=pa.string())

    def sources_table(self, spark: SparkSession) -> DataFrame:
        """source_id, name, owners."""
        return local(spark, [(s.id, s.name, list(s.owners)) for s in self.sources.values()], source_id=pa.string(), name=pa.string(), owners=pa.list_(pa.string()))

    def reports_table(self, spark: SparkSession) -> DataFrame:
        """report, active, owners."""
        return local(spark, [(r.name, r.active, list(r.owners)) for r in self.reports.values()], report=pa.string(), active=pa.bool_(), owners=pa.list_(pa.string()))

    def cubes_table(self, spark: SparkSession) -> DataFrame:
        """cube, report, granularity, sources, events."""
        rows = [(c.name, c.report, c.granularity, list(c.sources), list(c.events)) for c in self.cubes.values()]
        return local(spark, rows, cube=pa.string(), report=pa.string(), granularity=pa.string(), sources=pa.list_(pa.string()), events=pa.list_(pa.string()))


def owned(entities: DataFrame, owner: str) -> DataFrame:
    """The sources or reports that an owner owns."""
    return entities.where(F.array_contains("owners", owner))


def report_cubes(reports: DataFrame, cubes: DataFrame, only_active: bool = False) -> DataFrame:
    """report, cube, granularity: each report's cubes; of active reports alone if asked for."""
    r = reports.where("active") if only_active else reports
    return cubes.join(r.select("report"), "report").select("report", "cube", "granularity")
