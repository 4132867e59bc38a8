"""Definitions and queries as plain data, checked when made."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from cubeline.functions.granularity import to_ms

METRIC_TYPES = ("COUNT", "SUM", "CATEGORY", "BOOLEAN", "COMPOUND_SUM", "LEAF_SUM")
TOTAL = "_total"


def _range(r: tuple[dt.datetime, dt.datetime]) -> None:
    if len(r) != 2 or r[0] > r[1]:
        raise ValueError(f"not a time range: {r!r}")


@dataclass(frozen=True)
class Retention:
    hot_days: int
    offloader: str | None = None


@dataclass(frozen=True)
class EventSource:
    name: str
    id: str = ""
    owners: tuple[str, ...] = ()
    retention: Retention | None = None
    dedupe_days: int | None = None  # how far back known uuids are looked for; None: all that is stored

    def __post_init__(self):
        if not self.name:
            raise ValueError("a source needs a name")
        if not self.id:
            object.__setattr__(self, "id", self.name)


@dataclass(frozen=True)
class Report:
    name: str
    active: bool = True
    owners: tuple[str, ...] = ()


@dataclass(frozen=True)
class CubeDef:
    """A rollup of a report: where it is kept, at which granularity, of which events."""

    report: str
    name: str
    granularity: str = "minute"
    sources: tuple[str, ...] = ()  # none: all
    events: tuple[str, ...] = ()  # none: all
    partitioned: bool = False
    partition_length: int = 1_000_000
    retention: Retention | None = None

    def __post_init__(self):
        to_ms(self.granularity)
        if self.partition_length < 1:
            raise ValueError("partition_length must be positive")


#: Fields that plugins add to queries: name -> what checks a value (it raises ValueError).
EXTENSIONS: dict[str, Callable[[object], None]] = {}


def extend_queries(name: str, check: Callable[[object], None] = lambda v: None) -> None:
    """Let queries carry an optional field of a plugin, in `extensions`."""
    EXTENSIONS[name] = check


@dataclass(frozen=True)
class Scope:
    """What all query shapes have in common."""

    time_range: tuple[dt.datetime, dt.datetime]
    granularity: str = "hour"
    sources: tuple[str, ...] = ()
    events: tuple[str, ...] = ()
    attribution: tuple[str, str] | None = None
    filter: dict | None = None
    compute: dict[str, str] | None = None
    offset: int | None = None
    limit: int | None = None
    cache: bool | None = None
    rebuild_cache: bool = False
    extensions: dict[str, object] | None = None

    def __post_init__(self):
        _range(self.time_range)
        to_ms(self.granularity)
        for name, value in (self.extensions or {}).items():
            if name not in EXTENSIONS:
                raise ValueError(f"no plugin has added a query field {name!r}")
            EXTENSIONS[name](value)


@dataclass(frozen=True)
class ReportQuery(Scope):
    metric: str = "COUNT"
    field: str | None = None
    group_by: tuple[str, ...] = ()

    def __post_init__(self):
        super().__post_init__()
        if self.metric not in METRIC_TYPES:
            raise ValueError(f"unknown metric {self.metric!r}")


@dataclass(frozen=True)
class DatasetQuery(Scope):
    metrics: tuple[str, ...] = ()
    sort_by: str | None = None
    descending: bool = True


@dataclass(frozen=True)
class GroupsQuery(Scope):
    metrics: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    sort_by: str | None = None
    descending: bool = True


@dataclass(frozen=True)
class FlatGroupsQuery(Scope):
    metrics: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    sort_by: str | None = None
    group_by_granularity: tuple[str, ...] = ()
    binary_order: bool = False
    id_prefix: str = "ji"

    def __post_init__(self):
        super().__post_init__()
        sums = [m for m in self.metrics if not m.endswith("_count")]
        if len(sums) != 1:
            raise ValueError("flat groups need exactly one sum metric")
        if not self.group_by:
            raise ValueError("flat groups need group_by")
        if self.sort_by is not None and self.sort_by not in self.group_by:
            raise ValueError("sort_by must be one of group_by")
        for g in self.group_by_granularity:
            to_ms(g)

    @property
    def metric(self) -> str:
        return next(m for m in self.metrics if not m.endswith("_count"))


@dataclass(frozen=True)
class Condition:
    metric: str
    operator: str  # GT GTE LT LTE EQ
    value: float


@dataclass(frozen=True)
class Subscription:
    """Fires when all conditions hold on the latest point (threshold), or for each new bucket (completed)."""

    name: str
    kind: str
    granularity: str
    conditions: tuple[Condition, ...] = field(default=())
    events: tuple[str, ...] = ()

    def __post_init__(self):
        to_ms(self.granularity)
        if self.kind not in ("threshold", "completed"):
            raise ValueError(f"unknown subscription kind {self.kind!r}")
