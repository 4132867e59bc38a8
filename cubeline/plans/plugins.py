"""Hooks: functions that see or change what passes through the engine.

A plugin is any object with methods of these names.  Waterfalls pass a value along, each
plugin getting what the one before it returned (None: unchanged); collectors add metric rows;
actions are told.  `before_metrics_written` may return (cells, cube) to send cells to another cube.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

WATERFALLS = ("before_event_record", "before_metrics_written", "before_realtime_metrics_written", "before_aggregate_generated", "after_aggregate_generated")
ACTIONS = ("on_engine_init", "on_engine_shutdown", "after_event_record", "after_metrics_written", "after_realtime_metrics_generated", "after_aggregation_written")
COLLECTORS = ("on_get_metrics",)


class PluginManager:
    def __init__(self, plugins=()):
        self.plugins = list(plugins)

    def _of(self, hook: str) -> list[Callable]:
        return [getattr(p, hook) for p in self.plugins if hasattr(p, hook)]

    def waterfall(self, hook: str, value, *about):
        for f in self._of(hook):
            new = f(value, *about)
            value = value if new is None else new
        return value

    def action(self, hook: str, *about) -> None:
        for f in self._of(hook):
            f(*about)

    def metrics(self, events: DataFrame) -> DataFrame | None:
        """The metric rows that plugins add, or None."""
        found = [x for f in self._of("on_get_metrics") if (x := f(events)) is not None]
        return reduce(lambda a, b: a.unionByName(b), found) if found else None

    def has_metrics(self) -> bool:
        return bool(self._of("on_get_metrics"))

    def register_methods(self, engine) -> None:
        """Methods that plugins add to the engine; what exists stays."""
        for f in self._of("register_engine_methods"):
            for name, method in f(engine).items():
                if hasattr(engine, name):
                    warnings.warn(f"method {name} exists already", stacklevel=2)
                else:
                    setattr(engine, name, method)


class Offloaders:
    """What takes expired partitions, by name."""

    def __init__(self):
        self.by_name: dict[str, Callable[[str, DataFrame], None]] = {}

    def register(self, name: str, f: Callable[[str, DataFrame], None]) -> None:
        if name in self.by_name:
            warnings.warn(f"offloader {name} is replaced", stacklevel=2)
        self.by_name[name] = f

    def get(self, name: str) -> Callable[[str, DataFrame], None]:
        return self.by_name[name]


def to_parquet(root: str) -> Callable[[str, DataFrame], None]:
    """An offloader that archives a cube's partitions as Parquet."""
    return lambda cube, df: df.write.mode("append").partitionBy("partition_idx").parquet(f"{root}/{cube}")
