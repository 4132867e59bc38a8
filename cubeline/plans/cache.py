"""Result cache of reports and datasets: whole results by query, or chunks of time by query kind.

Results are Parquet folders; what is kept here is where they are, of which range and since
when.  A result whose files are small (`IN_MEMORY` bytes) is also held as a local table after
its first reading, so that it is there again without a job over files.  The files of entries that
have expired or were replaced are deleted once no result that was handed out can still need them
(`GRACE_S`).  Chunks hold storage buckets, the atoms of a time range, so a chunk is cut to a request
exactly and gaps are half-open: nothing is counted twice.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeline.model import Scope

#: Bytes of files up to which a result is held in memory, and how many of such results are.
IN_MEMORY, MOST_IN_MEMORY = 1 << 20, 256
#: Seconds for which the files of entries that went are left.
GRACE_S = 3_600

Range = tuple[dt.datetime, dt.datetime]  # half-open
_HOW = ("cache", "rebuild_cache")


def _plain(v: object) -> object:
    if isinstance(v, dt.datetime):
        return (v - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1)
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, tuple | list) else v


def query_key(q: Scope, *, base: bool = False) -> str:
    """SHA-256 of the query as JSON with sorted keys; without how to cache, and for `base` without the time range."""
    d = {f.name: _plain(getattr(q, f.name)) for f in dataclasses.fields(q) if f.name not in _HOW and not (base and f.name == "time_range")}
    return hashlib.sha256(json.dumps({"kind": type(q).__name__, **d}, sort_keys=True).encode()).hexdigest()


def gaps(want: Range, have: list[Range]) -> list[Range]:
    """What of `want` no range of `have` covers."""
    out, at = [], want[0]
    for a, b in sorted(have):
        if b <= at or a >= want[1]:
            continue
        if a > at:
            out.append((at, a))
        at = max(at, b)
    if at < want[1]:
        out.append((at, want[1]))
    return out


@dataclass
class Entry:
    path: str
    made: float
    range: Range | None = None
    local: DataFrame | None = None


class ResultCache:
    def __init__(self, spark: SparkSession, root: str, ttl_s: float | None = None, controlled: bool = False, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.ttl, self.controlled, self.clock = spark, root, ttl_s, controlled, clock
        self.whole: dict[str, Entry] = {}
        self.chunks: dict[str, list[Entry]] = {}
        self._gone: list[tuple[float, str]] = []
        self._held = 0

    def _wanted(self, q: Scope) -> bool:
        return q.cache is True if self.controlled else q.cache is not False

    def _fresh(self, e: Entry) -> bool:
        return self.ttl is None or self.clock() - e.made <= self.ttl

    def _keep(self, df: DataFrame, r: Range | None = None) -> Entry:
        self._sweep()
        e = Entry(f"{self.root}/{uuid.uuid4().hex}", self.clock(), r)
        df.write.parquet(e.path)
        return e

    def _read(self, e: Entry) -> DataFrame:
        if e.local is not None:
            return e.local
        df = self.spark.read.parquet(e.path)
        if self._held < MOST_IN_MEMORY and sum(s.getLen() for s in self._files(e.path)) <= IN_MEMORY:
            e.local = self.spark.createDataFrame(df.toArrow())
            self._held += 1
            return e.local
        return df

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.listStatus(p) if fs.exists(p) else []

    def _drop(self, e: Entry) -> None:
        self._held -= e.local is not None
        e.local = None
        self._gone.append((self.clock(), e.path))

    def _sweep(self) -> None:
        """Expired entries go, and the files of those that went long enough ago."""
        for key in [k for k, e in self.whole.items() if not self._fresh(e)]:
            self._drop(self.whole.pop(key))
        for key, es in self.chunks.items():
            for e in [e for e in es if not self._fresh(e)]:
                es.remove(e)
                self._drop(e)
        left = []
        for since, path in self._gone:
            if self.clock() - since <= GRACE_S:
                left.append((since, path))
                continue
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self._gone = left

    def get(self, q: Scope, make: Callable[[], DataFrame]) -> DataFrame:
        """The kept result of q, else a new one, which is kept."""
        if not self._wanted(q):
            return make()
        key = query_key(q)
        e = self.whole.get(key)
        if e is None or q.rebuild_cache or not self._fresh(e):
            new = self._keep(make())
            if (old := self.whole.get(key)) is not None:
                self._drop(old)
            e = self.whole[key] = new
        return self._read(e)

    def get_chunked(self, q: Scope, want: Range, make: Callable[[Range], DataFrame]) -> DataFrame:
        """Rows of storage buckets (column timestamp) of `want`: kept chunks, each moment from one of them, and the gaps, which are kept if they have rows."""
        if not self._wanted(q):
            return make(want)
        key = query_key(q, base=True)
        kept = [] if q.rebuild_cache else [e for e in self.chunks.get(key, []) if self._fresh(e)]
        parts, covered = [], []
        for e in kept:
            for a, b in gaps((max(want[0], e.range[0]), min(want[1], e.range[1])), covered) if e.range[0] < want[1] and want[0] < e.range[1] else []:
                parts.append(self._read(e).where((F.col("timestamp") >= F.lit(a)) & (F.col("timestamp") < F.lit(b))))
                covered.append((a, b))
        if q.rebuild_cache:
            kept = [e for e in self.chunks.get(key, []) if e.range[1] <= want[0] or want[1] <= e.range[0]]
            for e in self.chunks.get(key, []):
                if e not in kept:
                    self._drop(e)
        for r in gaps(want, covered):
            e = self._keep(make(r), r)
            rows = self._read(e)
            parts.append(rows)
            if not rows.isEmpty():
                kept.append(e)
        self.chunks[key] = kept
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out


class Memo:
    """Definitions kept for a while."""

    def __init__(self, ttl_s: float, clock: Callable[[], float] = time.time):
        self.ttl, self.clock, self.kept = ttl_s, clock, {}

    def get(self, key, make):
        v = self.kept.get(key)
        if v is None or self.clock() - v[1] > self.ttl:
            v = self.kept[key] = (make(), self.clock())
        return v[0]

    def drop(self, key=None) -> None:
        self.kept.clear() if key is None else self.kept.pop(key, None)
