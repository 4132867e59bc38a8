"""Time buckets: granularities, truncation, partition ordinals, relative periods.

All are UTC.  Every permitted granularity divides its parent unit or counts whole epoch days,
so each bucket is ``t - t mod g`` on the epoch.  Sessions must run in UTC, as timestamps
without zone are read as such.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

_UNIT_MS = {"ms": 1, "second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
# The permitted granularities.
GRANULARITIES = (
    "100ms", "200ms", "250ms", "500ms", "second", "minute", "5minute", "10minute", "15minute", "30minute", "hour", "2hour", "4hour", "6hour", "12hour",
    "day", "3day", "7day", "15day", "30day", "45day", "60day", "90day",
)
EPOCH = dt.datetime(1970, 1, 1)


def to_ms(granularity: str) -> int:
    """Milliseconds of a granularity; anything else (a list too) is refused."""
    if not isinstance(granularity, str) or granularity not in GRANULARITIES:
        raise ValueError(f"unknown granularity {granularity!r}")
    n, unit = re.fullmatch(r"(\d*)([a-z]+)", granularity).groups()
    return int(n or 1) * _UNIT_MS[unit]


def coarser(a: str, b: str) -> str:
    """A query can't be finer than what is stored."""
    return a if to_ms(a) >= to_ms(b) else b


def bucket(ts: Column, granularity: str, kind: DataType | None = None) -> Column:
    """Start of the bucket that holds ts; a timestamp without zone if `kind` says so."""
    us = F.unix_micros(ts.cast("timestamp"))
    start = F.timestamp_micros(us - F.pmod(us, F.lit(to_ms(granularity) * 1000)))
    return start.cast("timestamp_ntz") if isinstance(kind, TimestampNTZType) else start


def truncate(t: dt.datetime, granularity: str) -> dt.datetime:
    us = (t - EPOCH) // dt.timedelta(microseconds=1)
    return EPOCH + dt.timedelta(microseconds=us - us % (to_ms(granularity) * 1000))


def raw_range(start: dt.datetime, end: dt.datetime, storage: str) -> tuple[dt.datetime, dt.datetime]:
    """The half-open range of raw times whose storage bucket lies within [start, end].

    The range of a query counts both ends and applies to stored buckets; as a plain range of
    ts it reaches the file scan.
    """
    g = dt.timedelta(milliseconds=to_ms(storage))
    low = truncate(start, storage)
    return (low if low == start else low + g), truncate(end, storage) + g


def ordinal(ts: Column, granularity: str, length: int) -> Column:
    """Number of the partition of `length` buckets that holds ts."""
    return F.floor(F.unix_millis(ts.cast("timestamp")) / F.lit(to_ms(granularity) * length)).cast("long")


def ordinal_of(t: dt.datetime, granularity: str, length: int) -> int:
    return ((t - EPOCH) // dt.timedelta(milliseconds=1)) // (to_ms(granularity) * length)


def partition_name(prefix: str, index: int) -> str:
    return f"{prefix}_{index}"


def ordinals_between(start: dt.datetime, end: dt.datetime, granularity: str, length: int) -> range:
    """All partitions that a range touches, both ends counted."""
    return range(ordinal_of(start, granularity, length), ordinal_of(end, granularity, length) + 1)


def period(text: str, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """`6h`, `3d`, `2w`, `1m` (30 days) back from now, or `custom:<start>_<end>` in ISO times."""
    if text.startswith("custom:"):
        a, _, b = text.removeprefix("custom:").partition("_")
        return tuple(dt.datetime.fromisoformat(x.replace("Z", "+00:00")).replace(tzinfo=None) for x in (a, b))
    m = re.fullmatch(r"(\d+)([hdwm])", text)
    if not m:
        raise ValueError(f"unknown period {text!r}")
    hours = {"h": 1, "d": 24, "w": 168, "m": 720}[m[2]]
    return now - dt.timedelta(hours=int(m[1]) * hours), now
