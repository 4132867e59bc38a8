"""Names: stored names, metric keys and their labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(name: Column) -> Column:
    """Lower case, anything but letters, digits and _ replaced by _."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_")


def metric_key(kind: Column, event: Column, field: Column, group: Column, category: Column) -> Column:
    """The column of a dataset that a metric row adds to."""
    return (
        F.when(kind == "COUNT", F.concat(event, F.lit("_count")))
        .when(kind == "SUM", F.concat(field, F.lit("_sum")))
        .when(kind == "CATEGORY", F.concat(field, F.lit("_by_"), category))
        .when(kind == "COMPOUND_SUM", F.concat(field, F.lit("_sum_by_"), group, F.lit("_"), category))
    )


def label(key: str) -> str:
    """A heading for a metric key: words with capitals, what it is split by in brackets."""
    words = lambda s: " ".join(w[:1].upper() + w[1:] for w in re.split(r"[_\s]+", s) if w)
    if m := re.fullmatch(r"(.+)_sum_by_([^_]+)_(.+)", key):
        return f"{words(m[1])} Sum ({words(m[2])}: {m[3]})"
    if m := re.fullmatch(r"(.+)_by_(.+)", key):
        return f"{words(m[1])} ({m[2]})"
    return words(key)


def base_field(metric: str) -> str:
    """`amount_sum` and `amount` both mean the field amount."""
    return metric.removesuffix("_sum")
