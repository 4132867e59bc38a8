"""What a report can show: metrics, fields to group by, sources and event types, found in the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeline.operators.fanout import _arrays


def catalogue(events: DataFrame) -> DataFrame:
    """source_id, kind, name: distinct metrics (`<number>_sum`, `<type>_count`), groupable fields and event types of each source.

    Booleans aren't listed.  Distinct names are found within tasks first; what is shuffled is names.
    """
    numbers, categories, booleans = _arrays(events)
    named = lambda kind, names: F.transform(names, lambda n: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("name"), n))
    truly = F.array_except(F.transform("_c", lambda e: e["k"]), F.transform("_b", lambda e: e["k"]))
    return (
        events.select("source_id", "event_type", numbers.alias("_n"), categories.alias("_c"), booleans.alias("_b"))
        .select("source_id", F.inline(F.concat(
            named("metric", F.concat(F.transform("_n", lambda e: F.concat(e["k"], F.lit("_sum"))), F.array(F.concat("event_type", F.lit("_count"))))),
            named("field", truly), named("event_type", F.array("event_type")),
        ))).distinct()
    )


def report_metadata(events: DataFrame, sources: tuple[str, ...] = ()) -> DataFrame:
    """kind, names: the union over a report's sources (none named: all)."""
    e = events.where(F.col("source_id").isin(*sources)) if sources else events
    c = catalogue(e)
    own = c.select(F.lit("source").alias("kind"), F.col("source_id").alias("name"))
    return c.select("kind", "name").unionByName(own).groupBy("kind").agg(F.array_sort(F.collect_set("name")).alias("names"))
