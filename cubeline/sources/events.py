"""Event streams: the canonical form, ingest steps and scans.

Canonical columns: uuid, source_id, event_type, ts, attributions array<struct<type,value>>,
payload.  The payload is a struct of typed fields where a source's schema is known, which
lets column pruning reach the files, or a VARIANT where it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, StructType

ATTRIBUTIONS = "array<struct<type:string,value:string>>"
JSON_SCHEMA = f"uuid string, eventType string, timestamp string, payload string, attributions {ATTRIBUTIONS}"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def payload_fields(events: DataFrame) -> dict[str, list[str]]:
    """Names of a typed payload's fields: numeric, categorical (strings and booleans), boolean.  Others don't count."""
    t = events.schema["payload"].dataType
    if not isinstance(t, StructType):
        raise ValueError("the payload has no declared fields")
    of = lambda *kinds: [f.name for f in t.fields if isinstance(f.dataType, kinds)]
    return {"numeric": of(NumericType), "categorical": of(StringType, BooleanType), "boolean": of(BooleanType)}


def read_json(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Events as JSON lines or arrays: uuid checked, payload `{}` and ts now by default; a bad uuid is an error."""
    raw = spark.read.schema(JSON_SCHEMA).option("multiLine", "false").json(path)
    good = F.when(F.col("uuid").rlike(UUID), F.col("uuid")).otherwise(F.raise_error(F.concat(F.lit("not a UUID: "), F.coalesce("uuid", F.lit("null")))).cast("string"))
    return raw.select(
        good.alias("uuid"), F.lit(source_id).alias("source_id"), F.col("eventType").alias("event_type"), with_default_ts(F.to_timestamp("timestamp")).alias("ts"),
        F.coalesce("attributions", F.array().cast(ATTRIBUTIONS)).alias("attributions"), F.parse_json(F.coalesce("payload", F.lit("{}"))).alias("payload"),
    )


def with_default_ts(ts):
    return F.coalesce(ts, F.current_timestamp())


def dedupe(new: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One event for each (source_id, uuid), none that is stored already.

    Of what is stored only the keys are read.  Where the new events are known to be few, their
    keys are sent to that scan, so that history isn't shuffled for each batch; else the keys
    meet in one shuffle, which the removal of repeats shares.
    """
    key = ["source_id", "uuid"]
    out = new.dropDuplicates(key)
    if stored is None:
        return out
    known = stored.select(*key)
    if size_of(new.select(*key)) <= MAX_BROADCAST:
        known = known.join(F.broadcast(new.select(*key)), key, "left_semi")
    return out.join(known, key, "left_anti")


def already_stored(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored rows of the uuids that came again."""
    return stored.join(new.select("source_id", "uuid").distinct(), ["source_id", "uuid"], "left_semi")


#: Bytes, by the optimiser's estimate, up to which a table may be broadcast; a larger one is joined by shuffling.
MAX_BROADCAST = 8 << 20


def size_of(df: DataFrame) -> int:
    """The optimiser's estimate of a table's bytes: of files and local rows it is near, of other sources it is huge."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """A hint to broadcast, if df is known to be small; no job is run for that."""
    return F.broadcast(df) if size_of(df) <= most else df


def unknown_types(events: DataFrame, types: DataFrame) -> DataFrame:
    """Events whose (source_id, event_type) isn't registered."""
    return events.join(small(types.select("source_id", "event_type").distinct()), ["source_id", "event_type"], "left_anti")


def known_types(events: DataFrame, types: DataFrame) -> DataFrame:
    return events.join(small(types.select("source_id", "event_type").distinct()), ["source_id", "event_type"], "left_semi")


def with_type_names(events: DataFrame, types: DataFrame) -> DataFrame:
    """Events that name their type by id, with its name: an event of an unknown type has none and goes.

    events: event_type_id; types: source_id, event_type_id, event_type.
    """
    return events.join(small(types), ["source_id", "event_type_id"]).drop("event_type_id")


def of_sources(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Events of registered sources, with the source's name and owners."""
    return events.join(small(sources), "source_id")


def require_types(events: DataFrame, types: DataFrame) -> DataFrame:
    """The events, if all of their types are registered."""
    if bad := unknown_types(events, types).select("source_id", "event_type").first():
        raise ValueError(f'Event type "{bad.event_type}" is not defined for source "{bad.source_id}"')
    return events


def recent(events: DataFrame, source_id: str, limit: int = 20) -> DataFrame:
    """The newest events of a source."""
    return events.where(F.col("source_id") == source_id).orderBy(F.desc("ts"), "uuid").limit(limit)


def raw_counts(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Number of raw events of each registered source, 0 included."""
    n = events.groupBy("source_id").agg(F.count("*").alias("n"))
    return sources.select("source_id").distinct().join(n, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("n_events"))
