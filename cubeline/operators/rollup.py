"""Rollup tables: cells of all dimensions with their sums.

A cube is a folder of Parquet, partitioned by `batch` and by `partition_idx` (a number of
buckets, counted from the epoch) so that a time range prunes files.  A batch's cells are
written under its own name, replacing what that name held: repeating a batch changes
nothing, and late events add cells to old buckets in a new batch.  Reading sums the cells of
equal dimensions; compacting writes those sums as one batch, and which folders are read is
then a fact of the cube (see Engine.compact).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeline.functions.granularity import ordinal, ordinal_of, ordinals_between, to_ms
from cubeline.model import METRIC_TYPES, CubeDef
from cubeline.operators.fanout import DIMENSIONS, accepts, metric_rows


def exact_sum(value: Column, scale: int | None) -> Column:
    """A sum; with a scale, one that doesn't depend on order: decimals of so many places, as a double."""
    return F.sum(value) if scale is None else F.sum(value.cast(f"decimal(20,{scale})")).cast("double")


def merge(rows: DataFrame, scale: int | None = None) -> DataFrame:
    """One cell for each set of dimensions; BOOLEAN facts stay single rows, value by value."""
    facts = rows.where("aggregation_type = 'BOOLEAN'").select(*DIMENSIONS, "value")
    sums = rows.where("aggregation_type <> 'BOOLEAN'").groupBy(*DIMENSIONS).agg(exact_sum(F.col("value"), scale).alias("value"))
    return sums.unionByName(facts)


def build(events: DataFrame, cube: CubeDef, scale: int | None = None, more: Callable[[DataFrame], DataFrame] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The cells of a cube, with the number of their partition; apart for each value of the columns in `carry`."""
    e = events.where(accepts(cube))
    keys = [*DIMENSIONS, *carry]
    facts = metric_rows(e, cube.granularity, kinds=("BOOLEAN",), carry=carry).select(*keys, "value")
    rows = metric_rows(e, cube.granularity, kinds=[k for k in METRIC_TYPES if k != "BOOLEAN"], more=more, carry=carry)
    added = facts if more is None else facts.unionByName(rows.where("aggregation_type = 'BOOLEAN'").select(*keys, "value"))
    sums = (rows if more is None else rows.where("aggregation_type <> 'BOOLEAN'")).groupBy(*keys).agg(exact_sum(F.col("value"), scale).alias("value"))
    return sums.unionByName(added).withColumn("partition_idx", partition_of(cube))


def partition_of(cube: CubeDef) -> Column:
    return ordinal(F.col("ts"), cube.granularity, cube.partition_length) if cube.partitioned else F.lit(0).cast("long")


_BY = ("partition_idx", "attribution_type", "aggregation_type", "payload_field", "ts")


def write_batch(cells: DataFrame, path: str, batch: int | str) -> None:
    """Write or replace one batch of a cube.

    A partition's cells are brought together first (rebalanced: large ones are split, small ones
    share a task), or each task would write a file for each partition.  They are sorted so that
    a query of the totals, or of one metric, skips row groups by their statistics.
    """
    # batch comes first, so one folder holds it whole; overwriting that folder also clears partitions it no longer has
    cells.hint("rebalance", "partition_idx").sortWithinPartitions(*_BY).write.mode("overwrite").partitionBy("partition_idx").parquet(f"{path}/batch={batch}")


def replace_partitions(cells: DataFrame, path: str) -> None:
    """Write cells with a column batch, in place of what their batches held in the partitions they are of; all else stays."""
    by = ["batch", "partition_idx"]
    dealt = cells.hint("rebalance", *by).sortWithinPartitions("batch", *_BY)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


SCHEMA = (
    "source_id string, event_type string, ts {ts}, granularity string, attribution_type string, attribution_value string, aggregation_type string, payload_field string, "
    "payload_category string, compound_category_key string, leaf_key array<struct<k:string,v:string>>, value double, partition_idx long, batch string"
)


def read(spark: SparkSession, path: str, batches: list[str] | None = None, ts: str | None = None) -> DataFrame:
    """The cells of a cube, of all batches or of those named; `ts` is the type of its times where it may hold none."""
    paths = [f"{path}/batch=*"] if batches is None else [f"{path}/batch={b}" for b in batches]
    reader = spark.read.option("basePath", path)
    if ts is not None:
        if not paths:
            return spark.createDataFrame([], SCHEMA.format(ts=ts))
        reader = reader.schema(SCHEMA.format(ts=ts))
    return reader.parquet(*paths)


def cells(spark: SparkSession, path: str, scale: int | None = None) -> DataFrame:
    """The cube as one cell for each set of dimensions, whatever batches it came in."""
    return merge(read(spark, path), scale)


def pruned(rows: DataFrame, cube: CubeDef, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Only the partitions that a time range touches."""
    if not cube.partitioned:
        return rows
    r = ordinals_between(start, end, cube.granularity, cube.partition_length)
    return rows.where(F.col("partition_idx").between(r.start, r.stop - 1))


def compacted(rows: DataFrame, scale: int | None = None) -> DataFrame:
    """The cells of several batches as one batch."""
    facts = rows.where("aggregation_type = 'BOOLEAN'").select(*DIMENSIONS, "value", "partition_idx")
    sums = rows.where("aggregation_type <> 'BOOLEAN'").groupBy(*DIMENSIONS, "partition_idx").agg(exact_sum(F.col("value"), scale).alias("value"))
    return sums.unionByName(facts)


def answers(cube: CubeDef, granularity: str) -> bool:
    """Whether a cube can answer a query's granularity exactly: the query's buckets are made of the cube's."""
    return to_ms(granularity) % to_ms(cube.granularity) == 0


def hot_since(now: dt.datetime, hot_days: int) -> dt.datetime:
    return now - dt.timedelta(days=hot_days)


def kept_events(events: DataFrame, now: dt.datetime, hot_days: int) -> DataFrame:
    """Raw events that retention keeps."""
    return events.where(F.col("ts") >= F.lit(hot_since(now, hot_days)))


def first_kept_partition(cube: CubeDef, now: dt.datetime, hot_days: int) -> int:
    return ordinal_of(hot_since(now, hot_days), cube.granularity, cube.partition_length)


def kept_partitions(rows: DataFrame, cube: CubeDef, now: dt.datetime, hot_days: int) -> DataFrame:
    """Cells whose partition isn't older than the oldest hot one."""
    return rows.where(partition_of(cube) >= first_kept_partition(cube, now, hot_days))


def expire(cells: DataFrame, path: str, cube: CubeDef, now: dt.datetime, store, offload: Callable[[DataFrame], None] | None = None) -> list[int]:
    """Drop the partitions that retention no longer keeps, offloading them first; their numbers.

    cells: all of the cube that counts; store: of the cube's root.
    """
    if cube.retention is None or not cube.partitioned:
        return []
    edge = first_kept_partition(cube, now, cube.retention.hot_days)
    old = cells.where(F.col("partition_idx") < edge)
    gone = sorted(r[0] for r in old.select("partition_idx").distinct().collect())  # partitions, not rows
    if gone and offload is not None:
        offload(old.drop("batch"))
    for b in store.names(path):
        for p in store.names(f"{path}/{b}") if b.startswith("batch=") else []:
            if p.startswith("partition_idx=") and int(p.partition("=")[2]) < edge:
                store.delete(f"{path}/{b}/{p}")
    return gone
