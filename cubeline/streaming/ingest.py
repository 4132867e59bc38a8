"""Streams into the engine: exactly once by batch number, retries, quarantine, draining."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ATTEMPTS, FIRST_DELAY_S = 15, 0.25


def delays(attempts: int = ATTEMPTS, first: float = FIRST_DELAY_S) -> list[float]:
    """Seconds before each further attempt: doubled every time."""
    return [first * 2**k for k in range(attempts - 1)]


def retrying(f: Callable[[], None], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> Exception | None:
    """Run f until it succeeds; the last error after so many attempts."""
    waits = delays(attempts)
    for k in range(attempts):
        try:
            f()
            return None
        except Exception as e:  # noqa: BLE001  whatever a batch fails with, it is put aside
            last = e
            if k < len(waits):
                sleep(waits[k])
    return last


def ingest(engine, source_id: str, stream: DataFrame, checkpoint: str, *, quarantine: str | None = None, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep, on_batch: Callable[[DataFrame, int], None] | None = None, drain: bool = True) -> StreamingQuery:
    """Feed a stream of events to a source.

    A batch's number is its name everywhere, so a batch that is run again after a crash
    replaces what it wrote.  Events of unknown types, and batches that keep failing, go to the
    quarantine folder (without one, they fail the query).  With `drain`, all there is is
    processed and the query ends.
    """
    from cubeline.sources.events import known_types, unknown_types

    def batch(df: DataFrame, number: int) -> None:
        df = df.withColumn("source_id", F.lit(source_id))

        def run():
            good = df
            if quarantine is not None:
                types = engine.registry.types_table(engine.spark)
                unknown_types(df, types).write.mode("overwrite").parquet(f"{quarantine}/types/batch={number}")
                good = known_types(df, types)
            kept = engine.record(source_id, good.select(*df.columns), number)
            if on_batch is not None:
                on_batch(kept, number)

        error = retrying(run, attempts, sleep)
        if error is not None:
            if quarantine is None:
                raise error
            df.withColumn("error", F.lit(str(error)[:500])).write.mode("overwrite").parquet(f"{quarantine}/failed/batch={number}")

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if drain else w).start()


def flush(query: StreamingQuery) -> None:
    """Wait until all there is has been processed."""
    if query.isActive:
        query.processAllAvailable()
    if query.exception() is not None:
        raise query.exception()


def deduped(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream with each (source_id, uuid) once within the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["source_id", "uuid"])


def stats(query: StreamingQuery) -> dict[str, float]:
    """Rows and rates of the last progress report, and whether more waits."""
    p = query.lastProgress or {}
    out = {k: p.get(k, 0) or 0 for k in ("batchId", "numInputRows", "inputRowsPerSecond", "processedRowsPerSecond")}
    return out | {"waiting": int(query.status.get("isDataAvailable", False))}


def dead_letters(engine, quarantine: str) -> list[int]:
    """The numbers of the batches that were put aside."""
    return sorted(int(n.partition("=")[2]) for n in engine.store.names(f"{quarantine}/failed") if n.startswith("batch="))
