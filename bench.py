"""Times the headline queries and prints one JSON line.

Each runs once to warm up and then RUNS times; its figure is the median, in seconds,
of computing all rows.  The first entries answer the published task, the all-metrics dataset
by day over 100,000 events: writing the rollup, and reading from raw events, from the rollup (whose
number of cells is printed), and from the result cache.  BENCH_SF_DIR and BENCH_CPUS choose the
tables and the cores.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from cubeline import queries as core
from cubeline.model import CubeDef, DatasetQuery
from cubeline.operators import rollup, shapes
from cubeline.plans.cache import ResultCache
from cubeline.sources import tables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
HEADLINE = (
    "report_count", "report_sum", "report_category", "report_group_by", "report_attribution", "report_multi_source", "bucket_250ms", "dataset_wide", "dataset_subset", "dataset_boolean_groups",
    "groups_long", "groups_multi_dim", "flat_groups_2", "flat_groups_3", "flat_groups_ragged", "filter_and_or", "formula_arith", "formula_on_dataset", "fanout_counts", "fanout_rollup",
    "dedupe_uuid", "every_tenth_trigger", "rate_limit_day", "retention_events", "cache_partial_merge", "report_metadata",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp()
    q = DatasetQuery(core.EVERYTHING, "day")
    cube = CubeDef("bench", "bench", "hour", partitioned=True, partition_length=24)
    built = []
    for _ in range(4):
        started = time.time()
        rollup.write_batch(rollup.build(tables.activity(spark, SF_DIR), cube), f"{work}/cube", 0)
        built.append(time.time() - started)
    n_cells = rollup.read(spark, f"{work}/cube").count()
    cache = ResultCache(spark, f"{work}/cache")

    def from_rollup():
        rows = rollup.pruned(rollup.read(spark, f"{work}/cube"), cube, *q.time_range)
        return shapes.dataset_long(shapes.scoped_rows(rows, q), q, "hour")

    runs = {
        "dataset_day_raw": lambda: shapes.dataset(tables.activity(spark, SF_DIR), q),
        "dataset_day_rollup": from_rollup,
        "dataset_day_cached": lambda: cache.get(q, from_rollup),
    } | {n: (lambda f=core.QUERIES[n]: f(spark, SF_DIR)) for n in HEADLINE}
    out = {"build_rollup": round(statistics.median(built[1:]), 3)}
    for name, make in runs.items():
        took = []
        for _ in range(RUNS + 1):
            t = time.time()
            make().write.format("noop").mode("overwrite").save()
            took.append(time.time() - t)
        out[name] = round(statistics.median(took[1:]), 3)
    shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "sum of median query times", "value": round(sum(v for k, v in out.items() if k != "build_rollup"), 3), "unit": "sec", "queries": out, "cells": n_cells, "cpus": CPUS, "runs": RUNS, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
