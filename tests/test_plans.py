"""What the plans of the query shapes look like: filters and columns reach the scan, one shuffle, no Python."""

import re

from cubeline import queries

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_reads_two_columns_and_pushes_the_range(spark):
    p = plan(queries.QUERIES["report_sum"](spark, DIR))
    assert re.search(r"ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>", p)
    assert "GreaterThanOrEqual(l_shipdate" in p and "LessThan(l_shipdate" in p
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1


def test_filters_on_events_are_pushed(spark):
    p = plan(queries.QUERIES["report_event_filter"](spark, DIR))
    assert "In(event_" in p and "props" not in p.split("ReadSchema")[1]


def test_shapes_shuffle_once_and_stay_in_the_jvm(spark):
    for name in ("report_count", "report_group_by", "dataset_long", "dataset_subset", "groups_long"):
        p = plan(queries.QUERIES[name](spark, DIR))
        # groups sum each combination of the fields before the grouping sets
        assert len(re.findall(r"Exchange hashpartitioning", p)) == 1 + (name == "groups_long"), name
        assert "Python" not in p and "Arrow" not in p, name


def test_only_streaming_state_runs_python(spark):
    for name, f in queries.QUERIES.items():
        if not name.startswith(("stream_", "bucket_", "formula_")) and f.__module__ != "cubeline.engine_queries":
            p = plan(f(spark, DIR))
            assert "Python" not in p and "Pandas" not in p and "CartesianProduct" not in p, name
