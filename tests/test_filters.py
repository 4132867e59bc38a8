import pytest

from cubeline.functions.filters import apply_filter

ROWS = [("1", "A", 10, True, "Apple"), ("2", "B", 25, False, "Banana"), ("3", "A", 15, True, "Avocado"), ("4", "C", 30, True, "Cherry"), ("5", "B", 20, True, "Blueberry")]


def op(o, v):
    return {"operator": o, "value": v}


@pytest.mark.parametrize(
    ("spec", "ids"),
    [
        ({"category": [op("EQ", "A")]}, "13"),
        ({"value": [op("GT", 10), op("LTE", 25)]}, "235"),
        ({"category": [op("EQ", "B")], "enabled": [op("EQ", True)]}, "5"),
        ({"id": [{"OR": [op("EQ", "2"), op("EQ", "4")]}]}, "24"),
        ({"name": [op("CONTAINS", "berry")]}, "5"),
        ({"name": [op("NOT_CONTAINS", "an")]}, "1345"),
        ({"enabled": [op("GT", False)]}, ""),
        ({"value": [op("EQ", "10")]}, ""),
        ({"value": [op("NEQ", "10")]}, "12345"),
        ({"nothing": [op("NEQ", 1)]}, ""),
        ({"value": [{"AND": []}]}, "12345"),
        ({"value": [{"OR": []}]}, ""),
        ({"value": [{"OR": [{"AND": [op("GTE", 25), op("LT", 30)]}, op("EQ", 10)]}]}, "12"),
        ({}, "12345"),
        (None, "12345"),
    ],
)
def test_filters(spark, spec, ids):
    df = spark.createDataFrame(ROWS, "id string, category string, value int, enabled boolean, name string")
    assert sorted(r.id for r in apply_filter(df, spec).collect()) == list(ids)


def test_paging_nulls_and_errors(spark):
    df = spark.createDataFrame(ROWS, "id string, category string, value int, enabled boolean, name string").orderBy("id")
    assert [r.id for r in apply_filter(df, {"value": [op("GT", 10)]}, 1, 2).collect()] == ["3", "4"]
    assert apply_filter(df.limit(0), {"value": [op("GT", 10)]}).count() == 0
    with pytest.raises(ValueError):
        apply_filter(df, {"value": [op("LIKE", 1)]})
    nulls = spark.createDataFrame([(None,), (1.0,)], "x double")
    assert apply_filter(nulls, {"x": [op("NEQ", 2)]}).count() == 1
