import math

import pytest

from cubeline.functions import formula as X

CTX = {"deal_value_sum": 150000.0, "deal_value_count": 10.0, "cost_sum": 60000.0, "nested_value": 5.0, "my_var_1": 2.0, "info": 3.0}
CASES = [
    ("deal_value_sum - cost_sum", 90000), ("10 + deal_value_count * 5", 60), ("(deal_value_sum / deal_value_count) - (cost_sum / deal_value_count)", 9000), ("pow(deal_value_count, 2)", 100),
    ("deal_value_sum / 0", 0), ("round(9.5)", 10), ("round(-2.5)", -3), ("round(0.49999999999999994)", 0), ("ceil(9.1)", 10), ("floor(9.9)", 9), ("abs(-10)", 10), ("sqrt(16)", 4), ("log(5)", math.log(5)), ("log10(100)", 2), ("exp(5)", math.exp(5)),
    ("sin(0)", 0), ("cos(0)", 1), ("tan(0)", 0), ("deal_value_sum * my_var_1", 300000), ("max(1, my_var_1, 3)", 3), ("min(4)", 4), ("2 - 1 - 1", 0), ("8 / 4 / 2", 1), ("1e3 + .5", 1000.5), ("info + 1", 4),
]


def test_both_ways(spark):
    df = spark.createDataFrame([CTX])
    got = X.compute(df, {f"c{i}": text for i, (text, _) in enumerate(CASES)}).first()
    for i, (text, want) in enumerate(CASES):
        assert got[f"c{i}"] == pytest.approx(want), text
        assert X.execute(text, CTX) == pytest.approx(want), text


def test_edges(spark):
    df = spark.createDataFrame([(0.0, -1.0, float("nan"), None, "s")], "z double, n double, q double, u double, s string")
    r = X.compute(df, {"a": "log(z)", "b": "log(n)", "c": "max(q, 1)", "d": "min(q)", "e": "u + 1", "f": "max(u, 1)", "g": "sqrt(n)", "h": "1 / u", "z": "n"}).first()
    assert r.a == -math.inf and math.isnan(r.b) and r.c == 1 and r.d == math.inf and r.e is None and r.f is None and math.isnan(r.g) and r.h is None and r.z == 0.0
    assert X.execute("gone * 2", {}) == 0 and X.execute("log(0)", {}) == 0 and X.execute("exp(10000)", {}) == 0
    for bad in ("a -+ b", "1 +", "(1", "f(1)", "pow(1)", "1 % 2", "", "s + 1", "unknown", "max()"):
        with pytest.raises(X.FormulaError):
            X.compute(df.withColumnRenamed("z", "a").withColumnRenamed("n", "b"), {"out": bad})


def test_no_chaining(spark):
    df = spark.createDataFrame([(50.0, 0.5)], "a double, b double")
    r = X.compute(df, {"x": "a + b", "y": "a * b", "w": "a * b + a"}).first()
    assert (r.x, r.y, r.w) == (50.5, 25, 75)
    with pytest.raises(X.FormulaError):
        X.compute(df, {"x": "a", "y": "x"})
