"""Computed metrics: an arithmetic language compiled to Columns.

Numbers, names, + - * /, parentheses and the functions below, on doubles.  A division by zero
gives 0.  `min` and `max` pass over NaN.  `round` goes half away from zero.  Logarithms of 0
are -inf, of less NaN.  A minus sign belongs to a number literal only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

_TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<op>[-+*/(),]))")
_INF, _NAN = float("inf"), float("nan")


class FormulaError(ValueError):
    pass


def parse(text: str) -> tuple:
    """('num', x) | ('name', n) | ('call', f, args) | (op, left, right)."""
    tokens, at = [], 0
    end = len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected {text[at:].strip()[:10]!r} in {text!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    pos = 0

    def take(*values):
        nonlocal pos
        if tokens[pos][0] == "op" and tokens[pos][1] in values:
            pos += 1
            return tokens[pos - 1][1]
        return None

    def chain(below, *ops):
        left = below()
        while op := take(*ops):
            left = (op, left, below())
        return left

    def primary():
        nonlocal pos
        sign = 1.0
        if tokens[pos][1] in ("+", "-") and tokens[pos + 1][0] == "number":
            sign = -1.0 if take("+", "-") == "-" else 1.0
        kind, value = tokens[pos]
        if kind == "number":
            pos += 1
            return ("num", sign * float(value))
        if kind == "name":
            pos += 1
            if not take("("):
                return ("name", value)
            args = []
            if not take(")"):
                args.append(expr())
                while take(","):
                    args.append(expr())
                if not take(")"):
                    raise FormulaError(f"missing ) in {text!r}")
            return ("call", value, args)
        if take("("):
            inner = expr()
            if not take(")"):
                raise FormulaError(f"missing ) in {text!r}")
            return inner
        raise FormulaError(f"unexpected {value or 'end'!r} in {text!r}")

    def term():
        return chain(primary, "*", "/")

    def expr():
        return chain(term, "+", "-")

    tree = expr()
    if tokens[pos][0] != "end":
        raise FormulaError(f"unexpected {tokens[pos][1]!r} in {text!r}")
    return tree


def names(tree: tuple) -> set[str]:
    if tree[0] == "name":
        return {tree[1]}
    if tree[0] == "num":
        return set()
    return set().union(*(names(x) for x in (tree[2] if tree[0] == "call" else tree[1:])))


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x > 0, f(x)).when(x == 0, F.lit(-_INF)).when(x.isNotNull(), F.lit(_NAN))


def _extreme(f, empty: float) -> Callable[..., Column]:
    # a null stays null: nanvl would pass it, greatest and least would skip it
    def g(*xs: Column) -> Column:
        some_null = xs[0].isNull()
        for x in xs[1:]:
            some_null = some_null | x.isNull()
        return F.when(~some_null, f(*[F.nanvl(x, F.lit(empty)) for x in xs], F.lit(empty)))

    return g


_ONE: dict[str, Callable[[Column], Column]] = {
    "sqrt": F.sqrt, "abs": F.abs, "round": lambda x: F.round(x, 0),  # half away from zero
    "ceil": lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.ceil(x).cast("double")),
    "floor": lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.floor(x).cast("double")),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "log": _log(F.ln), "log10": _log(F.log10), "exp": F.exp,
}


def _compile(tree: tuple, known: Callable[[str], Column]) -> Column:
    kind = tree[0]
    if kind == "num":
        return F.lit(tree[1])
    if kind == "name":
        return known(tree[1])
    if kind == "call":
        name, args = tree[1], [_compile(a, known) for a in tree[2]]
        if name in _ONE and len(args) == 1:
            return _ONE[name](args[0])
        if name == "pow" and len(args) == 2:
            return F.pow(*args)
        if name in ("max", "min") and args:
            return (_extreme(F.greatest, -_INF) if name == "max" else _extreme(F.least, _INF))(*args)
        raise FormulaError(f"no function {name} of {len(args)} arguments")
    a, b = (_compile(x, known) for x in tree[1:])
    if kind == "/":
        return F.when(b == 0, F.when(a.isNotNull(), F.lit(0.0))).otherwise(a / b)
    return {"+": a + b, "-": a - b, "*": a * b}[kind]


def compile_formula(text: str, columns: list[str] | set[str]) -> Column:
    """A formula over the numeric columns named; a name that isn't among them is an error."""

    def known(n: str) -> Column:
        if n not in columns:
            raise FormulaError(f"unknown name {n!r} in {text!r}")
        return F.col(f"`{n}`").cast("double")

    return _compile(parse(text), known)


def compute(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Adds each formula's column, all in one projection over the columns df had; those win a clash of names."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    made = {n: compile_formula(t, numeric) for n, t in spec.items()}
    return df.withColumns({n: c for n, c in made.items() if n not in df.columns})


_MATH: dict[str, Callable[..., float]] = {
    "pow": lambda x, y: x**y, "sqrt": lambda x: math.sqrt(x) if x >= 0 else _NAN, "abs": abs, "exp": math.exp, "sin": math.sin, "cos": math.cos, "tan": math.tan,
    "round": lambda x: math.copysign(math.floor(abs(x)) + (abs(x) % 1 >= 0.5), x), "ceil": lambda x: float(math.ceil(x)), "floor": lambda x: float(math.floor(x)),
    "log": lambda x: math.log(x) if x > 0 else -_INF if x == 0 else _NAN, "log10": lambda x: math.log10(x) if x > 0 else -_INF if x == 0 else _NAN,
    "max": lambda *xs: max([x for x in xs if x == x], default=-_INF), "min": lambda *xs: min([x for x in xs if x == x], default=_INF),
}


def execute(text: str, context: dict[str, float]) -> float:
    """One formula over one set of numbers, on the driver: unknown names and results that aren't finite give 0."""

    def run(t):
        if t[0] == "num":
            return t[1]
        if t[0] == "name":
            return float(context[t[1]])
        if t[0] == "call":
            if t[1] not in _MATH:
                raise FormulaError(f"no function {t[1]}")
            try:
                return _MATH[t[1]](*map(run, t[2]))
            except TypeError as e:
                raise FormulaError(str(e)) from None
        a, b = run(t[1]), run(t[2])
        return (0.0 if b == 0 else a / b) if t[0] == "/" else a + b if t[0] == "+" else a - b if t[0] == "-" else a * b

    tree = parse(text)
    try:
        x = run(tree)
    except (KeyError, OverflowError, ValueError) as e:
        if isinstance(e, FormulaError):
            raise
        return 0.0
    return x if isinstance(x, float | int) and math.isfinite(x) else 0.0
