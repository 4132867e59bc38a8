"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, everything but letters becomes a space, and runs of spaces one.  Its
features are the 4- and 5-grams that occur in it (present or not), hashed into 2**20 cells.
For each cell r = log of the smoothed ratio between the shares of toxic and of clean texts
that have it.  The cells that tell most (mutual information) are kept; a logistic regression
with an L2 penalty is fitted on presence * r by Newton's method (each step by conjugate
gradients), until the gradient is `TOLERANCE` of what it was at the start.  A text's score is the probability it gives.

Training rows are labelled rows; `MAX_TRAIN` of them at most, those of the lowest hash of the
doc_id.  The sample is bounded, so its doc_ids may be broadcast to find the texts, and one
task can fit it; the model is at most `CELLS` numbers and goes to each task of the scan that
scores.  Scoring is one pass without a shuffle.

Null text is empty; an empty text scores what the intercept gives.  A doc_id labelled twice
is toxic if any of its labels says so; null labels or doc_ids are left out.  Without any
training row, or with one class only, the score is the smoothed share of toxic rows.
Repeated rows score alike.  Only doc_id and text are read of the documents; the score
depends on the text alone.  Columns kept beside the scores that are named as they are give way.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeline.llm.common import joined_parts, whole_text

MAX_TRAIN = 8_000
CELLS = 8_192
ORDERS = (4, 5)
PENALTY = 1.0
#: The fit ends when the gradient's length is under this share of its first (or of a millionth a row); if it isn't after so many Newton steps, the fit fails.
TOLERANCE, ROUNDS = 1e-4, 200
_SPACE = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_GAP = re.compile(r"[\W\d_]+")


def cells(text: str) -> np.ndarray:
    """The hashed cells of a text's n-grams, with repeats."""
    s = " " + _GAP.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        grams = {1: c}
        for n in range(2, max(ORDERS) + 1):
            g = grams[n - 1]
            grams[n] = g[:-1] * _P + c[n - 1 :] if len(g) > 1 else c[:0]
        out = [((grams[n] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44) for n in ORDERS]
    return np.concatenate(out).astype(np.int64)


def fit(texts: list[str], toxic: np.ndarray, cells_kept: int = CELLS, penalty: float = PENALTY) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, cells, weights)."""
    y = np.asarray(toxic, np.int64)
    pos, neg = int(y.sum()), int((1 - y).sum())
    none = np.zeros(0, np.int64), np.zeros(0)
    if not pos or not neg:
        return float(np.log((pos + 1) / (neg + 1))), *none
    df, last = np.zeros((2, _SPACE), np.int32), np.zeros(_SPACE, np.int64)
    for t, k in zip(texts, y.tolist(), strict=True):
        c = cells(t)
        nth = np.arange(len(c))
        last[c] = nth
        df[k, c[last[c] == nth]] += 1
    p, q = (df[1] + 1) / (pos + 2), (df[0] + 1) / (neg + 2)
    r = np.log(p / q)
    share = (df[1] + df[0]) / (pos + neg)
    prior = pos / (pos + neg)
    info = prior * (p * np.log(p) + (1 - p) * np.log(1 - p)) + (1 - prior) * (q * np.log(q) + (1 - q) * np.log(1 - q))
    m = prior * p + (1 - prior) * q
    info -= m * np.log(m) + (1 - m) * np.log(1 - m)
    info[share == 0] = -1
    kept = np.sort(np.lexsort((np.arange(_SPACE), -info))[:cells_kept])
    kept = kept[share[kept] > 0]
    number = np.full(_SPACE, -1, np.int32)
    number[kept] = np.arange(len(kept))
    rows = [np.unique(k[k >= 0]) for k in (number[cells(t)] for t in texts)]
    col = np.concatenate(rows) if rows else none[0]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    rk = r[kept]
    turned = np.argsort(col, kind="stable")
    row_at, col_at = row[turned], col[turned]

    def summed(x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Sums of x by the sorted numbers `of`."""
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else none[0]
        out = np.zeros(n)
        if len(first):
            out[of[first]] = np.add.reduceat(x, first)
        return out

    n = len(rows)
    forward = lambda w: summed((rk * w)[col], row, n)
    back = lambda e: rk * summed(e[row_at], col_at, len(kept))

    def loss(w, b, z):
        return float(np.logaddexp(0, z).sum() - z @ y + penalty / 2 * (w @ w))

    w, b, first = np.zeros(len(kept)), float(np.log(pos / neg)), None
    z = np.full(n, b)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        gw, gb = back(p - y) + penalty * w, float((p - y).sum())
        long = np.sqrt(gw @ gw + gb * gb)
        first = max(long, 1e-6 * n) if first is None else first
        if long <= TOLERANCE * first:
            return b, kept, w * rk
        sw, sb, sz = _step(gw, gb, p * (1 - p), forward, back, rk * rk * summed((p * (1 - p))[row_at], col_at, len(kept)) + penalty, penalty, long, first)
        now, slope, t = loss(w, b, z), gw @ sw + gb * sb, 1.0
        while loss(w + t * sw, b + t * sb, z + t * sz) > now + 1e-4 * t * slope and t > 1e-8:
            t /= 2
        w, b, z = w + t * sw, b + t * sb, z + t * sz
    raise RuntimeError(f"the fit did not converge in {ROUNDS} rounds")


def _step(gw, gb, d, forward, back, diagonal, penalty, long, first):
    """(change of weights, of the intercept, of the rows' sums): the Newton step, about, by conjugate gradients."""
    sw, sb, sz = np.zeros(len(gw)), 0.0, np.zeros(len(d))
    rw, rb = -gw, -gb
    bottom = max(float(d.sum()), 1e-9)
    yw, yb = rw / diagonal, rb / bottom
    qw, qb = yw.copy(), yb
    rho = rw @ yw + rb * yb
    goal = min(0.1, np.sqrt(long / first)) * long
    for _ in range(500):
        qz = forward(qw) + qb
        hw, hb = back(d * qz) + penalty * qw, float(d @ qz)
        a = rho / (qw @ hw + qb * hb)
        sw, sb, sz = sw + a * qw, sb + a * qb, sz + a * qz
        rw, rb = rw - a * hw, rb - a * hb
        if np.sqrt(rw @ rw + rb * rb) <= goal:
            break
        yw, yb = rw / diagonal, rb / bottom
        rho, old = rw @ yw + rb * yb, rho
        qw, qb = yw + rho / old * qw, yb + rho / old * qb
    return sw, sb, sz


def scorer(model: tuple[float, np.ndarray, np.ndarray]):
    b, kept, weights = model
    table = np.full(_SPACE, -1, np.int16 if len(kept) < 1 << 15 else np.int32)
    table[kept] = np.arange(len(kept))

    def score(text: str) -> float:
        k = table[cells(text)]
        z = b + weights[np.unique(k[k >= 0])].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return score


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """text, toxic of the sample."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where("id is not null and toxic is not null")
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
        .where(~held_out(F.col("id")))
        .orderBy(F.xxhash64("id"), "id").limit(most)
    )
    return docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text")).dropna(subset=["id"]).join(F.broadcast(known), "id").select("id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> tuple[float, np.ndarray, np.ndarray]:
    """Fit in one task of an executor; only the model comes to the driver."""

    def run(batches):
        ids, texts, toxic = [], [], []
        for b in batches:
            ids += b.column("id").to_pylist()
            texts += b.column("text").to_pylist()
            toxic += b.column("toxic").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        b, kept, w = fit([texts[i] for i in order], np.array([toxic[i] for i in order], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([kept.astype("<i8").tobytes()]), pa.array([w.astype("<f8").tobytes()])], ["b", "kept", "w"])

    row = training_rows(docs, labels, most).repartition(1).mapInArrow(run, "b double, kept binary, w binary").first()
    if row is None:
        return 0.0, np.zeros(0, np.int64), np.zeros(0)
    return row.b, np.frombuffer(row.kept, "<i8"), np.frombuffer(row.w, "<f8")


def scores(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of `keep`, with score and predicted."""
    keep = tuple(k for k in keep if k.lower() not in ("score", "predicted", "_text"))
    base = joined_parts(docs).select(*[F.col(k) for k in keep], whole_text(text).alias("_text"))

    def run(batches):
        score = scorer(model)
        for b in batches:
            s = np.array([score(t) for t in b.column("_text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType(base.schema.fields[:-1]).add("score", DoubleType()).add("predicted", IntegerType())
    return base.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """docs, all columns, without the rows that score 0.5 or more."""
    names = docs.columns

    def run(batches):
        score = scorer(model)
        for b in batches:
            clean = [score(t or "") < 0.5 for t in b.column(names.index(text)).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return joined_parts(docs).mapInArrow(run, docs.schema)
