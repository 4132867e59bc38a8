"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers.

Patterns (leftmost, not overlapping, each kind by itself): `assign`, a name such as password
or token followed by a value of 12 or more characters; `access`, AKIA and capitals or digits,
18 or more in all; `hex`, 16 or more lower-case hex digits.

The models add spans of kind `markov`: of every run of 12 or more of `[A-Za-z0-9+/_-]`, by
letters alone or not, beside pattern spans, over them or in part over them.  Two first-order
character models, one of random strings and one of ordinary identifiers, are trained from
labelled samples; a run is a secret if the sum of its log-likelihood ratio is over `THRESHOLD`,
the odds that evidence has to beat.  So most values that patterns catch are spans of the models
too, where their characters bear it out: the two are independent findings.

The labelled samples: random ones are what `assign` and `access` catch in a bounded sample of
texts, with strings drawn by a seeded generator from the alphabets keys are written in; ordinary
ones are the long words of the same texts, identifiers joined from them (snake_case, camelCase,
with running numbers), and decimal numbers.  The sample is the `SAMPLE` texts of the lowest hash,
and of their distinct words and catches the `STRINGS` of the lowest hash, so what the driver gets
is bounded.  `quality` holds a share of words and strings out and gives precision and recall.

Spans are code point offsets, end exclusive.  Null text is empty; an empty text has no spans.
Texts are scanned whole.  Rows are independent: repeated rows give equal results.  An empty
table trains on the drawn samples alone and gives no rows.  Columns of the caller named as
results stay out of `scan`; `redacted` keeps all columns as they are.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeline.llm.common import joined_parts, whole_text

#: Texts, and distinct words and catches of them, that train the models at most.
SAMPLE, STRINGS = 1_000, 20_000
#: Sum of the log-likelihood ratio beyond which a run is a secret: odds of about 3,000 to 1.
THRESHOLD = 8.0
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{12,}")
_WORD = re.compile(r"[A-Za-z]{8,}")

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and then kind."""
    out = []
    if "=" in text or ":" in text:
        # a match is used up even when its value is too short, hence no {12,} in the pattern
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]  # 16 or more: the same runs as + and a drop
    return sorted(out)


_CLASS = np.full(128, 63, np.int64)
for _i, _c in enumerate(string.ascii_letters + string.digits + "+"):
    _CLASS[ord(_c)] = _i
_CLASS[ord("/")] = 62
_STATES = 64


def _codes(s: str) -> np.ndarray:
    return _CLASS[np.frombuffer(s.encode("ascii"), np.uint8)]


def train(samples: list[tuple[str, int]], smooth: float = 0.1) -> np.ndarray:
    """Labelled strings (1: random) -> log-likelihood ratio of each pair of characters."""
    counts = np.zeros((2, _STATES * _STATES))
    for s, label in samples:
        if len(s) > 1:
            c = _codes(s)
            counts[label] += np.bincount(c[:-1] * _STATES + c[1:], minlength=_STATES * _STATES)
    tables = counts.reshape(2, _STATES, _STATES) + smooth
    log = np.log(tables / tables.sum(2, keepdims=True))
    return log[1] - log[0]


def ratio(model: np.ndarray, s: str) -> float:
    """Log-likelihood ratio of a whole string; above 0: likelier random."""
    c = _codes(s)
    return float(model[c[:-1], c[1:]].sum()) if len(c) > 1 else 0.0


#: Ratios that a scorer remembers, of runs of so many characters at most.
_KEPT, _KEPT_CHARS = 200_000, 64


def scorer(model: np.ndarray):
    """string -> ratio, with a bounded memory: long words of a language come again."""
    known: dict[str, float] = {}

    def score(s: str) -> float:
        r = known.get(s)
        if r is None:
            r = ratio(model, s)
            if len(s) <= _KEPT_CHARS:
                if len(known) >= _KEPT:
                    known.clear()
                known[s] = r
        return r

    return score


def spans(text: str, score, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span]]:
    """(spans of the patterns, all spans), each by start and then kind.  score: of scorer()."""
    base = base_spans(text)
    more = [(m.start(), 3, m.end()) for m in CANDIDATE.finditer(text) if score(m[0]) > threshold]
    return base, sorted(base + more) if more else base


def _mixed(s: str) -> bool:
    return any("0" <= c <= "9" for c in s) and any(c.isalpha() for c in s)


def joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def drawn(n: int = 400, seed: int = 11) -> list[str]:
    """Random strings over the alphabets that keys are written in."""
    rng = random.Random(seed)
    sets = ("0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_lowercase + string.digits, string.ascii_letters)
    return ["".join(rng.choices(a, k=rng.randint(12, 64))) for a in sets for _ in range(n)]


def identifiers(words: list[str], seed: int = 12) -> list[str]:
    """Names joined from words as code does, and numbers."""
    rng = random.Random(seed)
    words = sorted({*words, "account", "customer", "document", "function", "identifier", "parameter", "position", "reference", "sequence", "transaction"})
    out = list(words)
    for _ in range(4 * min(len(words), 2_000)):
        a, b, c = rng.choice(words), rng.choice(words), rng.choice(words)
        out += [f"{a}_{b}_{c}".lower(), a.lower() + b.title() + c.title(), f"{a}-{b}{rng.randint(0, 2030)}".lower(), f"{a.upper()}_{b.upper()}_{rng.randint(0, 99)}", str(rng.randrange(10 ** rng.randint(4, 19)))]
    return out


def labelled(words: list[str], caught: list[str], held: bool = False) -> list[tuple[str, int]]:
    """Labelled strings (1: random) from words and catches; `held`: with other draws."""
    return [(s, 1) for s in drawn(seed=21 if held else 11) + caught] + [(s, 0) for s in identifiers(words, 22 if held else 12)]


def quality(strings: list[tuple[str, int]], threshold: float = THRESHOLD, folds: int = 5) -> dict[str, float]:
    """Precision and recall on words and catches that the models were not trained on: one share of `folds`, by crc32.

    strings: (string, label) as `sample` gives them.  Only runs of 12 or more characters are judged, as in texts.
    """
    away = lambda s: zlib.crc32(s.encode()) % folds == 0
    part = lambda label, out: [s for s, k in strings if k == label and away(s) == out]
    model = train(labelled(part(0, False), part(1, False)))
    judged = [(ratio(model, s) > threshold, k) for s, k in labelled(part(0, True), part(1, True), held=True) if CANDIDATE.fullmatch(s)]
    hits, called, true = sum(a and k for a, k in judged), sum(a for a, _ in judged), sum(k for _, k in judged)
    return {"n": len(judged), "precision": hits / max(1, called), "recall": hits / max(1, true)}


def sample(docs: DataFrame, most: int = SAMPLE, text: str = "text", strings: int = STRINGS) -> list[tuple[str, int]]:
    """Labelled strings of a bounded sample of texts: 1 what patterns catch, 0 long words; cut out on the executors."""

    def cut(batches):
        for b in batches:
            kinds, found = [], []
            for t in b.column("t").to_pylist():
                base = base_spans(t)
                own = [ASSIGN.match(t, a)[2] if k == 0 else t[a:e] for a, k, e in base if k < 2]
                kinds += [1] * len(own)
                found += own
                at = 0
                for a, _, e in [*base, (len(t), 0, len(t))]:  # words between the spans
                    if a > at:
                        words = {m[0] for m in _WORD.finditer(t, at, a)}
                        kinds += [0] * len(words)
                        found += words
                    at = max(at, e)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(found, pa.string())], ["label", "s"])

    texts = docs.select(whole_text(text).alias("t")).select("t", F.xxhash64("t").alias("h"))
    # the bound is found on hashes alone, so that no texts are sorted
    edge = texts.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if edge is None:
        return []
    cuts = texts.where(F.col("h") <= edge).select("t").dropDuplicates(["t"]).mapInArrow(cut, "label int, s string").where(F.length("s").between(2, 512)).distinct()
    return sorted((r.s, r.label) for r in cuts.orderBy(F.xxhash64("s"), "s", "label").limit(strings).collect())


def train_from(docs: DataFrame, most: int = SAMPLE, text: str = "text") -> np.ndarray:
    """The model, from labelled strings of a bounded sample of texts."""
    got = sample(docs, most, text)
    return train(labelled([s for s, k in got if k == 0], [s for s, k in got if k == 1 and _mixed(s)]))


_OUT = "n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"


def scan(docs: DataFrame, model: np.ndarray, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans for each text."""

    def run(batches):
        score = scorer(model)
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                base, every = spans(t, score, threshold)
                n = [sum(k == kind for _, k, _ in every) for kind in range(4)]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", *[x.split()[0] for x in _OUT.split(", ")]])

    return joined_parts(docs).select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(run, f"doc_id long, {_OUT}")


MARK = "[SECRET]"


def hide(text: str, found: list[Span], mark: str = MARK) -> str:
    """The text with each stretch of spans replaced by the mark; of an assignment, its value."""
    out, at = [], 0
    for a, k, b in found:
        if k == 0:
            a = ASSIGN.match(text, a).start(2)
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join((*out, text[at:])) if out else text


def redacted(docs: DataFrame, model: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with secrets in `text` replaced by a mark; a text without any stays as it is, null too.

    Where a text changes, a column n_chars follows it.
    """
    names = docs.columns
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        score = scorer(model)
        for b in batches:
            k = names.index(text)
            old = b.column(k).to_pylist()
            new = [None if t is None else hide(t, spans(t, score, threshold)[1]) for t in old]
            cols = [*b.columns[:k], pa.array(new, pa.string()), *b.columns[k + 1 :]]
            if size is not None:
                n = [c if t == u else len(u) for c, t, u in zip(b.column(size).to_pylist(), old, new, strict=True)]
                cols[size] = pa.array(n, b.column(size).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined_parts(docs).mapInArrow(run, docs.schema)
