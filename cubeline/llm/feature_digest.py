"""Fingerprints of statistically improbable features.

Every 64-byte window of a text (UTF-8) has a byte entropy, in steps of a hundredth of a bit.  A
pass over the whole corpus counts the windows of each step (`rarity`); the rarer a window's
entropy there, the lower its rank.  Windows of almost no entropy (runs of one byte) carry
nothing and are never chosen unless there is no other.  In each run of 64 neighbouring windows
the lowest rank, leftmost first,
scores a point; windows with 16 points or more are the features.  A feature's 64-bit hash
sets 5 bits of a 2,048-bit Bloom filter; after 160 features a new filter is chained.  A
feature that occurs again in the same text is not inserted again.

Two fingerprints are compared filter by filter: the common bits beyond those that chance
gives two filters so full, over the most there could be.  Each filter of the shorter chain
takes its best match; the mean is weighted by bits set.  The result is 0 to 1, and 1 for
equal texts.

A text under 64 bytes has no whole window; each of its 8-byte windows is a feature (under 8
bytes: the text itself).  An empty text (or null) has no filter, is
like another empty text by 1 and like any other text by 0.  A text always has a feature: if
no window scores 16 points, the lowest rank of all is taken.  A text of z bytes has z - 126
runs, and about 64 of them give a feature.  With fewer than 4 * 64 runs (64 to 381 bytes) few
windows score, or none, and an edit may touch them all; such a text has its 8-byte windows as
features too, after those selected, so that the selected ones still meet those of a longer
text.  Its features are dealt evenly over the filters they need: one with few bits would be
like many by chance.  Texts are processed whole; a text's fingerprint depends on that text
and on the table of ranks, which may be kept and given to other corpora so that fingerprints
stay comparable.  The table has 601 numbers, whatever the corpus.  An empty table of documents
gives no rows, and ranks that are all alike.

Entropies are whole numbers (sums of c * log2 c in thousandths), so that results are the
same on every machine.  They are updated along many stretches at once, a byte in and a byte
out, and are exact for every window.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeline.llm.common import long_key, ordered_buckets, ranges_for, whole_text

WINDOW = 64
RUN = 64
POINTS = 16
#: A text of one window or more, but under so many bytes, has its small windows as features too.
SHORT = WINDOW + RUN - 2 + 4 * RUN
PER_FILTER = 160
BITS = 2048
HASHES = 5
#: Entropy (bits) below which a window carries nothing.
LEAST = 1.0
#: Steps of entropy to a bit, and how many there are.
STEPS = 100
KINDS = STEPS * 6 + 1
#: Bytes of texts that are worked on together.
TOGETHER = 1 << 20
_STRETCH = 2048
_NONE = np.int64(1) << 62
_EMPTY = 9000  # the rank of windows that carry nothing

_C = np.arange(WINDOW + 1)
_SUM = np.rint(1000 * _C * np.log2(np.maximum(_C, 1))).astype(np.int32)
_UP = np.append(np.diff(_SUM), 0).astype(np.int32)
_TOP = int(np.log2(WINDOW) * 1000) * WINDOW


def window_sums(data: np.ndarray) -> np.ndarray:
    """For each 64-byte window: the sum of 1000 * c * log2(c) over the counts c of its bytes."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    m = min(n, max(64, min(_STRETCH, n // 256)))
    lanes = -(-n // m)
    padded = np.zeros(lanes * m + WINDOW, np.uint8)
    padded[: len(data)] = data
    rows = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (m + WINDOW - 1, lanes), (1, m)))
    counts, base = np.zeros(lanes * 256, np.uint8), np.arange(lanes, dtype=np.intp) * 256
    total = np.zeros(lanes, np.int32)
    out = np.empty((m, lanes), np.int32)
    for t in range(WINDOW):
        at = base + rows[t]
        c = counts[at]
        total += _UP[c]
        counts[at] = c + 1
    out[0] = total
    for t in range(1, m):
        at = base + rows[t - 1]
        c = counts[at] - 1
        total -= _UP[c]
        counts[at] = c
        at = base + rows[t + WINDOW - 1]
        c = counts[at]
        total += _UP[c]
        counts[at] = c + 1
        out[t] = total
    return out.T.ravel()[:n]


def steps(sums: np.ndarray) -> np.ndarray:
    """The entropy of windows in hundredths of a bit."""
    return np.clip((_TOP - sums) // WINDOW * STEPS // 1000, 0, KINDS - 1)


def counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy."""
    out = np.zeros(KINDS, np.int64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) >= WINDOW:
        own = _own(size, len(data) - WINDOW + 1)
        out += np.bincount(steps(window_sums(data))[own], minlength=KINDS)
    return out


def _own(size: np.ndarray, n: int) -> np.ndarray:
    """Which windows of texts that follow one another lie in one text."""
    edge = np.zeros(n + 1, np.int64)
    big = size >= WINDOW
    start = (np.cumsum(size) - size)[big]
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size[big] - WINDOW + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def table(seen: np.ndarray) -> np.ndarray:
    """Rank of each entropy by how often it was seen: lower is rarer; the lower entropy first on ties."""
    rank = np.empty(KINDS, np.int64)
    rank[np.lexsort((np.arange(KINDS), seen))] = np.arange(KINDS)
    rank[: int(LEAST * STEPS)] = _EMPTY
    return rank


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The table of ranks from all windows of all texts; each task sends one count for each entropy it met."""

    def run(batches):
        seen = np.zeros(KINDS, np.int64)
        for b in batches:
            held, n = [], 0
            for t in b.column("text").to_pylist():
                held.append(_raw(t))
                n += len(held[-1])
                if n > TOGETHER:
                    seen += counts(held)
                    held, n = [], 0
            seen += counts(held)
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(seen[met], pa.int64())], ["step", "n"])

    rows = docs.select(whole_text(text).alias("text")).mapInArrow(run, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(KINDS, np.int64)
    for r in rows:
        seen[r.step] = r.n
    return table(seen)


def ranks(sums: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Lower is rarer."""
    return rank[steps(sums)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at]
    words = np.ascontiguousarray(words).view("<u8").reshape(-1, WINDOW // 8)
    h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(WINDOW // 8):
        h = _mix(h ^ words[:, k]) + np.uint64(k)
    return _mix(h)


def _small(b: bytes) -> list[int]:
    """Hashes of a text's 8-byte windows, without repeats."""
    return [int.from_bytes(hashlib.sha256(w).digest()[:8], "little") for w in dict.fromkeys(b[i : i + 8] for i in range(max(1, len(b) - 7)))]


def features(texts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the selected features of each text, in order of place, without repeats within a text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size) - size
    small = np.flatnonzero((size > 0) & (size < WINDOW)).tolist()
    made = [_small(texts[k]) for k in small]
    doc, value = [np.repeat(np.array(small, np.int64), [len(m) for m in made])], [np.array([h for m in made for h in m], np.uint64)]
    place = [start[doc[0]] + np.concatenate([np.arange(len(m)) for m in made] or [np.zeros(0, np.int64)])]
    if len(data) >= WINDOW:
        n = len(data) - WINDOW + 1
        key = (ranks(window_sums(data), rank) << 40) | np.arange(n)
        own = _own(size, n)
        run = np.zeros(max(0, n - RUN + 1), bool)
        for s, z in zip(start.tolist(), size.tolist(), strict=True):
            if z >= WINDOW:
                run[s : max(s, s + z - WINDOW + 1 - RUN + 1)] = True
        key[~own] = _NONE
        low, width = key, 1
        while width < RUN and len(low) > width:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        mask = (np.int64(1) << 40) - 1
        points = np.bincount(low[run[: len(low)]] & mask, minlength=n) if width == RUN else np.zeros(n, np.int64)
        chosen = points >= POINTS
        chosen &= key >> 40 < _EMPTY
        big = np.flatnonzero(size >= WINDOW)
        if len(big):
            has = np.add.reduceat(chosen, start[big], dtype=np.int64)
            for k in big[has == 0].tolist():
                chosen[int(key[start[k] : start[k] + size[k] - WINDOW + 1].min()) & int(mask)] = True
        at = np.flatnonzero(chosen)
        doc.append(np.searchsorted(start, at, side="right") - 1)
        value.append(_hashes(data, at))
        place.append(at)
        # an empty text shares its start with the next text; the last of equal starts holds the byte
    doc, value, place = np.concatenate(doc), np.concatenate(value), np.concatenate(place)
    order = np.lexsort((place, value, doc))
    d, v = doc[order], value[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    order = order[first]
    order = order[np.lexsort((place[order], doc[order]))]
    return doc[order], value[order]


def inserted(texts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As features(), with the small windows after them in short texts."""
    doc, value = features(texts, rank)
    short = [k for k, t in enumerate(texts) if WINDOW <= len(t) < SHORT]
    made = [_small(texts[k]) for k in short]
    doc = np.concatenate([doc, np.repeat(np.array(short, np.int64), [len(m) for m in made])])
    value = np.concatenate([value, np.array([h for m in made for h in m], np.uint64)])
    order = np.argsort(doc, kind="stable")
    return doc[order], value[order]


def filters(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The chained filters of each text: an array of (filters, 256) bytes."""
    doc, value = inserted(texts, rank)
    n = np.bincount(doc, minlength=len(texts))
    chain = -(-n // PER_FILTER)
    first = np.cumsum(chain) - chain
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    short = np.fromiter((len(t) < SHORT for t in texts), bool, len(texts))
    where = first[doc] + np.where(short[doc], nth * chain[doc] // n[doc], nth // PER_FILTER)
    bits = np.zeros((int(chain.sum()), BITS), np.uint8)
    for k in range(HASHES):
        bits[where, (value >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = 1
    packed = np.packbits(bits, axis=1)
    return [packed[f : f + c] for f, c in zip(first.tolist(), chain.tolist(), strict=True)]


def to_string(chain: np.ndarray) -> str:
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def from_string(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s.partition(":")[2]), np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised bit overlap of two chains, 0 to 1."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if (len(a), int(np.bitwise_count(a).sum())) > (len(b), int(np.bitwise_count(b).sum())):
        a, b = b, a
    x, y = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    nx, ny = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
    best = np.zeros(len(x))
    for i in range(len(x)):
        for at in range(0, len(y), 4096):
            both = np.bitwise_count(y[at : at + 4096] & x[i]).sum(1, dtype=np.int64)
            least = np.minimum(ny[at : at + 4096], nx[i])
            chance = nx[i] * ny[at : at + 4096] / BITS
            room = np.maximum(least - chance, 1e-9)
            best[i] = max(best[i], float(np.max((both - chance) / room)))
    return float(np.clip((np.clip(best, 0, 1) * nx).sum() / nx.sum(), 0, 1))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points, rounded down, replaced by as many of the next text (or all it has)."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


def _raw(t: str) -> bytes:
    return t.encode("utf-8", "surrogatepass")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _run(batches, rank: np.ndarray):
    held: list[tuple[int | None, str]] = []
    held_bucket, held_bytes = None, 0

    def solve(rows, following):
        """following: the text after the last of rows; rows are consecutive."""
        if not rows:
            return
        own = [t for _, t in rows]
        after = [*own[1:], following]
        made = [edited(t, f) for t, f in zip(own, after, strict=True)]
        raw = [_raw(t) for t in made]
        chains = filters([_raw(t) for t in [*own, following]] + raw, rank)
        mine, edit = chains[: len(own) + 1], chains[len(own) + 1 :]
        cols = [
            [i for i, _ in rows], [len(t) for t in own], [hashlib.sha256(r).hexdigest() for r in raw], [to_string(c) for c in mine[:-1]], [to_string(c) for c in edit],
            [likeness(c, e) for c, e in zip(mine, edit, strict=False)], [likeness(c, d) for c, d in zip(mine, mine[1:], strict=False)],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _OUT.split(", ")])

    done = False  # the held bucket's following text has been met
    for b in batches:
        for bucket, side, i, t in zip(*(b.column(c).to_pylist() for c in ("_bucket", "_side", "doc_id", "text")), strict=True):
            if bucket != held_bucket:
                if held and not done:  # no bucket follows: only without other rows
                    yield from solve(held, held[0][1])
                held, held_bytes, held_bucket, done = [], 0, bucket, False
            if side == 1:
                if not done:
                    yield from solve(held, t)
                    done = True
                continue
            if held_bytes > TOGETHER:
                yield from solve(held, t)
                held, held_bytes = [], 0
            held.append((i, t))
            held_bytes += 2 * len(t)
    if held and not done:
        yield from solve(held, held[0][1])


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rank: np.ndarray | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are to each other and to the next document.

    The next document is the one of the next doc_id (null first, rows of one doc_id by their
    texts' digest); the first follows the last.  Texts are shuffled once, into ranges of doc_id.
    Without `rank`, the ranks are those of the documents themselves.
    """
    rank = rarity(docs, text) if rank is None else rank
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    key = F.concat(long_key(F.col("doc_id")), F.md5(F.col("text").cast("binary")))
    n = ranges_for(docs)
    dealt = ordered_buckets(base, key, n, before=False, after=True, wrap=True).select("_bucket", "_side", "doc_id", "text")
    return dealt.mapInArrow(lambda batches: _run(batches, rank), _OUT)
