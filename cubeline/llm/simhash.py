"""SimHash near-duplicates: fingerprints, and links found at the anchors of a covering code.

A fingerprint has 64 bits.  It is split into a left block (bits 0..30) and the rest (33 bits).
If two fingerprints differ in at most 2 bits, then either the left blocks differ in at most 1
bit or the rests are equal (2 differences in the left block leave none for the rest).

* Left block: the anchors are the 2**26 words of the binary Hamming code of length 31.  Its
  covering radius is 1, so each block has one home anchor; a block that differs from it in at
  most 1 bit lies within 1 + 1 = 2 of that anchor.  A fingerprint is hence written to every
  anchor within 2 (1 or 16 of them) and compared with those at home there.
* Rest: threshold 0, so the code of all words (radius 0) serves: the anchor is the rest itself.

At an anchor nothing is emitted for all pairs: a forest that joins the linked members is, with
at most one edge for each member.  The links themselves are all tested: small anchors by blocks
of XOR and bit counts, large ones by looking up each of the 2,081 words around a fingerprint,
which takes time in proportion to the members.  An anchor of more than `HOT` members is split
first: the bits that the anchor leaves free are cut into three parts, in one of which linked
members must agree, and each part's value makes an anchor of its own, of about a 1,024th of
the members or less.
Components come from alternating large-star and small-star rounds over the edges.

Equal fingerprints are one row from the start, so groups of copies cost nothing here.

Null text is empty; an empty text has fingerprint zero and links like any other.  A table
without rows gives none.  Repeated doc_ids come out as often as they went in; their copies
share the fingerprint's component.  Columns other than doc_id and text are ignored by
`near_duplicates` and kept by `one_of_each`, whatever they are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeline.llm.common import discard, free_names, joined_parts, stage, whole_text

LEFT = 31
SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Members of an anchor up to which all pairs of it are tested; beyond, neighbours are looked up.
PAIRWISE = 1024
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Texts of so many shingles are summed in parts.
_PART = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits; bit i is set if it is set in over half the shingles' XXH64."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    s, e = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    one = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _PART):
        h = np.array([one(joined[a:b], SEED) for a, b in zip(s[at : at + _PART], e[at : at + _PART], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for b in batches:
        texts = b.column("text").to_pylist()
        out = np.fromiter(map(fingerprint, texts), np.uint64, b.num_rows)
        digest = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out.view(np.int64)), pa.array(digest, pa.binary())], ["doc_id", "fp", "digest"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long), digest (MD5 of the text, to tell rows of one doc_id apart)."""
    return joined_parts(docs).select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long, digest binary")


# --- the covering code -------------------------------------------------------------------

_SYNDROME = [np.zeros(256, np.uint8) for _ in range(4)]
for _b in range(LEFT):
    for _v in range(256):
        if _v >> (_b % 8) & 1:
            _SYNDROME[_b // 8][_v] ^= _b + 1


def syndrome(left: np.ndarray) -> np.ndarray:
    """Of Hamming [31, 26]: the XOR of the numbers (from 1) of the bits set."""
    x = left.astype(np.uint32)
    out = np.zeros(len(x), np.uint8)
    for k in range(4):
        out ^= _SYNDROME[k][(x >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def home_anchors(left: np.ndarray) -> np.ndarray:
    """The one code word within 1."""
    s = syndrome(left).astype(np.int64)
    return np.where(s > 0, left ^ (np.int64(1) << np.maximum(s - 1, 0)), left)


def other_anchors(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of the code words at distance 2: pairs of bits whose numbers XOR to the syndrome."""
    s = syndrome(left).astype(np.int64)
    rows, found = [], []
    numbers = np.arange(1, LEFT + 1)
    for v in np.unique(s[s > 0]):
        at = np.flatnonzero(s == v)
        pairs = [(i, i ^ int(v)) for i in numbers if i < i ^ int(v) <= LEFT]
        flip = np.array([(1 << (int(i) - 1)) | (1 << (int(j) - 1)) for i, j in pairs], np.int64)
        rows.append(np.repeat(at, len(flip)))
        found.append((left[at][:, None] ^ flip[None, :]).ravel())
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(found)


def _replicas(batches):
    """fp -> (block, anchor, at home, fp)."""
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False)
        left = fp & np.int64((1 << LEFT) - 1)
        rest = (fp >> np.int64(LEFT)) & np.int64((1 << (64 - LEFT)) - 1)
        row, far = other_anchors(left)
        home = home_anchors(left)
        anchor = np.concatenate((home * 2, far * 2, rest * 2 + 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array(np.concatenate((np.ones(len(fp), bool), np.zeros(len(far), bool), np.ones(len(fp), bool)))), pa.array(np.concatenate((fp, fp[row], fp)))],
            ["anchor", "home", "fp"],
        )


# --- links at one anchor -------------------------------------------------------------------

_NEAR = np.array([0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)], dtype=np.uint64)


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _forest(home: np.ndarray, all_: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what is linked among home x all_; all_ is sorted, without repeats, and holds home."""
    parent = list(range(len(all_)))
    where = np.searchsorted(all_, home)
    edges = []

    def join(rows, cols):
        for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
            a, b = _root(parent, i), _root(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((int(all_[i]), int(all_[j])))

    if len(all_) <= PAIRWISE:
        step = max(1, (1 << 20) // len(all_))
        for at in range(0, len(home), step):
            i, j = np.nonzero(np.bitwise_count(home[at : at + step, None] ^ all_[None, :]) <= DISTANCE)
            off = where[at : at + step][i] != j
            join(where[at : at + step][i][off], j[off])
    else:
        for at in range(0, len(home), 256):
            around = home[at : at + 256, None] ^ _NEAR[None, 1:]
            p = np.searchsorted(all_, around)
            i, k = np.nonzero(all_[np.minimum(p, len(all_) - 1)] == around)
            join(where[at : at + 256][i], p[i, k])
    return edges


def _links(batches):
    """Rows sorted by anchor -> edges.  A run of one anchor may span batches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    held_anchor = None

    def out(edges):
        a = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        lo, hi = np.minimum(a[:, 0], a[:, 1]), np.maximum(a[:, 0], a[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["a", "b"])

    def solve(fp, home):
        mine = np.unique(fp[home])
        return _forest(mine, np.unique(fp)) if len(mine) and len(fp) > 1 else []

    for b in batches:
        anchor = b.column("anchor").to_numpy(zero_copy_only=False)
        home = b.column("home").to_numpy(zero_copy_only=False).astype(bool)
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(anchor):
            continue
        cut = np.flatnonzero(np.diff(anchor)) + 1
        starts = np.concatenate(([0], cut))
        ends = np.concatenate((cut, [len(anchor)]))
        edges = []
        if held_anchor is not None and anchor[0] != held_anchor:
            edges += solve(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        has_home = np.maximum.reduceat(home, starts)
        for k in np.flatnonzero((ends - starts > 1) & has_home).tolist():
            s, e = starts[k], ends[k]
            if (k == 0 and held) or k == len(starts) - 1:
                continue
            edges += solve(fp[s:e], home[s:e])
        first_end = ends[0]
        if len(starts) == 1:
            held.append((fp.copy(), home.copy()))
        else:
            if held:
                held.append((fp[:first_end], home[:first_end]))
                edges += solve(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = [(fp[starts[-1] :].copy(), home[starts[-1] :].copy())]
        held_anchor = anchor[-1]
        if edges:
            yield out(edges)
    if held and (edges := solve(*(np.concatenate(x) for x in zip(*held, strict=True)))):
        yield out(edges)


#: Members of an anchor beyond which it is split by more of its bits.
HOT = 200_000


def _split_hot(placed: DataFrame, hot: int) -> DataFrame:
    """Give the members of anchors over `hot` finer anchors: one for each of three parts of the bits an anchor leaves free.

    Two links differ in at most 2 bits, so in one of any three parts of the bits they agree.
    The members of a rest anchor (odd) have bits 31..63 in common, those of a left anchor bits 0..30 but for 2.
    """
    sizes = placed.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(F.col("anchor").alias("big"))
    cold = placed.join(sizes, placed.anchor == sizes.big, "left_anti")
    odd = F.col("anchor").bitwiseAND(1) == 1
    cut = lambda low, n: F.shiftrightunsigned("fp", low).bitwiseAND((1 << n) - 1)
    parts = [F.when(odd, cut(a, n)).otherwise(cut(b, 11)) for (a, n), b in zip(((0, 11), (11, 10), (21, 10)), (31, 42, 53), strict=True)]
    fine = placed.join(sizes, placed.anchor == sizes.big, "left_semi").select(
        F.explode(F.array(*[F.xxhash64("anchor", F.lit(k), p) for k, p in enumerate(parts)])).alias("anchor"), "home", "fp"
    )
    return cold.unionByName(fine)


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """fps: distinct fp.  Edges (a, b), both fingerprints, that join all that is linked."""
    placed = fps.mapInArrow(_replicas, "anchor long, home boolean, fp long")
    if hot:
        placed = _split_hot(stage(placed, "anchors"), hot)
    return placed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (v, root): the least vertex of each component, by alternating large and small stars until nothing changes.

    A round sends as many edges on as it got; what a vertex gathers is only its least
    neighbour, never a list.  Each round is written to the shared folder, and the one before it deleted.
    """
    e = stage(edges.select("a", "b").where("a <> b"), "edges", narrow=True)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: a neighbour above a vertex goes to the vertex's least neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: from each vertex, the lower neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        last, e = e, stage(small.distinct(), "stars", narrow=True)
        n, total = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(last)
        if (n, total) == before or not n:
            return e.select(F.col("a").alias("v"), F.col("b").alias("root"))
        before = (n, total)


def _rooted(prints: DataFrame, hot: int) -> DataFrame:
    """fp, least (doc_id), root: one row for each fingerprint."""
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes", narrow=True)
    forest = components(links(classes.select("fp"), hot))
    return classes.join(forest.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id that is reachable)."""
    prints = stage(fingerprints(docs, doc_id, text), "fingerprints", narrow=True)
    rooted = _rooted(prints, hot)
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """docs, all columns, with one row of each component: the least doc_id (null last), then the least MD5 of the text.

    The groups are settled on fingerprints; texts move once, dealt by doc_id, to meet the ids that stay.
    """
    prints = stage(fingerprints(docs, doc_id, text), "fingerprints", narrow=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest"))
    of_fp = prints.groupBy("fp").agg(first.alias("first"))
    rooted = _rooted(prints, hot).join(of_fp, "fp")
    one, md5, mark = free_names(docs, "one_id", "text_md5", "one_md5")
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(one), F.col("first.digest").alias(mark))
    keyed = docs.withColumn(md5, F.unhex(F.md5(whole_text(text).cast("binary"))))
    kept = keyed.join(stay.hint("shuffle_hash"), keyed[doc_id].cast("long").eqNullSafe(F.col(one)) & (F.col(md5) == F.col(mark)), "left_semi").drop(md5)
    twice = prints.groupBy("doc_id", "digest").count().where("count > 1")
    # one row repeated as a whole is rare; only then are the texts compared
    return kept if twice.isEmpty() else kept.dropDuplicates([doc_id, text])
