"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces of at most the greatest permitted length; pieces are dealt to
shards by a hash, and each shard is packed by itself, so a shard is one task's work and the
number of shards follows the input.  In a shard:

1. For every set of permitted lengths that may be opened, pieces are placed longest first: a
   piece goes to the open bin that it fills best (the least room left); if none has room, the
   bin of least cost a token is opened among the set's lengths that hold it (the least-cost
   length that holds it where the set has none).  Sets that open alike are one run.
2. Each bin is then downsized to the least-cost length that holds its contents.
3. The solution of least total cost is kept (the one with fewer bins on ties, then of the
   first set).

The cost of a bin is `overhead` plus its length by default, which stands for what a sequence
costs besides its tokens; any costs may be given.

`pack_texts` encodes whole texts with a tokenizer, ends each with `end` (so that every
document, an empty or null one too, has at least one token), and returns filled sequences:
their token ids, and of what documents, pieces and places they are made.  `segments` turns them
to one row for each piece.  `pack` does the same to lengths that are a column, without tokens.
A shard of texts holds about `SHARD_BYTES` of UTF-8, of which a byte-level vocabulary can't
make more tokens than bytes, so a shard's memory is bounded.

A null or non-positive length makes no piece.  Repeated rows are packed each.  A document of
any length is cut and packed whole.  Ties are broken by doc_id (null last), place and content,
so results don't depend on partitioning.  An empty table gives no rows.  Columns other than
the id and the text (or those the length is made of) stay out of the result.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeline.llm.common import whole_text
from cubeline.llm.token_counts import encoder

LENGTHS = (1024, 2048, 4096, 8192, 16384)
OVERHEAD = 64
#: Pieces of a shard of lengths, and bytes of a shard of texts, about.
SHARD, SHARD_BYTES = 8_192, 4 << 20
#: Permitted lengths at most: every set of them is looked at.
MOST_LENGTHS = 12


def costs_of(lengths: Sequence[int], overhead: float = OVERHEAD) -> dict[int, float]:
    return {n: overhead + n for n in lengths}


def openings(cost: dict[int, float]) -> list[tuple[int, ...]]:
    """The ways to open bins, each once: for a piece of up to each length in turn, the length that is opened.

    One for each set of lengths that may be opened, as long as it differs from those before.
    """
    lengths, ways = sorted(cost), {}
    for mask in range(1, 1 << len(lengths)):
        may = [n for i, n in enumerate(lengths) if mask >> i & 1]
        way = []
        for n in lengths:
            fit = [m for m in may if m >= n]
            way.append(min(fit, key=lambda m: (cost[m] / m, -m)) if fit else min((m for m in lengths if m >= n), key=lambda m: (cost[m], m)))
        ways.setdefault(tuple(way))
    return list(ways)


def _place(sizes: list[int], lengths: list[int], way: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """(bin of each size, contents of each bin); sizes fall."""
    at: dict[int, list[int]] = {}
    contents: list[int] = []
    mask = 0  # bit r: some open bin has room r
    out = []
    for s in sizes:
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = at[room].pop()
            if not at[room]:
                mask &= ~(1 << room)
        else:
            room = way[bisect_left(lengths, s)]
            b = len(contents)
            contents.append(0)
        room -= s
        contents[b] += s
        out.append(b)
        if room:
            at.setdefault(room, []).append(b)
            mask |= 1 << room
    return out, contents


def solve(sizes: Sequence[int], cost: dict[int, float]) -> tuple[list[int], list[int], float]:
    """(bin of each size, length of each bin, total cost) for sizes in falling order."""
    lengths = sorted(cost)
    fit: dict[int, int] = {}

    def downsized(c: int) -> int:
        if c not in fit:
            fit[c] = min((n for n in lengths if n >= c), key=lambda n: (cost[n], n))
        return fit[c]

    best = None
    for k, way in enumerate(openings(cost)):
        where, contents = _place(list(sizes), lengths, way)
        bins = [downsized(c) for c in contents]
        key = (math.fsum(cost[n] for n in bins), len(bins), k)
        if best is None or key < best[0]:
            best = (key, where, bins)
    return best[1], best[2], best[0][0]


def _checked(lengths: Sequence[int], costs: dict[int, float] | None) -> dict[int, float]:
    if not lengths or min(lengths) < 1 or len(set(lengths)) > MOST_LENGTHS:
        raise ValueError(f"lengths must be positive, and {MOST_LENGTHS} at most")
    cost = dict(costs) if costs else costs_of(lengths)
    if sorted(cost) != sorted(set(lengths)) or min(cost.values()) <= 0:
        raise ValueError("every permitted length needs a positive cost")
    return cost


def _offsets(where: list[int], sizes: list[int], bins: int) -> list[int]:
    """Where in its bin each size begins."""
    used, out = [0] * bins, []
    for b, s in zip(where, sizes, strict=True):
        out.append(used[b])
        used[b] += s
    return out


def _order(doc: pa.ChunkedArray, piece: np.ndarray, size: np.ndarray, *more: np.ndarray) -> np.ndarray:
    ids = doc.to_pandas()
    return np.lexsort((*more, piece, ids.fillna(0).astype("int64").to_numpy(), ids.isna().to_numpy(), -size))


def pieces(docs: DataFrame, length: Column, most: int, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, n_tokens: each document cut at `most`."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), length.cast("long").alias("_n")).where("_n > 0")
    last = F.floor((F.col("_n") - 1) / most).cast("int")
    cut = base.select("doc_id", "_n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * most
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(most).cast("long"), F.col("_n") - start).alias("n_tokens"))


_OUT = "doc_id long, piece int, start long, n_tokens long, shard int, bin int, bin_length long, bin_offset long"


def pack(docs: DataFrame, length: Column, lengths: Sequence[int] = LENGTHS, costs: dict[int, float] | None = None, doc_id: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """One row for each piece: where its tokens are in the document, its bin, and where in the bin."""
    cost = _checked(lengths, costs)
    most = max(lengths)
    cut = pieces(docs, length, most, doc_id)
    n = docs.select(F.sum(F.floor((F.greatest(length.cast("long"), F.lit(0)) + most - 1) / most))).first()[0] or 0
    shards = max(1, -(-int(n) // shard))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        piece, size = table.column("piece").to_numpy(), table.column("n_tokens").to_numpy()
        order = _order(table.column("doc_id"), piece, size)
        sizes = size[order].tolist()
        where, bins, _ = solve(sizes, cost)
        t = table.take(pa.array(order))
        cols = [t.column(c) for c in ("doc_id", "piece", "start", "n_tokens", "shard")]
        at = np.array(where, np.int32)
        return pa.table([*cols, pa.array(at), pa.array(np.array(bins, np.int64)[at]), pa.array(_offsets(where, sizes, len(bins)), pa.int64())], names=[x.split()[0] for x in _OUT.split(", ")])

    return dealt.groupBy("shard").applyInArrow(run, _OUT)


def _cut(tokenizer: str, end: int | None, most: int):
    """doc_id, text -> doc_id, piece, start, ids (32-bit numbers, little-endian)."""
    names = ["doc_id", "piece", "start", "ids"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        rows, held = [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.array(encode(t), "<i4")
                if end is not None:
                    ids = np.append(ids, np.int32(end)).astype("<i4")
                for k, at in enumerate(range(0, len(ids), most)):
                    rows.append((i, k, at, ids[at : at + most].tobytes()))
                    held += len(rows[-1][3])
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


_SEQUENCES = "shard int, bin int, bin_length long, n_tokens long, ids array<int>, doc_ids array<long>, pieces array<int>, starts array<long>, offsets array<long>"


def _filled(cost: dict[int, float]):
    def run(table: pa.Table) -> pa.Table:
        raw = table.column("ids").to_pylist()
        size = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
        piece = table.column("piece").to_numpy()
        order = _order(table.column("doc_id"), piece, size, np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)))
        sizes = size[order].tolist()
        where, bins, _ = solve(sizes, cost)
        member = np.argsort(np.array(where), kind="stable")  # pieces by bin, in the order they came
        turn = order[member]
        count = np.bincount(where, minlength=len(bins))
        edge = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
        held = np.bincount(where, weights=sizes, minlength=len(bins)).astype(np.int64)
        ids = np.frombuffer(b"".join([raw[k] for k in turn.tolist()]), "<i4")
        t = table.take(pa.array(turn))
        column = lambda c: t.column(c).combine_chunks()
        return pa.table(
            [
                pa.array(np.full(len(bins), table.column("shard")[0].as_py(), np.int32)), pa.array(np.arange(len(bins), dtype=np.int32)), pa.array(bins, pa.int64()), pa.array(held),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held))), pa.int32()), pa.array(ids.astype(np.int32))),
                pa.ListArray.from_arrays(edge, column("doc_id")), pa.ListArray.from_arrays(edge, column("piece")), pa.ListArray.from_arrays(edge, column("start")),
                pa.ListArray.from_arrays(edge, pa.array(np.array(_offsets(where, sizes, len(bins)), np.int64)[member])),
            ],
            names=[x.split()[0] for x in _SEQUENCES.split(", ")],
        )

    return run


def pack_texts(
    docs: DataFrame, tokenizer: str, end: int | None, lengths: Sequence[int] = LENGTHS, costs: dict[int, float] | None = None, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """One row for each sequence: its permitted length, the token ids that fill it, and the documents, pieces, places in
    the document and places in the sequence of its parts.  Texts are read twice (once for their sizes alone); token ids
    move once.
    """
    cost = _checked(lengths, costs)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    n = base.select(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    shards = max(1, -(-int(n) // shard_bytes))
    cut = base.mapInArrow(_cut(tokenizer, end, max(lengths)), "doc_id long, piece int, start long, ids binary")
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(_filled(cost), _SEQUENCES)


def segments(packed: DataFrame) -> DataFrame:
    """doc_id, piece, start, n_tokens, shard, bin, bin_length, bin_offset: one row for each piece of the sequences."""
    end = F.concat(F.slice("offsets", 2, F.size("offsets")), F.array("n_tokens"))
    size = F.zip_with(end, "offsets", lambda b, a: b - a)
    zipped = F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("pieces").alias("piece"), F.col("starts").alias("start"), size.alias("n_tokens"), F.col("offsets").alias("bin_offset"))
    return packed.select("shard", "bin", "bin_length", F.inline(zipped)).select("doc_id", "piece", "start", "n_tokens", "shard", "bin", "bin_length", "bin_offset")
