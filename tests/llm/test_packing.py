import itertools
import random

import pytest
from public_tokenizers import path as P_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cubeline.llm import packing as P


def plain(sizes, cost):
    """The same rules by plain search, over every set of lengths that may be opened."""
    lengths, best = sorted(cost), None
    for r in range(1, len(lengths) + 1):
        for chosen in itertools.combinations(lengths, r):
            bins = []
            for s in sizes:
                fits = [b[0] for b in bins if b[0] >= s]
                if fits:
                    b = max((b for b in bins if b[0] == min(fits)), key=lambda b: b[2])  # the last to get this room
                else:
                    may = [n for n in chosen if n >= s]
                    n = min(may, key=lambda n: (cost[n] / n, -n)) if may else min((n for n in lengths if n >= s), key=lambda n: (cost[n], n))
                    b = [n, 0, 0]
                    bins.append(b)
                b[0] -= s
                b[1] += s
                b[2] = next(counter)
            total = sum(min(cost[n] for n in lengths if n >= b[1]) for b in bins)
            best = total if best is None else min(best, total)
    return best


counter = itertools.count(1)


def optimum(sizes, cost):
    """Least cost over all partitions of a few sizes."""
    best = {0: 0.0}
    n = len(sizes)
    for mask in range(1, 1 << n):
        low = mask & -mask
        sub, out = mask, float("inf")
        while sub:
            if sub & low:
                c = sum(sizes[i] for i in range(n) if sub >> i & 1)
                fit = [cost[k] for k in cost if k >= c]
                if fit:
                    out = min(out, min(fit) + best[mask ^ sub])
            sub = (sub - 1) & mask
        best[mask] = out
    return best[(1 << n) - 1]


def test_against_plain_rules_and_optimum():
    rng, over = random.Random(1), []
    for trial in range(200):
        cost = P.costs_of((8, 16, 40), rng.choice((0, 1, 4))) if trial % 2 else {n: rng.uniform(0.3, 1.5) * n for n in (8, 16, 24, 40)}
        sizes = sorted((rng.randint(1, 40) for _ in range(rng.randint(1, 9))), reverse=True)
        where, bins, total = P.solve(sizes, cost)
        held = [0] * len(bins)
        for b, s in zip(where, sizes):
            held[b] += s
        assert all(0 < h <= n for h, n in zip(held, bins))
        assert all(cost[n] == min(cost[m] for m in cost if m >= h) for h, n in zip(held, bins))
        assert total == sum(cost[n] for n in bins)
        assert total == pytest.approx(plain(sizes, cost))
        best = optimum(sizes, cost)
        assert best - 1e-9 <= total <= 1.6 * best
        over.append(total / best)
    assert sum(over) / len(over) < 1.06 and sum(x < 1 + 1e-9 for x in over) > 100


def test_several_lengths_beat_one():
    rng = random.Random(2)
    sizes = sorted((min(16384, int(rng.lognormvariate(7, 1.2)) + 1) for _ in range(3000)), reverse=True)
    many, one = P.solve(sizes, P.costs_of(P.LENGTHS))[2], P.solve(sizes, P.costs_of((16384,)))[2]
    assert sum(sizes) <= many <= one * 1.02 and many / sum(sizes) < 1.1


def test_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(1, 90), 7) for i in range(500)] + [(1000, None, 7), (1001, 0, 7), (1002, 1000, 7), (None, 5, 7), (3, 4, 7), (3, 4, 7)]
    df = spark.createDataFrame(rows, "doc_id long, n long, bin int")
    got = P.pack(df, F.col("n"), (8, 16, 32), shard=100).collect()
    want = {}
    for i, n, _ in rows:
        if n and n > 0:
            want[i] = want.get(i, 0) + n
    have = {}
    bins = {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.n_tokens
        bins.setdefault((r.shard, r.bin), []).append(r)
        assert r.start == r.piece * 32 and r.n_tokens <= 32
    assert have == want and len({r.shard for r in got}) > 5
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert at <= rs[0].bin_length and len({r.bin_length for r in rs}) == 1
    again = P.pack(df.repartition(7), F.col("n"), (8, 16, 32), shard=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert P.pack(df.limit(0), F.col("n")).count() == 0
    with pytest.raises(ValueError):
        P.pack(df, F.col("n"), (8,), {8: 0.0})


def test_sets_of_lengths_are_searched():
    assert set(P.openings({4: 5.0, 8: 8.0, 16: 17.0})) == {(4, 8, 16), (8, 8, 16), (16, 16, 16)}
    assert len(P.openings(P.costs_of(P.LENGTHS))) == 5  # longer is always cheaper a token: only the longest of a set counts
    # here the sets that leave out the least length or the middle one open otherwise than any run from the least one up
    assert set(P.openings({4: 4.0, 8: 9.6, 16: 20.0})) == {(4, 8, 16), (8, 8, 16), (16, 16, 16), (4, 16, 16)}


def test_sequences_hold_every_token_once(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(("alpha", "beta", "日本", "gamma,", "\n", "<|endoftext|>"), k=rng.randint(0, 90))) for _ in range(300)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(1000, None, 1), (1001, "", 1), (1002, "long text " * 4000, 1), (None, "no id", 1), (7, texts[7], 1), (7, "other", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    path, end = P_path("byte_bpe_50k.json"), 50_256
    library = Tokenizer.from_file(path)
    packed = P.pack_texts(df, path, end, (64, 128, 256), shard_bytes=8_000)
    got = packed.collect()
    want = sorted((str(i), [*library.encode(t or "", add_special_tokens=False).ids, end]) for i, t, _ in rows)
    have = {}
    for r in got:
        assert len(r.ids) == r.n_tokens <= r.bin_length and r.bin_length == min(n for n in (64, 128, 256) if n >= r.n_tokens)
        assert len(r.doc_ids) == len(r.pieces) == len(r.starts) == len(r.offsets) and r.offsets[0] == 0
        for i, k, at, a, b in zip(r.doc_ids, r.pieces, r.starts, r.offsets, [*r.offsets[1:], r.n_tokens]):
            assert at == 256 * k
            have.setdefault((str(i), at), []).append(r.ids[a:b])
    twice = {"7"}
    whole = sorted((i, sum((have[i, at][0] for j, at in sorted(have) if j == i), [])) for i in {i for i, _ in have} - twice)
    assert whole == [w for w in want if w[0] not in twice]
    assert sorted(have["7", 0]) == sorted(w[1] for w in want if w[0] == "7")
    assert len({r.shard for r in got}) > 3
    again = P.pack_texts(df.repartition(7), path, end, (64, 128, 256), shard_bytes=8_000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    one = sorted((str(r.doc_id), r.start, r.n_tokens, r.bin, r.bin_offset) for r in P.segments(packed).collect())
    assert one == sorted((str(i), at, b - a, r.bin, a) for r in got for i, at, a, b in zip(r.doc_ids, r.starts, r.offsets, [*r.offsets[1:], r.n_tokens]))
    # each shard is packed as brute force packs its lengths
    for shard in {r.shard for r in got}:
        mine = [r for r in got if r.shard == shard]
        sizes = sorted((b - a for r in mine for a, b in zip(r.offsets, [*r.offsets[1:], r.n_tokens])), reverse=True)
        cost = P.costs_of((64, 128, 256))
        assert sum(cost[r.bin_length] for r in mine) == pytest.approx(plain(sizes, cost))
    assert P.pack_texts(df.limit(0), path, end).count() == 0


def test_query_packs_the_whole_table(spark):
    from cubeline.llm.queries import op3_best_fit_packing

    got = op3_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    library = Tokenizer.from_file(P_path("byte_bpe_50k.json"))
    size = {}
    for r in got:
        for i, a, b in zip(r.doc_ids, r.offsets, [*r.offsets[1:], r.n_tokens]):
            size[i] = size.get(i, 0) + b - a
    assert size == {d.doc_id: len(library.encode(d.text or "", add_special_tokens=False).ids) + 1 for d in docs}
