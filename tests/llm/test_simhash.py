import random

import numpy as np
import xxhash

from cubeline.llm import simhash as S


def brute(fps):
    n, root = len(fps), list(range(len(fps)))
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = S._root(root, i), S._root(root, j)
                root[max(a, b)] = min(a, b)
    return [S._root(root, i) for i in range(n)]


def test_fingerprint_by_hand():
    text = "One TWO three\tfour\nÉté "
    words = "one two three four Été".split(" ")
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(3)]
    want = sum((sum(x >> k & 1 for x in h) * 2 > 3) << k for k in range(64))
    assert S.fingerprint(text) == want
    assert S.fingerprint("Two words") == xxhash.xxh64_intdigest("two words", 42)
    assert S.fingerprint(" \n") == 0 == S.fingerprint("")


def test_code_covers():
    rng = np.random.default_rng(1)
    left = rng.integers(0, 1 << 31, 300)
    home = S.home_anchors(left)
    assert (np.bitwise_count(home ^ left) <= 1).all() and (S.syndrome(home) == 0).all()
    row, far = S.other_anchors(left)
    assert (np.bitwise_count(left[row] ^ far) == 2).all() and (S.syndrome(far) == 0).all()
    for bit in range(31):  # a word one bit away meets the home anchor
        other = left ^ (1 << bit)
        r, f = S.other_anchors(other)
        met = {(int(i), int(a)) for i, a in zip(r, f, strict=True)} | set(enumerate(S.home_anchors(other).tolist()))
        assert all((i, int(a)) in met for i, a in enumerate(home))


def planted(n=120, seed=3):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):  # chains of 1 and 2 bits, anywhere
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.choice((1, 2))):
            x ^= 1 << b
        fps.append(x)
    return sorted(set(fps))


def components_of(spark, fps, **kw):
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    got = {r.v: r.root for r in S.components(S.links(df, **kw)).collect()}
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    want = brute(fps)
    groups = {}
    for v, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(v)
    mine = {}
    for v in signed:
        mine.setdefault(got.get(v, v), set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_links_against_brute_force(spark):
    components_of(spark, planted())


def test_hot_anchor(spark, monkeypatch):
    fps = sorted({0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) | (1 << k) for i, j, k in [(1, 2, 3), (40, 50, 60), (9, 50, 51)])})
    components_of(spark, fps, hot=5)


def test_hot_anchors_are_split(spark):
    """Members of one anchor, of either kind, end up in small groups, and no link is lost."""
    rng = random.Random(9)
    one_rest = [(12345 << 31) | rng.getrandbits(31) for _ in range(1500)]  # a rest anchor for all
    one_left = [(rng.getrandbits(33) << 31) | 777 for _ in range(1500)]  # a left block for all
    near = [x ^ (1 << rng.randrange(64)) for x in (one_rest + one_left)[::30]]
    fps = sorted({*one_rest, *one_left, *near})
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    placed = df.mapInArrow(S._replicas, "anchor long, home boolean, fp long")
    assert placed.groupBy("anchor").count().agg({"count": "max"}).first()[0] >= 1500
    assert S._split_hot(placed, 200).groupBy("anchor").count().agg({"count": "max"}).first()[0] <= 200
    components_of(spark, fps, hot=200)


def test_large_anchor_by_lookup(monkeypatch):
    monkeypatch.setattr(S, "PAIRWISE", 4)
    fps = np.unique(np.array(planted(30, 5), dtype=np.uint64))
    root = list(range(len(fps)))
    at = {int(x): i for i, x in enumerate(fps)}
    for a, b in S._forest(fps, fps):
        i, j = S._root(root, at[a]), S._root(root, at[b])
        root[max(i, j)] = min(i, j)
    assert [S._root(root, i) for i in range(len(fps))] == brute([int(x) for x in fps])


def test_edge_cases(spark):
    long_text = " ".join(f"w{i % 977}" for i in range(150_000))
    rows = [(5, None, 1), (3, "", 1), (9, "a b c d", 1), (9, "a b c d", 2), (7, "A b C d", 1), (1, long_text, 0), (None, "other words here", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in S.near_duplicates(df).collect())
    assert len(got) == 7
    by = {r[0]: r for r in got}
    assert by["5"][1] == "0" * 16 and by["5"][2] == "3" == by["3"][2]
    assert by["9"][2] == "7" == by["7"][2] and by["1"][2] == "1"
    assert S.near_duplicates(df.limit(0)).count() == 0
    clash = df.selectExpr("doc_id", "text", "fp one_id", "'m' text_md5", "fp one_md5", "fp _one_id")
    kept = S.one_of_each(clash)
    assert kept.columns == clash.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "7", "None"]


def test_staged_rounds_are_deleted(spark):
    import os

    from cubeline.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:") + "/cubeline"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    got = S.components(edges)
    assert {r.root for r in got.collect()} == {0} and got.count() == 40  # a path
    kinds = [n.split("-")[0] for n in set(os.listdir(folder)) - before]
    assert kinds == ["stars"]  # the last round alone
