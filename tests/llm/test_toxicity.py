import random
import zlib

import numpy as np

from cubeline.llm import toxicity as T


def made(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeinorstlh", k=rng.randint(2, 8))) for _ in range(400)]
    bad = ["grubnak", "folzwit", "skarvent"]
    out = []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        t = rng.choices(words, k=rng.randint(8, 120))
        for _ in range(toxic * rng.randint(1, 4)):
            t.insert(rng.randrange(len(t)), rng.choice(bad) + rng.choice(("", "s", "ing")))
        out.append((i, " ".join(t), toxic))
    return out


def test_held_out_accuracy(spark):
    rows = made(900)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows] + [(rows[0][0], None), (None, 1)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    got = {r.doc_id: r for r in T.scores(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and np.mean([got[i].predicted == rows[i][2] for i in held]) > 0.97
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in got.values())
    # held-out labels are not read
    flipped = spark.createDataFrame([(i, 1 - k if i in set(held) else k) for i, _, k in rows], "doc_id long, toxic int")
    other = T.train(docs, flipped)
    assert other[0] == model[0] and (other[2] == model[2]).all()


def test_held_out_column(spark):
    df = spark.createDataFrame([(i,) for i in [*range(50), -3, None]], "doc_id long").withColumn("h", T.held_out(__import__("pyspark.sql.functions", fromlist=["col"]).col("doc_id")))
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in df.collect())


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "word " * 60_000), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.scores(docs, T.train(docs, none)).count() == 5
    one = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = T.scores(docs, T.train(docs, one)).collect()
    assert len({r.score for r in got}) == 1 and got[0].score < 0.5
    assert T.scores(docs.limit(0), T.train(docs.limit(0), one)).count() == 0


def test_ratio_against_by_hand():
    texts, y = ["bad word", "bad thing", "fine word", "fine thing", "ok"], np.array([1, 1, 0, 0, 0])
    b, kept, w = T.fit(texts, y)
    s = T.scorer((b, kept, w))
    assert s("bad") > 0.5 > s("fine") and s("") == s("?!")


def test_fit_ends_at_the_optimum():
    """Labels that separate badly; the gradient by hand at the fitted weights."""
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(150)]
    texts = [" ".join(rng.choice(vocabulary, 12)) for _ in range(600)]
    y = np.array([int((vocabulary[0] in t) ^ (rng.random() < 0.4)) for t in texts])
    b, kept, weights = T.fit(texts, y)
    x = np.array([np.isin(kept, T.cells(t)) for t in texts], float)
    r = np.log((x[y == 1].sum(0) + 1) / (y.sum() + 2)) - np.log((x[y == 0].sum(0) + 1) / ((1 - y).sum() + 2))

    def gradient(b, w):
        e = 1 / (1 + np.exp(-(b + x @ (w * r)))) - y
        return np.linalg.norm([*(r * (e @ x) + T.PENALTY * w), e.sum()])

    w = np.divide(weights, r, out=np.zeros(len(r)), where=r != 0)
    assert gradient(b, w) <= 2e-4 * gradient(np.log(y.sum() / (1 - y).sum()), np.zeros(len(r)))


def grams(text):
    """The 4- and 5-grams by plain strings."""
    s = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    return {s[i : i + n] for n in (4, 5) for i in range(len(s) - n + 1)}


def test_scores_against_brute_force():
    """Counts, ratios and the fit by plain strings and Newton's method, for texts whose grams all count."""
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(40)]
    texts = [" ".join(rng.choice(vocabulary, 6)) for _ in range(120)]
    y = np.array([int((vocabulary[0] in t or vocabulary[1] in t) ^ (rng.random() < 0.1)) for t in texts])
    rows = [grams(t) for t in texts]
    names = sorted(set().union(*rows))
    x = np.array([[g in r for g in names] for r in rows], float)
    r = np.log((x[y == 1].sum(0) + 1) / (y.sum() + 2)) - np.log((x[y == 0].sum(0) + 1) / ((1 - y).sum() + 2))
    z = np.column_stack([x * r, np.ones(len(texts))])
    w = np.zeros(z.shape[1])
    penalty = np.append(np.full(len(names), T.PENALTY), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
    model = T.fit(texts, y)
    assert len(model[1]) == len(names)  # no two grams share a cell here
    score = T.scorer(model)
    for t in [*texts, "", "none of these", " ".join(vocabulary)]:
        have = grams(t)
        want = 1 / (1 + np.exp(-(np.append([g in have for g in names] * r, 1) @ w)))
        assert abs(score(t) - want) < 5e-3, t


def test_query_on_the_table(spark):
    """Held-out accuracy on the labelled documents of the table."""
    from cubeline.llm.queries import op7_toxicity

    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = {r.doc_id: r for r in op7_toxicity(spark, d).collect()}
    held = [i for i, r in got.items() if r.held_out and i in labels]
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count() and len(held) > 10
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.85


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a", 7, 8)], "doc_id long, text string, score int, predicted int")
    assert T.scores(docs, (0.0, np.zeros(0, np.int64), np.zeros(0)), keep=("doc_id", "score", "predicted")).columns == ["doc_id", "score", "predicted"]
    assert T.accepted(docs, (-1.0, np.zeros(0, np.int64), np.zeros(0))).collect() == docs.collect()
