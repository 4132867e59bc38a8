import hashlib
import math
import random
import re
import string

from cubeline.llm import secrets as S


def base_by_hand(t):
    out = []
    for k, p in enumerate((r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+")):
        for m in re.finditer(p, t, re.I | re.A if k == 0 else 0):
            if len(m[2 if k == 0 else 0]) >= (12, 18, 16)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_by_hand():
    rng = random.Random(2)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "abc", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "AKIAAKIA", "ſecret", "toKen", "deadbeef", "é", "\n", "xyz_-./+="]
    for _ in range(4000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert S.base_spans(t) == base_by_hand(t), t
    assert S.base_spans("token=secret: abcdefghijklmn") == []  # the short value is used up


ALPHABET = string.ascii_letters + string.digits + "+/"


def state(c):
    return ALPHABET.index(c) if c in ALPHABET else 63


def plain_ratio(samples, s):
    """Log-likelihood ratio from counts kept in dictionaries."""
    counts = [{}, {}]
    for t, k in samples:
        for a, b in zip(t, t[1:]):
            row = counts[k].setdefault(state(a), {})
            row[state(b)] = row.get(state(b), 0) + 1
    total = 0.0
    for a, b in zip(s, s[1:]):
        p = [(c.get(state(a), {}).get(state(b), 0) + 0.1) / (sum(c.get(state(a), {}).values()) + 6.4) for c in counts]
        total += math.log(p[1]) - math.log(p[0])
    return total


def test_every_span_against_brute_force():
    rng = random.Random(7)
    samples = S.labelled(["information", "government", "possible", "tionsmente"], ["9f8e7d6c5b4a39281706"])[::40]
    model = S.train(samples)
    score = S.scorer(model)
    parts = ["information_of_the", "xK9Qz7", "token=", "password: ", "9f8e7d6c5b4a39281706", "AKIAQWERTY12345678", "4652511922028856", " ", " ", ".", "é", "Wq_z-T", "governmentInformation", "kjhqwxzvbnmp", "\n"]
    seen = 0
    for _ in range(900):
        t = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        base = base_by_hand(t)
        more = []
        at = 0
        while at < len(t):  # runs character by character
            end = at
            while end < len(t) and (t[end] in ALPHABET or t[end] in "_-"):
                end += 1
            if end - at >= 12 and plain_ratio(samples, t[at:end]) > S.THRESHOLD:
                more.append((at, 3, end))
            at = max(end, at + 1)
        assert S.spans(t, score) == (base, sorted(base + more)), t
        seen += len(more)
    assert seen > 200


def test_models():
    rng = random.Random(99)
    words = ["".join(rng.choices(("con", "ti", "ment", "er", "pro", "re", "la", "tion", "de", "sta", "al", "us"), k=rng.randint(3, 5))) for _ in range(400)]
    model = S.train(S.labelled(words, []))
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=40)) for _ in range(200)]
    assert sum(S.ratio(model, k) > S.THRESHOLD for k in keys) >= 198
    letters = ["".join(rng.choices(string.ascii_letters, k=20)) for _ in range(200)]
    assert sum(S.ratio(model, k) > S.THRESHOLD for k in letters) >= 190  # no digit is asked for
    names = S.identifiers(words, seed=77)
    assert sum(S.ratio(model, n) > S.THRESHOLD for n in names) <= len(names) * 0.005
    score = S.scorer(model)
    t = f"see {keys[0]} and customer_account_reference_2024 é"
    base, every = S.spans(t, score)
    assert base == [] and every == [(4, 3, 44)]
    assert S.hide(t, every) == "see [SECRET] and customer_account_reference_2024 é"
    t2 = 'token = "0f1e2d3c4b5a69788796" x'
    assert [k for _, k, _ in S.spans(t2, score)[1]] == [0, 2, 3] and S.hide(t2, S.spans(t2, score)[1]) == 'token = "[SECRET]" x'
    part = "deadbeefdeadbeef" + keys[1]  # a pattern takes a part of the run, the models the whole
    assert [k for _, k, _ in S.spans(part, score)[1]] == [2, 3] or part[16] in "0123456789abcdef"
    assert S.hide(part, S.spans(part, score)[1]) == "[SECRET]"
    assert S.ratio(model, "") == 0.0


def test_held_out_precision_and_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    strings = S.sample(docs)
    assert {k for _, k in strings} == {0, 1} and len(strings) <= S.STRINGS
    q = S.quality(strings)
    assert q["n"] > 5_000 and q["precision"] > 0.995 and q["recall"] > 0.99
    got = S.scan(docs, S.train_from(docs)).where("n_assign > 0").collect()
    assert got and all(r.n_markov >= r.n_assign for r in got)  # the models find the planted keys by themselves
    assert S.scan(docs, S.train_from(docs)).where("n_assign = 0 and n_access = 0 and n_markov > 0").count() == 0


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(" ".join(f"word{chr(97 + i % 26)}{chr(97 + j % 26)}abcdef" for i in range(26)),) for j in range(30)], "text string")
    assert len(S.sample(df, strings=50)) == 50 and S.sample(df.limit(0)) == []


def test_columns(spark):
    rows = [(1, 'password="abcdefghijkl1"', "x"), (2, None, "x"), (3, "", "x"), (4, "AKIA" + "Q" * 14, "x"), (4, "AKIA" + "Q" * 14, "x"), (5, "word " * 50_000 + "0123456789abcdef", "x"), (None, "ſecret=aaaaaaaaaaaaaaaa", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    model = S.train_from(df)
    got = {r.doc_id: r for r in S.scan(df, model).collect()}
    for i, t, _ in rows:
        base = base_by_hand(t or "")
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in base) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
    assert got[1].spans.split(",")[0] == "assign:0:23" and S.scan(df, model).count() == 7
    assert S.scan(df.limit(0), S.train_from(df.limit(0))).count() == 0
    clean = {r.doc_id: r.text for r in S.redacted(df, model).collect()}
    assert clean[1] == 'password="[SECRET]"' and clean[2] is None and clean[3] == "" and clean[4] == "[SECRET]"
