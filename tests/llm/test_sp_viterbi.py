import random
from array import array

import public_tokenizers as P
import pytest
import sentencepiece

from cubeline.llm import sp_viterbi as V

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def m():
    return V.model(PATH)


def as_unigram(path):
    """The same file with its kind set to unigram: field 2 (trainer), field 3 = 1."""

    def varint(n):
        out = b""
        while n > 127:
            out += bytes((n & 127 | 128,))
            n >>= 7
        return out + bytes((n,))

    def message(fields):
        out = b""
        for f, w, v in fields:
            out += varint(f << 3 | w) + (varint(v) if w == 0 else varint(len(v)) + v if w == 2 else v)
        return out

    fields = []
    for f, w, v in V._fields(open(path, "rb").read()):
        if f == 2:
            v = message([(a, b, 1 if a == 3 else c) for a, b, c in V._fields(v)])
        fields.append((f, w, v))
    return message(fields)


def whole(m, s):
    """Viterbi over the whole text at once."""
    best, back = [0.0] + [None] * len(s), [None] * (len(s) + 1)
    for p in range(len(s)):
        single = False
        for e in range(p + 1, min(len(s), p + m.longest) + 1):
            if hit := m.trie.get(s[p:e]):
                single = single or e == p + 1
                if best[e] is None or best[p] + hit[1] > best[e]:
                    best[e], back[e] = best[p] + hit[1], (p, hit[0])
        if not single and (best[p + 1] is None or best[p] + m.unknown_score > best[p + 1]):
            best[p + 1], back[p + 1] = best[p] + m.unknown_score, (p, -1)
    out, at = [], len(s)
    while at:
        p, i = back[at]
        out += [m.byte[b] for b in reversed(s[p:at].encode())] if i < 0 else [i]
        at = p
    return out[::-1]


TEXTS = ["", " ", "a", "Hello  world", "  two  spaces ", "line\none\ttab", "<s> </s> <unk> <0x41>", "日本語 テキスト é ﬁ", "👩‍👩‍👧 x", "unbelievably-long/identifiers_with.dots", "naïve café", "123456 7,890.12", "▁ already"]


def test_as_the_library(m):
    sp = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(PATH))
    rng = random.Random(1)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 11))) for _ in range(600)]
    total = lambda ids: sum(m.scores[i] for i in ids)
    for t in [*words, *(f"{a} {b}" for a, b in zip(words[:200], words[7:]))]:
        # the library's list of best paths is its exact search; paths of one score may stand in any order
        best = sp.nbest_encode_as_ids(t, 4)
        ids = array("i", m.encode(t)).tolist()
        assert total(ids) == total(best[0]) and ids in [b for b in best if total(b) == total(best[0])] or total(best[-1]) == total(ids), t


def test_whole_search_and_round_trip(m):
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choices("abcdeorst  \n.é日", k=rng.randint(0, 200)))
        ids = array("i", m.encode(t)).tolist()
        assert ids == whole(m, m.normal(t)) and m.decode(ids) == t
        assert V._ids(m, m.normal(t)) == array("i", ids).tobytes()  # the stream, without the words
    for t in TEXTS:
        if V.SPACE not in t:
            assert m.decode(array("i", m.encode(t))) == t


def test_portions_and_window(m):
    rng = random.Random(3)
    s = m.normal("".join(rng.choices("aeinorstlh", k=20_000)))
    want = whole(m, s)
    for size in (1, 7, 1000):
        st, got = V.Stream(m), []
        for at in range(0, len(s), size):
            st.feed(s[at : at + size])
            got += st.take()
        assert len(got) > 0.95 * len(want)  # committed before the end
        assert got + st.finish().tolist() == want
        assert st.widest <= 8 * m.longest and st.commits > 100


def test_documents_go_through_the_stream(m):
    """Whole documents in portions: windows commit as they go, stay short, and give what the words give."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if t]
    commits = chars = 0
    for t in texts:
        st, got = V.Stream(m), array("i")
        s = m.normal(t)
        for at in range(0, len(s), 500):
            st.feed(s[at : at + 500])
            got += st.take()
            assert len(st.text) <= st.widest + 2 * m.longest  # what is kept is the window and the text ahead
        got += st.finish()
        assert got.tobytes() == m.encode(t) and st.widest <= 4 * m.longest
        commits, chars = commits + st.commits, chars + len(s)
    assert commits > chars / 20


def test_every_new_word_goes_through_the_stream(m, monkeypatch):
    seen = []
    monkeypatch.setattr(m, "known", {})
    monkeypatch.setattr(m, "stream", V.Stream(m))
    feed = V.Stream.feed
    monkeypatch.setattr(V.Stream, "feed", lambda self, s: (seen.append(s), feed(self, s))[1])
    m.encode("one two one " + "x" * 40 + " " + "x" * 40)
    assert seen == ["▁one", "▁two", "▁" + "x" * 40, "▁" + "x" * 40]  # words over the longest piece are not remembered


def test_memory_of_words_is_bounded(m, monkeypatch):
    monkeypatch.setattr(m, "known", {})
    monkeypatch.setattr(V, "WORDS", 3)
    t = " ".join(f"word{i}" for i in range(50))
    assert array("i", m.encode(t)).tolist() == whole(m, m.normal(t)) and len(m.known) <= 3


def test_columns(spark, m):
    rows = [(1, "some text", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "long " * 40_000, "x"), (None, "日", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(str, V.decode(V.encode(df, PATH), PATH).collect()))
    assert got == sorted(str(r) for r in df.selectExpr("doc_id", "coalesce(text, '') text").collect())
    d = V.digests(df, PATH).collect()
    assert len(d) == 6 and all(r.round_trip for r in d) and {r.doc_id: r.n_ids for r in d}[2] == 0
    assert V.digests(df.limit(0), PATH).count() == 0
