import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cubeline.llm import token_counts as T

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_every_plain_character_as_the_library(library):
    count = T.counter(PATH)
    chars = [chr(c) for c in range(0x2100) if T._PLAIN.fullmatch(chr(c))]
    texts = [f"a{c}b {c}{c} 1{c}2\n{c} '{c}s {c}'ll" for c in chars]
    assert count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_odd_texts_as_the_library(library):
    texts = ["", " ", "a  b\n\n c", "<|endoftext|>x<|endoftext|>", "日本語　テキスト", "\x1c\x85\xa0 a", "é‍👩‍👩‍👧", "x" * 5000, "ab" * 3000 + " " * 400, "don't WE'LL 123abc"]
    assert T.counter(PATH)(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_other_files():
    assert T.counter(P.path("piece_bpe_32k.model"))(["", "a b"])[0] == 0
    assert T.counter(P.path("word_bpe_49k.json"))(["Hello world"]) == [2]


def test_cache(spark, tmp_path, library, monkeypatch):
    rows = [(1, "one two", "x"), (2, None, "x"), (3, "", "y"), (4, "one two", "y"), (4, "one two", "z"), (4, "other", "z"), (None, "no id", "z"), (None, "one two", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    cache = f"file://{tmp_path}/cache"
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    first = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in T.token_counts(df, PATH, cache).collect())
    assert first == want
    version = T.tokenizer_digest(PATH)
    assert T.stored(spark, cache, version).count() == 4 == spark.read.parquet(cache).count()
    # counts are taken from the cache: what it holds decides, and only new texts are encoded
    more = df.unionByName(spark.createDataFrame([(9, "brand new text", "q")], df.schema))
    T.token_counts(more, PATH, cache).collect()
    assert spark.read.parquet(cache).count() == 5
    assert T.token_counts(df.limit(0), PATH, cache).count() == 0
    # warm: nothing is encoded, and no text is shuffled, whatever the size
    with monkeypatch.context() as m:
        m.setattr(T, "_encoder", lambda p: (_ for _ in ()).throw(AssertionError("encoded")))
        warm = T.token_counts(more, PATH, cache)
        assert warm.count() == 9 and "text" not in warm._jdf.queryExecution().executedPlan().toString()
    # many missing digests are joined by a shuffle
    with monkeypatch.context() as m:
        m.setattr(T, "FEW", 0)
        again = T.token_counts(df, PATH, f"file://{tmp_path}/second")
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in again.collect()) == want
    # another version has its own entries
    monkeypatch.setattr(T, "tokenizer_digest", lambda p: "other")
    assert T.token_counts(df, PATH, cache, over=0).where("over_limit").count() == 6
    assert spark.read.parquet(cache).count() == 9


def test_empty_cache_and_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_counts(df, PATH).count() == 0
