"""The opN_ queries on whole tables, each against a plain version of what it promises."""

import hashlib
import re
import zlib

import pytest
import xxhash
from public_tokenizers import path
from tokenizers import Tokenizer

from cubeline.llm import feature_digest, mpeg_audio, sp_viterbi
from cubeline.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def rows(spark, name):
    return {r[0]: r for r in QUERIES[name](spark, DIR).collect()}


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


def test_op1(spark, docs):
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = rows(spark, "op1_token_counts")
    n = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in got.items()} == {i: (len(t.encode()), n[i], n[i] > 1024) for i, t in docs.items()}


def test_op2(spark, docs):
    got = rows(spark, "op2_mpeg_audio")
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        raw, r = t.encode(), got[i]
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        m = mpeg_audio.build(p)
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest()) and r.feature


def test_op5(spark, docs):
    got = rows(spark, "op5_feature_digest")
    ids = sorted(docs)
    rank = feature_digest.table(feature_digest.counts([docs[i].encode() for i in ids]))
    for i, j in zip(ids, ids[1:] + ids[:1]):
        t, k = docs[i], len(docs[i]) // 4
        e = t[: len(t) - k] + docs[j][:k]
        a, b, c = feature_digest.filters([t.encode(), e.encode(), docs[j].encode()], rank)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (feature_digest.to_string(a), feature_digest.to_string(b))
        assert (r.near_edited, r.near_next) == (feature_digest.likeness(a, b), feature_digest.likeness(a, c))
    assert len(got) == len(docs) and sum(r.near_edited > 0.5 for r in got.values()) > 0.9 * len(docs)


def test_op6(spark, docs):
    m = sp_viterbi.Model(path("piece_bpe_32k.model"))
    got = rows(spark, "op6_sentencepiece_viterbi")
    for i, t in docs.items():
        st = sp_viterbi.Stream(m)
        st.feed(m.normal(t))
        ids = st.finish()
        assert (got[i].n_ids, got[i].ids_sha256, got[i].round_trip) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), True)


def test_op8(spark, docs):
    got = rows(spark, "op8_simhash_components")
    fps = {}
    for i, t in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[i] = sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", find(i)) for i in docs}


def test_op9(spark):
    d = "/root/testdata/sf0.01"  # the smallest tables hold no secrets
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op9_secret_scan"](spark, d).collect()}
    patterns = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12), ("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16))
    some = 0
    for i, t in docs.items():
        found = []
        for k, (kind, p, least) in enumerate(patterns):
            for m in re.finditer(p, t, re.I | re.A if k == 0 else 0):
                if len(m[2 if k == 0 else 0]) >= least:
                    found.append((m.start(), k, m.end(), kind))
        found.sort()
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[1] == k for f in found) for k in range(3))
        joined = [f"{kind}:{a}:{b}" for a, _, b, kind in found]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("markov")] == joined and len(every) == len(joined) + r.n_markov
        some += r.n_markov
    assert len(got) == len(docs) and some > 0


def test_op10(spark):
    """The text is the article's: here every page has one, and names all else that it carries."""
    got = rows(spark, "op10_page_differencing")
    pages = {r.page_id: r for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    assert got.keys() == pages.keys()
    for i, p in pages.items():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1|ul|li|article|div)[^>]*>", re.sub(r"<!--.*?-->", "", article, flags=re.S))
        import html

        text = "\n".join(filter(None, (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts)))
        assert (got[i].url, got[i].text, got[i].n_chars) == (p.url, text, len(text))
