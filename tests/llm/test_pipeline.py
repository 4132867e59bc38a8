import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from cubeline.llm import packing, secrets, simhash, toxicity

DIR = "/root/testdata/sf0.001"


def by_hand(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars").collect()]
    text = {i: t for i, t, _ in docs}
    labels = {}
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
        labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.toxic)
    ids = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 5 and i in text)
    score = toxicity.scorer(toxicity.fit([text[i] for i in ids], np.array([labels[i] for i in ids])))
    docs = [d for d in docs if score(d[1]) < 0.5]
    fp = [simhash.fingerprint(t) for _, t, _ in docs]
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = simhash._root(root, a), simhash._root(root, b)
                root[max(x, y)] = min(x, y)
    first = {}
    for k, d in enumerate(docs):
        r = simhash._root(root, k)
        first[r] = min(first.get(r, d), d)
    docs = sorted(first.values())
    model = secrets.train_from(spark.createDataFrame([(d[1],) for d in docs], "text string"))
    docs = [(i, secrets.hide(t, secrets.spans(t, secrets.scorer(model))[1])) for i, t, _ in docs]
    return docs


def test_against_brute_force(spark):
    rows = corpus_pipeline.run(spark, DIR).collect()
    docs = by_hand(spark, DIR)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 50_256] for i, t in docs}
    have = {}
    for r in rows:
        assert r.n_tokens == len(r.ids) <= r.bin_length
        for i, at, a, b in zip(r.doc_ids, r.starts, r.offsets, [*r.offsets[1:], r.n_tokens]):
            have.setdefault(i, {})[at] = r.ids[a:b]
    assert {i: sum((p[at] for at in sorted(p)), []) for i, p in have.items()} == want
    assert len({r.shard for r in rows}) == 1  # so few texts are one shard
    sizes = sorted((len(x) for p in have.values() for x in p.values()), reverse=True)
    _, bins, _ = packing.solve(sizes, packing.costs_of(packing.LENGTHS))
    assert sorted(bins) == sorted(r.bin_length for r in rows)


def test_stages_keep_columns_and_edge_cases(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "a b c d token=0123456789abcdef", None, "s", 31), (3, "a b c d token=0123456789abcdef", None, "s", 31), (None, "x y z", "en", None, 5), (7, "same words here now", "en", "s", 19), (8, "same words here now", "en", "s", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    got = sorted(map(str, docs.collect()))
    assert len(got) == 4 and any("token=[SECRET]" in g for g in got) and not any("doc_id=8" in g for g in got)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert sorted(str(i) for r in packed.collect() for i in r.doc_ids) == sorted(str(r.doc_id) for r in docs.collect())
    empty = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        empty = f(spark, empty, str(tmp_path))
    assert empty.count() == 0
