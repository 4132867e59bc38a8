"""Token counts through a digest cache.

A text's count depends on its normalised content and on the tokenizer's version alone, so
counts are kept under two digests: SHA-256 of the content, and SHA-256 of the tokenizer's
file, library and settings.  Documents are joined to the stored counts by both; what is
missing is reduced to one document a digest, encoded, and appended to the cache; then all
documents are joined to the cache.  Normalising is the tokenizer's own matter: byte-level
BPE keeps every byte, so its content is the UTF-8 text as it stands; `normalise` takes
another rule for tokenizers that fold texts together (it must not change a count).

How many digests are missing decides how their texts are found.  If none is, no text is read
again; if a few are (`FEW`), their digests go to every task of a second scan; if many are, texts
cross the network once, dealt by document, so a digest that a third of the documents share
costs no task more than others.  The last join moves digests and numbers only and is one that
adaptive execution splits.

The cache is a folder of Parquet files.  Appending is safe to repeat: if two writers add
one digest, both hold the same count and one is read.

Null text is empty (0 tokens).  Repeated rows come out as often as they went in.  A null
doc_id is kept.  Texts of any length are encoded whole.  An empty table gives no rows.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeline.llm.common import few_files, fresh_path, path_exists, stage, whole_text

OVER = 1024
#: Missing digests (of 40 bytes, with a doc_id) up to which they are broadcast.
FEW = 10_000
_LOADED: dict[str, Callable[[str], Sequence[int]]] = {}

#: Texts made of these alone are cut into words alike by both libraries (tests compare them on
#: every one); others, whose classes may differ between Unicode versions, go to the file's own library.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ‐-‧‰-⁞₠-₿]*")


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _byte_level(path: str) -> Callable[[str], Sequence[int]] | None:
    """An encoder for a byte-level BPE file by ranks, or None if the file asks for more than that."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.load(open(path, encoding="utf-8"))
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    fits = model["type"] == "BPE" and not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    if not fits or model.get("dropout") or model.get("ignore_merges"):
        return None
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    base = 256
    if any(model["vocab"].get(a + b) != base + k for k, (a, b) in enumerate(merges)):
        return None  # ranks would not follow the merges
    special = [t["content"] for t in spec["added_tokens"]]
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        return None
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    odd = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def encode(t: str) -> Sequence[int]:
        return fast.encode_ordinary(t) if _PLAIN.fullmatch(t) and not odd.search(t) else whole.encode(t, add_special_tokens=False).ids

    return encode


def encoder(path: str) -> Callable[[str], Sequence[int]]:
    """text -> token ids, without begin, end or added special tokens; one for each process."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda t: sp.encode(t)
        elif path.endswith(".json"):
            if (fast := _byte_level(path)) is None:
                from tokenizers import Tokenizer

                whole = Tokenizer.from_file(path)
                whole.no_truncation()
                whole.no_padding()
                fast = lambda t: whole.encode(t, add_special_tokens=False).ids
            _LOADED[path] = fast
        else:
            import public_tokenizers
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            _LOADED[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _LOADED[path]


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """texts -> numbers of tokens."""
    encode = encoder(path)
    return lambda texts: [len(encode(t)) for t in texts]


def tokenizer_digest(path: str) -> str:
    """Of the file, the library's version and the settings counts depend on."""
    from importlib.metadata import version

    library = "sentencepiece" if path.endswith(".model") else "tokenizers" if path.endswith(".json") else "tiktoken"
    h = hashlib.sha256(open(path, "rb").read())
    h.update(f"|{library} {version(library)}|no specials, no truncation, no padding".encode())
    return h.hexdigest()


def _encoder(path: str):
    def run(batches):
        count = counter(path)
        for b in batches:
            n = count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["content_digest", "n_tokens"])

    return run


_CACHE = "content_digest binary, n_tokens long, tokenizer_digest string"


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """What the cache holds for one tokenizer: content_digest, n_tokens."""
    df = spark.read.schema(_CACHE).parquet(cache) if path_exists(spark, cache) else spark.createDataFrame([], _CACHE)
    return df.where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame, tokenizer: str, cache: str | None = None, *, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = lambda c: c, over: int = OVER
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document; `cache` grows by what it lacked."""
    spark = docs.sparkSession
    cache = cache or fresh_path(spark, "token_cache")
    version = tokenizer_digest(tokenizer)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    base = base.withColumn("digest", F.unhex(F.sha2(normalise(F.col("text")).cast("binary"), 256)))
    keys = stage(base.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests", narrow=True)

    known = stored(spark, cache, version)
    missing = keys.groupBy("digest").agg(F.min("doc_id").alias("rep")).join(known, F.col("digest") == known.content_digest, "left_anti")
    missing = missing.select(F.col("digest").alias("d"), "rep")
    n = missing.count()
    if n:
        one = F.broadcast(missing) if n <= FEW else missing.hint("shuffle_hash")
        texts = base.join(one, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("digest") == F.col("d"))).select("digest", normalise(F.col("text")).alias("text"))
        made = texts.mapInArrow(_encoder(tokenizer), "content_digest binary, n_tokens long").dropDuplicates(["content_digest"])  # a repeated row may have been encoded twice
        few_files(made).withColumn("tokenizer_digest", F.lit(version)).write.mode("append").partitionBy("tokenizer_digest").parquet(cache)
    now = stored(spark, cache, version)
    counted = keys.join(now, keys.digest == now.content_digest).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
    return few_files(counted)
