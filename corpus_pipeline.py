"""From documents to packed training sequences, in stages that are each written and reread.

1. toxicity: documents that the classifier rejects go.
2. near_duplicates: of each SimHash component, the document of the least doc_id stays.
3. secrets: secret spans are replaced by a mark; every document stays.
4. packing: the documents are encoded and packed; one row for each sequence, with its token ids and
   the documents and places its parts are from.

The first three return the columns they got.  Null texts count as empty; tables without rows
run through.  SQL can't express the stages, so ORACLE_SQL is None and tests hold run() against
a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cubeline.llm import packing, secrets, simhash, toxicity
from cubeline.llm.common import importable, stage
from cubeline.llm.queries import BYTE_BPE, END, tokenizer


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return simhash.one_of_each(docs)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return secrets.redacted(docs, secrets.train_from(docs))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return packing.pack_texts(docs, tokenizer(BYTE_BPE), END)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("secrets", _secrets),
    ("packing", _packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name)
    return docs
