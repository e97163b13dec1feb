"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

1. language ID: documents whose language can't be told (no text, no letter) go; the others keep all their columns.
2. near-duplicates: of each class the document with the least id stays; null ids come last.
3. secrets: every secret in a text is replaced; n_chars follows.
4. mixing: a document comes with the words that the mix takes of it, and again with those taken twice.
5. packing: the pieces of the sequences of at most 4096 tokens.

No SQL stands for the whole: the stages are tested against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import langid, mixing, neardup, packing, secrets
from quillon.llm.common import fold, materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` whose language is told; the model learns from the rows that the language query learns from."""
    model = langid.fit(docs.where(fold("doc_id", 3) != 1))
    return langid.known(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row: of the least doc_id (null ids last), and of rows that share it the least."""
    return neardup.kept(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
