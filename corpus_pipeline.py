"""A training corpus from raw documents: classify, deduplicate, redact, mix, pack.

Each stage reads what the one before it wrote. Its decisions take effect: the classifier's rejects go, one document of each
group of near duplicates stays, secrets are replaced, documents of small sources are repeated, and the last stage gives the
packed pieces. SQL can't express the classifier, so ORACLE_SQL is None; tests hold the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import ngram_join, quality_classifier, secret_scan, source_mixing, token_packing
from graphloom.llm.common import table, written
from graphloom.llm.queries import MAX_REPEATS, vocabulary

#: Near duplicates of the pipeline: word n-grams and the Jaccard percentage from which two documents link.
SHINGLE_WORDS = 5
SHINGLE_PERCENT = 80


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, n=SHINGLE_WORDS, percent=SHINGLE_PERCENT)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.mixed_documents(docs, MAX_REPEATS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("ngram_jaccard_join", deduplicate),
    ("secret_scan", redact),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
