"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

Rows go where a stage rejects them (quality, near copies, benchmark leaks); the
secret scan replaces secrets in the texts and keeps every row; the last stage
gives each document's ids, and what they decode to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import bpe, common, decontaminate, neardup, quality, queries, secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from at most 20,000 labelled ones."""
    return quality.accepted(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return neardup.deduplicated(docs, k=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind in brackets."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, their number and digest, and the digest of the decoded bytes."""
    path, pattern = queries.vocabulary("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.encode(docs, path, pattern), path, pattern, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", accept),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("secret scans", redact),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL cannot express the stages; tests/llm holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in order."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
