"""A corpus pipeline of five stages: each takes the documents that its predecessor kept and writes what the next one reads.

Quality rules and near-duplicates remove documents, the secret scan replaces what it finds in their texts, mixing draws documents by
their rates, and the last stage returns the tokens. Mixing draws each document once at most and asks for all tokens of clean documents,
so their rates end at 1; toxic and low ones are drawn at the shares that FACTORS gives.

Defined results: a null or empty text is rejected by the quality rules. Of equal or near rows the one with the least id stays; rows
without an id stay and are never grouped. Repeated rows with an id stay together, if theirs is the least. Columns named like an
operator's outputs pass through all stages but the last, which replaces its own. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import byte_bpe, domain_mixing, minhash_join, quality_rules, secret_scan
from gridspark.llm.common import Scratch, table

#: Shares of the tokens that each domain has.
FACTORS = {"clean": 1.0, "toxic": 0.3, "low": 0.5}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_join.drop_near_duplicates(spark, docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(spark, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return domain_mixing.drawn(spark, docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), FACTORS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(spark, docs, keep=[c for c in docs.columns if c != "text"], with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("MinHash near-duplicates", near_duplicates),
    ("secret scan", secrets),
    ("mixing", mixing),
    ("byte-level BPE", tokens),
]

#: Expectation-maximisation, MinHash components, mixing and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
