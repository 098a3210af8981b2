"""A training-corpus pipeline in stages; each works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, jaccard, mixing, quality, secrets
from graphloom.llm.textbuf import documents, small_batches, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Null and empty texts are scored like others, repeated rows alike; rows without an id and all
    columns stay with their verdict. Without labels, or without documents, nothing is rejected.
    """
    small_batches(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the row of the least id, then of the least text hashes.

    Null, empty and wordless texts are near to nothing and stay, repeated rows count as copies, and
    rows without an id stay.
    """
    small_batches(spark)
    return jaccard.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets that patterns and Markov models find; every row and column stays.

    Null texts stay null; repeated rows are masked alike.
    """
    small_batches(spark)
    return secrets.redacted(docs, secrets.train(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents by rates that bring the domains to their target weights.

    A document's rate is rounded by hash of id and text, so repeated rows share one draw. Null and
    empty texts have no tokens and the rate of their posterior. Without labels every rate is 1.
    """
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and byte offsets of the tokens of every row; null and empty texts have none."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: The trees and the tokeniser's merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
