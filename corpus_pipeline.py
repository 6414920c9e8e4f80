"""From raw documents to tokens: toxic texts and copies go, sources are mixed to their targets, texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import byte_bpe, exact_dedup, mixture, near_dedup, toxicity
from tickloom.llm.common import read, stored


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the smallest doc_id stays."""
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each document and time around."""
    return mixture.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and the digests of ids and of the bytes that they decode to."""
    bpe = byte_bpe.Bpe(spark)
    encoded = byte_bpe.encode(docs, bpe)
    return byte_bpe.digests(encoded, bpe, keep_ids=True)


STAGES = [
    ("toxicity", toxic),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixture", mix),
    ("byte_bpe", encode),
]

# Trees, permutations and BPE are not SQL; tests/llm checks each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
