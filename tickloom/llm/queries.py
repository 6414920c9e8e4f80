"""The registered queries of the package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import byte_bpe, exact_dedup, language_id, license_scan, media, merkle, mixture, near_dedup, pii, prefix_trie, suffix_dedup, toxicity, url_filters
from tickloom.llm.common import read


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_report(read(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = byte_bpe.Bpe(spark)
    return byte_bpe.digests(byte_bpe.encode(read(spark, sf_dir, "documents"), bpe), bpe)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = suffix_dedup.drop_repeats(read(spark, sf_dir, "documents"))
    return suffix_dedup.digests(dropped, suffix_dedup.shared_words())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(read(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_copies(read(spark, sf_dir, "documents")).drop("th")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_report(read(spark, sf_dir, "conversations"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_mix_sources,
        op3_byte_bpe,
        op4_suffix_dedup,
        op5_exact_dedup,
        op6_language_id,
        op7_media_columns,
        op8_license_scan,
        op9_toxicity,
        op10_minhash,
        op11_prefix_trie,
        op12_pii,
        op13_merkle_manifest,
    )
}

SQL: dict[str, str] = {
    "op1_url_filters": url_filters.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
