"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import scratch_path


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's own folder in the one that all executors share (``session.drop_scratch`` removes it)."""
    return scratch_path(spark, name)


def stored(df: DataFrame, name: str, below: str | None = None) -> DataFrame:
    """Cut lineage: write to the shared folder, or to one ``below`` a path of it, and go on from the files."""
    path = f"{below}/{name}" if below else shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def id_fold(folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds (a null id counts as empty text)."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc32_sql(text: str) -> str:
    """DuckDB's words for the unsigned CRC-32 of a text of ASCII digits and signs."""
    bit = "xor(y >> 1, (y & 1) * 3988292384)"
    byte = f"list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295) END"
