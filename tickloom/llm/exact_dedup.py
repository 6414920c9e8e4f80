"""Exact copies, found with two passes over a Bloom filter.

Pass one counts how many rows fall on each cell of the filter and keeps a bit for every cell that was
hit twice. Pass two tests every row against those bits: a row with a clear bit has no copy and passes
straight through; only the rest shuffle and are compared by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bitfilter import BITMAP_BITS, bitmaps, cell, with_test
from tickloom.llm.common import stored, whole_text

#: Cells of the filter for each of the two probes, which has at most FILTER_BITS / 8 bytes (8 MB) whatever the
#: input, and may be broadcast. Take about 8 cells a row; with fewer the result is the same and more rows shuffle.
FILTER_BITS = 1 << 26
PROBES = 2


def _cell(probe: int, bits: int) -> Column:
    return cell(F.xxhash64("__sha", F.lit(probe)), bits) + F.lit(probe * bits)


def repeated_cells(hashed: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Bitmaps of the cells that two or more rows hit: at most PROBES * bits / 32768 rows."""
    cells = hashed.select(F.explode(F.array(*[_cell(p, bits) for p in range(PROBES)])).alias("__cell"))
    twice = cells.groupBy("__cell").agg(F.count("*").alias("__n")).where("__n > 1")
    return bitmaps(twice, F.col("__cell"))


def maybe_repeated(hashed: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``hashed`` (any columns and __sha) with __maybe: false only for rows that have no copy."""
    cells = stored(repeated_cells(hashed, bits), "cells")
    out = hashed
    for p in range(PROBES):
        own = F.col("__bucket").between(p * bits // BITMAP_BITS, ((p + 1) * bits - 1) // BITMAP_BITS)
        out = with_test(out, cells.where(own), _cell(p, bits), f"__maybe{p}")
    return out.select(*hashed.columns, F.expr(" AND ".join(f"__maybe{p}" for p in range(PROBES))).alias("__maybe"))


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("__sha", F.unhex(F.sha2(whole_text(text), 256)))


def _groups(rows: DataFrame) -> DataFrame:
    """Per digest the largest id and the number of rows; both sums are combined before they shuffle."""
    return rows.groupBy("__sha").agg(F.max("doc_id").alias("__keep"), F.count("*").alias("__size"))


def mark_copies(docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and an empty text is a text like any other. Of equal texts the largest
    doc_id stays; a null doc_id loses to any other. A row that is there more than once counts each time
    and all of its repeats say kept (``drop_copies`` leaves one). An empty table gives no rows. Columns
    other than doc_id and text are not read.
    """
    rows = stored(maybe_repeated(stored(hashed(docs.select("doc_id", "text")).drop("text"), "sha"), bits), "maybe")
    alone, again = rows.where("not __maybe"), rows.where("__maybe")
    passed = alone.select("doc_id", F.col("doc_id").alias("__keep"), F.lit(1).cast("long").alias("__size"), "__sha")
    met = again.select("doc_id", "__sha").join(_groups(again), "__sha").select("doc_id", "__keep", "__size", "__sha")
    return passed.unionByName(met).select(
        "doc_id",
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; whole rows shuffle only if their cell was hit twice.

    Names that start with ``__`` are reserved.
    """
    flagged = maybe_repeated(hashed(docs), bits)
    again = flagged.where("__maybe").drop("__maybe")
    keepers = _groups(stored(maybe_repeated(hashed(docs.select("doc_id", "text")).drop("text"), bits), "maybe").where("__maybe"))
    left = again.join(keepers.drop("__size"), "__sha").where(F.col("doc_id").eqNullSafe(F.col("__keep")))
    left = left.dropDuplicates(["doc_id", "__sha"]).select(*docs.columns)
    return flagged.where("not __maybe").select(*docs.columns).unionByName(left)


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
