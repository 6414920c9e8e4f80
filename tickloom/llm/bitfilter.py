"""Filters of fixed size that rows are tested against before they shuffle.

A filter is a small table of bitmaps, at most BITS / 8 bytes (8 MB) whatever the input, so it may be
broadcast. Rows with a clear bit are surely not in the set; the rest still need an exact test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap that ``bitmap_construct_agg`` builds.
BITMAP_BITS = 32768
#: Cells of a filter. About 8 a key let nearly all other rows pass by; with fewer, more rows get the exact test.
BITS = 1 << 26


def cell(of: Column, bits: int = BITS) -> Column:
    """The cell of a 64-bit number."""
    return F.pmod(of, F.lit(bits))


def bitmaps(cells: DataFrame, of: Column) -> DataFrame:
    """(__bucket, __bits) of the cells that ``of`` names; the bitmaps are built before they shuffle."""
    bucket = F.floor(of / BITMAP_BITS).alias("__bucket")
    return cells.groupBy(bucket).agg(F.bitmap_construct_agg(of % BITMAP_BITS).alias("__bits"))


def with_test(rows: DataFrame, filters: DataFrame, of: Column, name: str) -> DataFrame:
    """``rows`` with a boolean: is the bit of cell ``of`` set?"""
    place = (of % BITMAP_BITS).cast("int")
    side = F.broadcast(filters.select(F.col("__bucket").alias("__b"), F.col("__bits").alias("__m")))
    byte = F.col("__m").substr(F.floor(place / 8).cast("int") + 1, F.lit(1))
    test = F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), place % 8) == 1, F.lit(False))
    out = rows.join(side, F.floor(of / BITMAP_BITS) == F.col("__b"), "left")
    return out.select(*rows.columns, test.alias(name))


def _split(docs: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose columns ``on`` are surely not among ``keys``, and the others."""
    hashed = cell(F.xxhash64(*on))
    tested = with_test(docs, bitmaps(keys, hashed), hashed, "__maybe")
    return tested.where("not __maybe").drop("__maybe"), tested.where("__maybe").drop("__maybe")


def _same(keys: DataFrame, on: list[str]) -> tuple[DataFrame, list[Column], list[str]]:
    names = [f"__on{i}" for i in range(len(on))]
    renamed = keys.withColumnsRenamed(dict(zip(on, names, strict=True)))
    return renamed, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(on, names, strict=True)], names


def drop_rows(docs: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """``docs`` without the rows whose columns ``on`` are in ``gone`` (null equals null): only rows that may be there shuffle."""
    alone, maybe = _split(docs, gone, on)
    keys, same, _ = _same(gone.select(*on).distinct(), on)
    return alone.unionByName(maybe.join(keys, same, "left_anti"))


def only_rows(docs: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``docs`` that join ``keys``, with its other columns."""
    renamed, same, names = _same(keys, on)
    return _split(docs, keys, on)[1].join(renamed, same).drop(*names)


def with_rows(docs: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that surely join nothing; and the others, left joined with ``keys``."""
    renamed, same, names = _same(keys, on)
    alone, maybe = _split(docs, keys, on)
    return alone, maybe.join(renamed, same, "left").drop(*names)
