"""Index membership to categories, and symbol list arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.ranking import range_numbers

OTHERS = "OTHERS"


def assign_categories(
    symbols: DataFrame, members: DataFrame, exclusive: bool, priority: DataFrame | None = None
) -> DataFrame:
    """Categories per symbol from (index_name, list_pos, symbol).

    Not exclusive: every index that holds the symbol. Exclusive: the index with the
    fewest members, ties by list position, or the first under ``priority``
    (index_name, rank). Unmatched symbols go to OTHERS.
    """
    rows = members.dropDuplicates(["index_name", "symbol"])
    if exclusive:
        if priority is None:
            order = members.groupBy("index_name").agg(
                F.struct(F.count_distinct("symbol"), F.min("list_pos")).alias("rank")
            )
        else:
            order = priority.select("index_name", F.struct("rank").alias("rank"))
        # One winner per symbol by a plain aggregate: nothing is sorted per symbol.
        rows = (
            rows.join(order, "index_name")
            .groupBy("symbol")
            .agg(F.min(F.struct("rank", "index_name")).alias("best"))
            .select("symbol", "best.index_name")
        )
    return symbols.select("symbol").distinct().join(rows, "symbol", "left").select(
        "symbol", F.coalesce("index_name", F.lit(OTHERS)).alias("category")
    )


def with_all_constituents(symbols: DataFrame, members: DataFrame) -> DataFrame:
    """The input list and every constituent."""
    return symbols.select("symbol").union(members.select("symbol")).distinct()


def category_counts(assigned: DataFrame) -> DataFrame:
    """Symbols per category and a total row."""
    return (
        assigned.rollup("category")
        .agg(F.count("*").alias("n"), F.grouping("category").alias("g"))
        .select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("category")).alias("category"), "n")
    )


def category_matrix(assigned: DataFrame, categories: list[str]) -> DataFrame:
    """One column per category, symbols sorted downwards, padded with ''."""
    placed = range_numbers(assigned, "category", [F.col("symbol")], "row")
    wide = placed.groupBy("row").pivot("category", categories).agg(F.first("symbol"))
    return wide.na.fill("", categories)


def intersect_lists(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("symbol").intersect(b.select("symbol")).orderBy("symbol")


def union_lists(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("symbol").union(b.select("symbol")).distinct().orderBy("symbol")


def constituent_summary(members: DataFrame) -> DataFrame:
    """Rows per list and a grand total."""
    return (
        members.rollup("index_name")
        .agg(F.count("*").alias("n"), F.grouping("index_name").alias("g"))
        .select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("index_name")).alias("index_name"), "n")
    )


def tag_exchange(df: DataFrame, lists: DataFrame) -> DataFrame:
    """Exchange of the first list (by list_pos) that holds the symbol."""
    first = lists.groupBy("symbol").agg(F.min_by("exch", "list_pos").alias("exch"))
    return df.join(first, "symbol", "left")
