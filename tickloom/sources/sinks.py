"""Writers: watch-lists and the bar table that doubles as the saved state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_watchlist(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "csv") -> None:
    """One ordered file. For reports whose length is a parameter (top-k lists)."""
    out = df.coalesce(1).write.mode(mode)
    if fmt == "text":
        out.text(path)
    else:
        out.option("header", True).csv(path)


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Ordered lines of any number, as text: a file per range of the order, numbered in that order."""
    lines.write.mode(mode).text(path)


def bucketed_lines(buckets: DataFrame, footer: str) -> DataFrame:
    """Text of a price-bucket watch-list: a heading per bucket, its symbols, a footer."""
    rows = buckets.select("below", F.lit(1).alias("part"), F.col("ltp").alias("by"), F.col("symbol").alias("line"))
    heads = buckets.select("below").distinct().select(
        "below", F.lit(0).alias("part"), F.lit(0.0).alias("by"), F.concat(F.lit("# Less than "), F.col("below").cast("string")).alias("line")
    )
    foot = buckets.limit(1).select(
        F.lit(-1).cast("long").alias("below"), F.lit(2).alias("part"), F.lit(0.0).alias("by"), F.lit(f"# {footer}").alias("line")
    )
    every = rows.unionByName(heads).unionByName(foot)
    return every.orderBy(F.desc("below"), "part", F.desc("by"), "line").select("line")


#: Symbols whose bars of a day go to one file.
SYMBOLS_A_FILE = 2000


def parts_of(symbols: int) -> int:
    return max(1, -(-symbols // SYMBOLS_A_FILE))


def spread(day: str, parts: int) -> list[Column | str]:
    """What to repartition by so that a day goes to ``parts`` tasks at most."""
    return [day, F.pmod(F.xxhash64("symbol"), F.lit(parts))] if parts > 1 else [day]


def write_bars(bars: DataFrame, path: str, tf: str, symbols: int | None = None) -> None:
    """Store bars by timeframe and day; only the days present are replaced.

    A day's symbols are dealt to as many tasks and files as they need: there are few days, but any number of symbols.
    ``symbols`` is their number, where it is known.
    """
    parts = parts_of(bars.select("symbol").distinct().count() if symbols is None else symbols)
    (
        bars.withColumn("tf", F.lit(tf))
        .repartition(*spread("day", parts))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("tf", "day")
        .parquet(path)
    )


def read_bars(spark: SparkSession, path: str, tf: str) -> DataFrame:
    """Stored bars of one timeframe; ``last_bar`` comes from the newest partition's rows."""
    bars = spark.read.parquet(path).filter(F.col("tf") == tf).drop("tf", "last_bar")
    newest = bars.agg(F.max("day")).scalar()  # of partition values alone
    return bars.withColumn("last_bar", bars.filter(F.col("day") == newest).agg(F.max("bar")).scalar())
