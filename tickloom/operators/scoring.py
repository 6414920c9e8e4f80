"""Multi-day activity scores on a daily panel (symbol, day, day_idx, value, ltp).

The panel has one row per symbol and day. Windows by day hold one row per symbol,
windows by symbol one row per trading day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.ranking import range_numbers


def read_daily_panel(df: DataFrame, value_col: str, ltp_col: str = "ltp") -> DataFrame:
    """Daily files (symbol, day, ...) to the panel; the latest price of a symbol is kept too."""
    from tickloom.operators.bars import day_numbers

    rows = df.select("symbol", "day", F.col(value_col).alias("value"), F.col(ltp_col).alias("ltp"))
    return rows.join(day_numbers(df), "day")


def last_ltp(panel: DataFrame) -> DataFrame:
    return panel.groupBy("symbol").agg(F.max_by("ltp", "day_idx").alias("last_ltp"))


def ltp_latest_filter(panel: DataFrame, lo: float, hi: float) -> DataFrame:
    """All rows of the symbols whose latest price is in range."""
    wanted = last_ltp(panel).filter(F.col("last_ltp").between(lo, hi)).select("symbol")
    return panel.join(wanted, "symbol", "left_semi")


def daily_percentile(panel: DataFrame) -> DataFrame:
    """100 for the highest value of a day, falling by equal steps; ties by symbol."""
    ranked = range_numbers(panel, "day_idx", [F.desc("value"), F.col("symbol")], "_place", "_of")
    share = (F.col("_place") - 1) / F.col("_of")
    return ranked.withColumn("percentile", 100.0 * (1.0 - share)).drop("_place", "_of")


def percentile_ewma(
    panel: DataFrame, span: int | Column, lo: int | Column = 1, hi: int | Column | None = None
) -> DataFrame:
    """Final exponentially weighted percentile per symbol over days lo..hi.

    Days a symbol is missing are skipped: ages count its own days. Only the final
    value is wanted, so it is a weighted sum rather than an ordered fold.
    """
    days = panel.filter(F.col("day_idx") >= lo)
    if hi is not None:
        days = days.filter(F.col("day_idx") <= hi)
    ranked = daily_percentile(days)
    own = Window.partitionBy("symbol")
    nth = F.row_number().over(own.orderBy("day_idx"))
    aged = ranked.select(
        "symbol", "percentile", nth.alias("nth"), (F.count("*").over(own) - nth).alias("age")
    )
    alpha = F.lit(2.0) / (F.lit(span) + 1.0)
    weight = F.when(F.col("nth") == 1, 1.0).otherwise(alpha) * F.pow(1.0 - alpha, F.col("age"))
    return aged.groupBy("symbol").agg(F.sum(F.col("percentile") * weight).alias("score"))


def combined_score(
    panel: DataFrame, w_max: float, w_avg: float, n_days: int | Column
) -> DataFrame:
    """``w_max*max + w_avg*total/n_days``; absent days count in the divisor."""
    score = w_max * F.max("value") + w_avg * (F.sum("value") / n_days)
    return panel.groupBy("symbol").agg(score.alias("score"))


def top_candidates(scores: DataFrame, n: int, allow: DataFrame | None = None) -> DataFrame:
    """The best ``n`` symbols, optionally only listed ones, with truncated scores."""
    if allow is not None:
        scores = scores.join(allow.select("symbol"), "symbol", "left_semi")
    return (
        scores.orderBy(F.desc("score"), "symbol")
        .limit(n)
        .select("symbol", F.col("score").cast("long").alias("score"))
    )


def recent_overlay(
    panel: DataFrame, n_days: int | Column, last_n: int, k: int
) -> DataFrame:
    """Percentile score over all days; the ``k`` strongest of late score 100 + theirs."""
    full = percentile_ewma(panel, n_days)
    late = percentile_ewma(panel, last_n, F.lit(n_days) - last_n + 1, n_days)
    best = late.orderBy(F.desc("score"), "symbol").limit(k)
    boosted = best.select("symbol", (F.col("score") + 100.0).alias("boosted"))
    return full.join(boosted, "symbol", "full_outer").select(
        "symbol", F.coalesce("boosted", "score").alias("score")
    )


def topk_frequency(panel: DataFrame, k: int) -> DataFrame:
    """On how many days a symbol was among the ``k`` highest."""
    day = Window.partitionBy("day_idx").orderBy(F.desc("value"), "symbol")
    top = panel.withColumn("rn", F.row_number().over(day)).filter(F.col("rn") <= k)
    return top.groupBy("symbol").agg(F.count("*").alias("days_in_top"))


def volume_consistency(
    panel: DataFrame, level: float = 0.7, band: float = 0.3, min_days: int = 5
) -> DataFrame:
    """Spread measures of the daily value around each symbol's mean."""
    mean = panel.groupBy("symbol").agg(F.avg("value").alias("mean"))
    v, m = F.col("value"), F.col("mean")
    near = (v >= m * (1 - band)) & (v <= m * (1 + band))
    out = (
        panel.join(mean, "symbol")
        .groupBy("symbol", "mean")
        .agg(
            F.stddev_samp("value").alias("std"),
            F.count_if(v >= level * m).alias("n_above"),
            F.count_if(near).alias("n_near"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.median("value").alias("median_value"),
            F.count("*").alias("days"),
        )
        .filter(F.col("days") >= min_days)
    )
    return out.select(
        "symbol",
        F.col("mean").alias("avg_value"),
        F.col("std").alias("std_value"),
        F.when(m > 0, F.col("std") / m * 100).alias("cv"),
        (F.col("n_above") / F.col("days") * 100).alias("consistency"),
        (F.col("n_near") / F.col("days") * 100).alias("stability"),
        "min_value",
        "max_value",
        "median_value",
        "days",
    )


def consistent_symbols(
    stats: DataFrame, cv: float = 50, consistency: float = 70, stability: float = 60
) -> DataFrame:
    return stats.filter(
        (F.col("cv") < cv) & (F.col("consistency") > consistency) & (F.col("stability") > stability)
    )


def consistency_averages(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.avg("cv").alias("cv"),
        F.avg("consistency").alias("consistency"),
        F.avg("stability").alias("stability"),
    )


def most_consistent(stats: DataFrame, n: int) -> DataFrame:
    return stats.orderBy(F.asc_nulls_last("cv"), "symbol").limit(n)


def percentile_report(panel: DataFrame, span: int = 10) -> DataFrame:
    avg = panel.groupBy("symbol").agg(F.avg("value").alias("avg_value"))
    return percentile_ewma(panel, span).join(avg, "symbol")


def threshold_list(panel: DataFrame, min_ltp: float, min_value: float) -> DataFrame:
    keep = (F.col("ltp") >= min_ltp) & (F.col("value") >= min_value)
    return panel.filter(keep).orderBy(F.desc("value"), "symbol", "day_idx")


def dedup_max(rows: DataFrame, n: int) -> DataFrame:
    """Highest score per symbol, best ``n``."""
    best = rows.groupBy("symbol").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "symbol").limit(n)
