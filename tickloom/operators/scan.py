"""Surge scan, filters, ranking and watch-lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import constants as K
from tickloom.functions import scalar as X


def _final_average(c: str, kind: str, n: int) -> Column:
    """Value of a moving average on the last bar, as a plain sum over all bars.

    The average on the last bar weighs each bar by its age alone, so no ordered
    pass is needed: the sum combines map-side and no symbol is ever gathered.
    Only a simple average gathers bars, the last ``n`` of a symbol.
    """
    age = F.col("last_bar") - F.col("bar")
    if kind.lower() == "sma":
        # Added up bar by bar: in another order a flat series has averages that differ by a last bit.
        last = F.array_sort(F.collect_list(F.when(age < n, F.struct("bar", F.col(c).alias("x")))))
        total = F.aggregate(last, F.lit(0.0), lambda done, b: done + F.coalesce(b["x"], F.lit(0.0))) / n
        return F.when(F.max("last_bar") >= n, total).otherwise(0.0)
    alpha = 2.0 / (n + 1) if kind.lower() == "ema" else 1.0 / n
    weight = F.when(F.col("bar") == 1, 1.0).otherwise(alpha) * F.pow(F.lit(1.0 - alpha), age)
    return F.sum(F.col(c) * weight)


def surge_scan(
    bars: DataFrame,
    kind: str = "rma",
    fast: int = K.FAST_LEN,
    slow: int = K.SLOW_LEN,
    base: int = K.BASE_LEN,
    symbols: DataFrame | None = None,
) -> DataFrame:
    """Volume and price surge per symbol on the last bar of the grid.

    ``bars`` has symbol, bar, last_bar, price, volume on a dense grid.
    """
    if symbols is not None:
        bars = bars.join(symbols.select("symbol"), "symbol", "left_semi")
    last = bars.groupBy("symbol").agg(
        _final_average("volume", kind, fast).alias("vf"),
        _final_average("volume", kind, slow).alias("vs"),
        _final_average("volume", kind, base).alias("vb"),
        _final_average("price", kind, fast).alias("pf"),
        _final_average("price", kind, slow).alias("ps"),
        F.sum(F.when(F.col("bar") == F.col("last_bar"), F.col("price"))).alias("px"),
    )

    def nonzero(c: str) -> Column:
        return F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))

    def surge(f: str, s: str) -> Column:
        return F.bround(1000 * (F.col(f) - F.col(s)) / nonzero(s), 2)

    def action(f: str, s: str) -> Column:
        return F.when(F.col(f) > F.col(s), 1).when(F.col(f) < F.col(s), -1).otherwise(0)

    return last.select(
        "symbol",
        F.bround(F.col("vf") * 100 / nonzero("vb"), 2).alias("volume_fast"),
        F.bround(F.col("vs") * 100 / nonzero("vb"), 2).alias("volume_slow"),
        surge("vf", "vs").alias("vol_surge"),
        F.bround("px", 2).alias("ltp"),
        surge("pf", "ps").alias("price_surge"),
        action("pf", "ps").alias("price_ma_action"),
        action("vf", "vs").alias("vol_ma_action"),
    )


def filter_scan(
    scan: DataFrame, ltp: str | None = None, price: str = "na", volume: str = "na"
) -> tuple[DataFrame, DataFrame]:
    """Filtered rows and their positive/negative/neutral counts."""
    rows = X.ma_action_filter(X.ltp_filter(scan.filter("ltp IS NOT NULL"), ltp), price, volume)
    act = F.col("price_ma_action")
    counts = rows.agg(
        F.count_if(act == 1).alias("positive"),
        F.count_if(act == -1).alias("negative"),
        F.count_if((act != 1) & (act != -1)).alias("neutral"),
    )
    return rows, counts


def price_buckets(scan: DataFrame, width: int = 1000) -> DataFrame:
    """Watch-list by price bucket, highest bucket first, then by price."""
    upper = (F.floor(F.col("ltp") / width) + 1) * width
    return (
        scan.filter("ltp IS NOT NULL")
        .select(upper.cast("long").alias("below"), "symbol", "ltp")
        .orderBy(F.desc("below"), F.desc("ltp"), "symbol")
    )


def topk_union(scan: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows that are in the top ``k`` of any key. Each branch is a bounded top-k."""
    tops = [scan.orderBy(F.desc_nulls_last(key), "symbol").limit(k) for key in keys if key]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out.dropDuplicates(["symbol"])


def rank_sum(rows: DataFrame, key1: str, key2: str | None = None) -> DataFrame:
    """Order by the sum of the ranks under two keys. Takes an already limited list."""

    def rank(key: str) -> Column:
        return F.row_number().over(Window.orderBy(F.desc_nulls_last(key), "symbol"))

    total = rank(key1) + (rank(key2) if key2 else F.lit(0))
    scored = rows.withColumn("rank_sum", total)
    return scored.withColumn("pos", F.row_number().over(Window.orderBy("rank_sum", "symbol")))


def with_forced(ranked: DataFrame, forced: DataFrame) -> DataFrame:
    """Forced symbols (sorted) ahead of the ranked ones."""
    head = forced.select(F.lit(0).alias("part"), F.lit(0).alias("pos"), "symbol").distinct()
    tail = ranked.select(F.lit(1).alias("part"), "pos", "symbol")
    return head.unionByName(tail).orderBy("part", "pos", "symbol")


def sector_heat(
    scan: DataFrame, sectors: DataFrame, sort: str = "volume_fast", order: str = "desc"
) -> DataFrame:
    """Average volumes of each sector, ordered by ``sort``: volume_fast, volume_slow or name.

    Who is in a sector are rows of their own, see ``sector_members``.
    """
    rows = sectors.join(scan, "symbol")
    heat = rows.groupBy("sector").agg(
        F.avg("volume_fast").alias("avg_fast"),
        F.avg("volume_slow").alias("avg_slow"),
        F.count("symbol").alias("n_symbols"),
        F.max_by("symbol", F.struct("volume_fast", "symbol")).alias("top_symbol"),
    )
    heat = heat.withColumn("heat", F.least(F.col("avg_fast") / 200, F.lit(1.0)))
    key = F.col({"volume_fast": "avg_fast", "volume_slow": "avg_slow", "name": "sector"}[sort])
    return heat.orderBy(key.desc_nulls_last() if order == "desc" else key.asc_nulls_first(), "sector")


def sector_members(scan: DataFrame, sectors: DataFrame) -> DataFrame:
    """(sector, symbol, volume_fast, volume_slow): one row per member, however many a sector has."""
    return sectors.join(scan, "symbol").select("sector", "symbol", "volume_fast", "volume_slow")


def sector_detail(bars: DataFrame, sectors: DataFrame, name: str, **scan_args) -> DataFrame:
    """Scan of one sector's members. An unknown sector yields no rows; see sector_exists."""
    return surge_scan(bars, symbols=sectors.filter(F.col("sector") == name), **scan_args)


def require_sector(sectors: DataFrame, name: str) -> None:
    if sectors.filter(F.col("sector") == name).limit(1).isEmpty():
        raise ValueError(f"unknown sector: {name}")


def symbol_series(bars: DataFrame, symbol: str, tf_minutes: int = 3, open_min: int = K.SESSION_OPEN_MIN) -> DataFrame:
    """Labelled volume and price of one symbol, missing values as zero."""
    end = X.bar_end_ts(F.col("day"), F.col("slot"), tf_minutes, open_min)
    return bars.filter(F.col("symbol") == symbol).select(
        "bar",
        X.bar_label(F.col("bar"), end).alias("label"),
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
        F.coalesce("price", F.lit(0.0)).alias("price"),
    )


def signal_summary(alerts: DataFrame) -> DataFrame:
    """Alerts and distinct symbols per side; the list itself is the input."""
    return alerts.groupBy("signal").agg(
        F.count("*").alias("n"), F.count_distinct("symbol").alias("n_symbols")
    )
