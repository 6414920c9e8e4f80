"""Snapshots and ticks to session bars: slotting, gap filling, deltas, rollups.

Every window here is keyed by (symbol, day) and so never sees more rows than a
session has slots; heavy symbols are folded to one row per slot by partial
aggregation before any of them runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import constants as K
from tickloom.functions import scalar as X
from tickloom.session import materialise



def _day():
    return Window.partitionBy("symbol", "day_idx").orderBy("slot")


def day_numbers(days: DataFrame) -> DataFrame:
    """Number the distinct days 1..n. One row per calendar day, so one task suffices."""
    return days.select("day").distinct().withColumn(
        "day_idx", F.row_number().over(Window.orderBy("day"))
    )


def slot_snapshots(
    snaps: DataFrame,
    tf_minutes: int = 3,
    open_min: int = K.SESSION_OPEN_MIN,
    length: int = K.SESSION_MINUTES,
) -> DataFrame:
    """Put snapshots (symbol, snap_ts, vol_cum, price) into slots; the latest one wins.

    A value that did not parse leaves the earlier value of the slot in place.
    """
    slotted = snaps.withColumn("day", F.to_date("snap_ts")).withColumn(
        "slot", X.slot_of(F.col("snap_ts"), tf_minutes, open_min, length)
    )

    def latest(col: str) -> Column:
        known = F.when(F.col(col).isNotNull(), F.col("snap_ts"))
        return F.max_by(col, known).alias(col)

    return (
        slotted.filter("slot IS NOT NULL")
        .groupBy("symbol", "day", "slot")
        .agg(latest("vol_cum"), latest("price"), F.max("snap_ts").alias("snap_ts"))
    )


def snapshot_calendar(
    manifest: DataFrame,
    tf_minutes: int = 3,
    open_min: int = K.SESSION_OPEN_MIN,
    length: int = K.SESSION_MINUTES,
) -> DataFrame:
    """Per day: number, last snapshot time and last slot, from the snapshot times alone."""
    return (
        manifest.filter(X.in_session(F.col("snap_ts"), open_min, length))
        .groupBy(F.to_date("snap_ts").alias("day"))
        .agg(F.max("snap_ts").alias("last_ts"))
        .withColumn("day_idx", F.row_number().over(Window.orderBy("day")))
        .withColumn("last_slot", X.slot_of(F.col("last_ts"), tf_minutes, open_min, length))
    )


def symbol_universe(snaps: DataFrame, calendar: DataFrame) -> DataFrame:
    """Symbols of the last snapshot of each day."""
    last = calendar.select(F.col("last_ts").alias("snap_ts"))
    return snaps.join(last, "snap_ts", "left_semi").select("symbol").distinct()


def dense_grid(universe: DataFrame, calendar: DataFrame, per_day: int) -> DataFrame:
    """One row per symbol and bar, up to the bar of the last snapshot.

    The calendar enters as one array value (an entry per day), so the grid is an
    explode inside each symbol's row: no join and no shuffle.
    """
    newest = F.max("day_idx").over(Window.partitionBy())
    used = F.when(F.col("day_idx") == newest, F.col("last_slot")).otherwise(per_day)
    days = (
        calendar.select("day", "day_idx", used.alias("n"))
        .groupBy()
        .agg(
            F.array_sort(F.collect_list(F.struct("day_idx", "day", "n"))).alias("days"),
            F.max((F.col("day_idx") - 1) * per_day + F.col("n")).cast("int").alias("last_bar"),
        )
        .select(F.struct("days", "last_bar").alias("cal"))
    )
    return (
        universe.withColumn("cal", days.scalar())
        .select("symbol", F.col("cal.last_bar").alias("last_bar"), F.explode("cal.days").alias("d"))
        .select("symbol", "last_bar", "d.day_idx", "d.day", F.explode(F.sequence(F.lit(1), F.col("d.n"))).alias("slot"))
        .withColumn("bar", X.bar_index(F.col("day_idx"), F.col("slot"), per_day))
    )


def _filled(col: str) -> Column:
    """Linear inside a day, flat at its ends, zero when the day has no value.

    The next known value is the last one seen in reverse order: a frame that grows
    backwards costs one step per row, one that looks ahead rescans the rest of the day.
    """
    point = F.when(F.col(col).isNotNull(), F.struct(F.col("slot").alias("s"), F.col(col).alias("v")))
    reverse = Window.partitionBy("symbol", "day_idx").orderBy(F.desc("slot"))
    prev = F.last(point, ignorenulls=True).over(_day().rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.last(point, ignorenulls=True).over(reverse.rowsBetween(Window.unboundedPreceding, 0))
    slope = (nxt["v"] - prev["v"]) / (nxt["s"] - prev["s"])
    between = F.when(nxt["s"] == prev["s"], prev["v"]).otherwise(
        prev["v"] + slope * (F.col("slot") - prev["s"])
    )
    return F.coalesce(between, prev["v"], nxt["v"], F.lit(0.0))


def fill_gaps(grid: DataFrame) -> DataFrame:
    """Fill ``vol_cum`` and ``price`` on a dense grid, day by day."""
    opening = (F.col("bar") == 1) & F.col("vol_cum").isNull()
    seeded = grid.withColumn("vol_cum", F.when(opening, 0.0).otherwise(F.col("vol_cum")))
    return seeded.withColumns({"vol_cum": _filled("vol_cum"), "price": _filled("price")})


def volume_delta(filled: DataFrame) -> DataFrame:
    """Cumulative to per-bar volume; falls count as zero, a day opens at its first value."""
    before = F.lag("vol_cum").over(_day())
    return filled.withColumn(
        "volume",
        F.when(before.isNull(), F.col("vol_cum")).otherwise(
            F.greatest(F.col("vol_cum") - before, F.lit(0.0))
        ),
    )


def build_bars(
    snaps: DataFrame,
    manifest: DataFrame | None = None,
    tf_minutes: int = 3,
    open_min: int = K.SESSION_OPEN_MIN,
    length: int = K.SESSION_MINUTES,
) -> DataFrame:
    """Snapshots to the dense, filled base bars.

    The slotted snapshots feed the calendar, the symbol universe and the bars, so they
    are written once and the raw snapshots are scanned a single time. ``manifest``
    (snap_ts) lists the snapshot times when some snapshots hold no rows.
    """
    per_day = -(-length // tf_minutes)
    known = materialise(slot_snapshots(snaps, tf_minutes, open_min, length), "slots")
    times = known if manifest is None else manifest
    calendar = snapshot_calendar(times.select("snap_ts"), tf_minutes, open_min, length)
    grid = dense_grid(symbol_universe(known, calendar), calendar, per_day)
    values = known.drop("snap_ts")
    return volume_delta(fill_gaps(grid.join(values, ["symbol", "day", "slot"], "left")))


def rollup(bars: DataFrame, ratio: int, per_day: int) -> DataFrame:
    """Coarser bars that sample the filled cumulative series of the finer ones.

    ``per_day`` is the number of fine bars per day; ratio == per_day gives daily bars.
    """
    new_per_day = -(-per_day // ratio)
    coarse = (
        bars.groupBy(
            "symbol", "day", "day_idx", F.ceil(F.col("slot") / ratio).cast("int").alias("slot")
        )
        .agg(
            F.max_by("vol_cum", "slot").alias("vol_cum"),
            F.max_by("price", "slot").alias("price"),
            F.max("last_bar").alias("last_bar"),
        )
        .withColumn("last_bar", F.ceil(F.col("last_bar") / ratio).cast("int"))
        .withColumn("bar", X.bar_index(F.col("day_idx"), F.col("slot"), new_per_day))
    )
    return volume_delta(coarse)


def trim_partial_days(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Drop the flat bars after the last snapshot of each day (an option, off by default)."""
    ends = calendar.select("day_idx", "last_slot")
    return bars.join(ends, "day_idx").filter("slot <= last_slot").drop("last_slot")


def merge_bars(existing: DataFrame, new: DataFrame, keys=("symbol", "day", "slot")) -> DataFrame:
    """Recomputed bars replace existing ones with the same key."""
    kept = existing.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new)


def ohlc_bars(
    ticks: DataFrame,
    tf_minutes: int = 60,
    open_min: int = 0,
    length: int = 1440,
) -> DataFrame:
    """Right-closed OHLCV bars from ticks (symbol, ts, price, size, seq).

    ``seq`` is the running deal number; one long orders deals, so the aggregation
    keeps fixed-width buffers and needs no sort.
    Only bars that traded exist. ``bar`` numbers them per symbol from 1. One map-side
    combined aggregation; the numbering window sees one row per bar of the calendar.
    """
    traded = (
        ticks.withColumn("slot", X.slot_of(F.col("ts"), tf_minutes, open_min, length))
        .filter("slot IS NOT NULL")
        .groupBy("symbol", F.to_date("ts").alias("day"), "slot")
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("size").cast("double").alias("volume"),
        )
    )
    order = Window.partitionBy("symbol").orderBy("day", "slot")
    return traded.withColumn("bar", F.row_number().over(order)).withColumn(
        "bar_ts", X.bar_end_ts(F.col("day"), F.col("slot"), tf_minutes, open_min)
    )


def prior_period_levels(bars: DataFrame, period: str = "D") -> DataFrame:
    """Each bar with the previous day/week/month high and low and when they occurred."""
    unit = {"D": "day", "W": "week", "M": "month"}[period]
    keyed = bars.withColumn("period", F.to_date(F.date_trunc(unit, F.col("day").cast("timestamp_ntz"))))
    first_high = F.struct("high", (-F.col("bar")).alias("r"))
    first_low = F.struct("low", "bar")
    per = keyed.groupBy("symbol", "period").agg(
        F.max("high").alias("h"),
        F.min("low").alias("l"),
        F.max_by("bar_ts", first_high).alias("ht"),
        F.min_by("bar_ts", first_low).alias("lt"),
    )
    w = Window.partitionBy("symbol").orderBy("period")
    prior = per.select(
        "symbol",
        "period",
        F.lag("h").over(w).alias("prior_high"),
        F.lag("ht").over(w).alias("prior_high_ts"),
        F.lag("l").over(w).alias("prior_low"),
        F.lag("lt").over(w).alias("prior_low_ts"),
    )
    return keyed.join(prior, ["symbol", "period"])


def last_signal_time(df: DataFrame, code: str = "code", ts: str = "bar_ts") -> DataFrame:
    """Time of the latest entry or exit, carried forward."""
    w = Window.partitionBy("symbol").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.when(X.is_entry_exit(F.col(code)), F.col(ts))
    return df.withColumn("signal_ts", F.last(hit, ignorenulls=True).over(w))


def pivot_panel(df: DataFrame, symbols: list[str], value: str = "value") -> DataFrame:
    """Days as rows, the named symbols as columns."""
    return df.groupBy("day").pivot("symbol", symbols).agg(F.first(value, ignorenulls=True))
