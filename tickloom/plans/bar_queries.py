"""Session arithmetic and bar building."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tickloom.functions import constants as K
from tickloom.functions import scalar as X
from tickloom.operators import bars as B
from tickloom.plans import adapters as A
from tickloom.plans.registry import query
from tickloom.session import materialise

BAR_COLS = ["symbol", "day", "slot", "bar", "vol_cum", "price", "volume"]


@query(
    "slot_snapshots",
    f"WITH {A.BARS_SQL} SELECT symbol, day, slot, vol_cum, price FROM known", r="vol_cum price", day="day")
def slot_snapshots(spark, d):
    return B.slot_snapshots(A.snapshots(spark, d)).drop("snap_ts")


@query("snapshot_calendar", f"WITH {A.BARS_SQL} SELECT * FROM cal", day="day")
def snapshot_calendar(spark, d):
    return B.snapshot_calendar(A.snapshots(spark, d).select("snap_ts"))


@query("symbol_universe", f"WITH {A.BARS_SQL} SELECT symbol FROM uni")
def symbol_universe(spark, d):
    snaps = A.snapshots(spark, d)
    return B.symbol_universe(snaps, B.snapshot_calendar(snaps.select("snap_ts")))


@query("dense_grid", f"WITH {A.BARS_SQL} SELECT * FROM grid", day="day")
def dense_grid(spark, d):
    snaps = A.snapshots(spark, d)
    cal = B.snapshot_calendar(snaps.select("snap_ts"))
    return B.dense_grid(B.symbol_universe(snaps, cal), cal, 125)


@query("fill_gaps", f"WITH {A.BARS_SQL} SELECT symbol, bar, vol_cum, price FROM filled", r="vol_cum price")
def fill_gaps(spark, d):
    return A.base_bars(spark, d).select("symbol", "bar", "vol_cum", "price")


@query("volume_delta", f"WITH {A.BARS_SQL} SELECT symbol, day, slot, bar, vol_cum, price, volume FROM bars", r="vol_cum price volume", day="day")
def volume_delta(spark, d):
    return A.base_bars(spark, d).select(*BAR_COLS)


ROLLUP_SQL = """, coarse AS (
  SELECT symbol, day, day_idx, CAST(ceil(slot / {r}.0) AS INT) AS slot,
         arg_max(vol_cum, slot) AS vol_cum, arg_max(price, slot) AS price
  FROM bars GROUP BY 1, 2, 3, 4)
SELECT symbol, day, slot, CAST((day_idx - 1) * {n} + slot AS INT) AS bar, vol_cum, price,
  CASE WHEN slot = 1 THEN vol_cum ELSE greatest(vol_cum - lag(vol_cum) OVER
    (PARTITION BY symbol, day_idx ORDER BY slot), 0) END AS volume
FROM coarse"""


@query("rollup_15m", f"WITH {A.BARS_SQL}" + ROLLUP_SQL.format(r=5, n=25), r="vol_cum price volume", day="day")
def rollup_15m(spark, d):
    return B.rollup(A.base_bars(spark, d), 5, 125).select(*BAR_COLS)


@query("rollup_daily", f"WITH {A.BARS_SQL}" + ROLLUP_SQL.format(r=125, n=1), r="vol_cum price volume", day="day")
def rollup_daily(spark, d):
    return B.rollup(A.base_bars(spark, d), 125, 125).select(*BAR_COLS)


@query(
    "trim_partial_days",
    f"WITH {A.BARS_SQL} SELECT symbol, bar, volume FROM bars JOIN (SELECT day, last_slot FROM cal) USING (day) WHERE slot <= last_slot", r="volume")
def trim_partial_days(spark, d):
    snaps = A.snapshots(spark, d)
    cal = B.snapshot_calendar(snaps.select("snap_ts"))
    return B.trim_partial_days(B.build_bars(snaps), cal).select("symbol", "bar", "volume")


@query(
    "merge_bars",
    f"WITH {A.BARS_SQL} SELECT symbol, day, slot, CASE WHEN day_idx > 20 THEN price + 1 ELSE price END AS price FROM bars", r="price", day="day")
def merge_bars(spark, d):
    """The last days are recomputed and replace the stored ones."""
    bars = A.base_bars(spark, d).select("symbol", "day", "slot", "day_idx", "price")
    stored = bars.filter("day_idx <= 25")
    new = bars.filter("day_idx > 20").withColumn("price", F.col("price") + 1)
    return B.merge_bars(stored, new).select("symbol", "day", "slot", "price")


@query("ohlc_bars", f"WITH {A.HOURLY_SQL} SELECT * FROM hourly", r="open high low close volume", day="day")
def ohlc_bars(spark, d):
    return A.hourly(spark, d)


def _levels_sql(unit: str) -> str:
    return f"""WITH {A.HOURLY_SQL},
k AS (SELECT *, CAST(date_trunc('{unit}', day) AS DATE) AS period FROM hourly),
p AS (SELECT symbol, period, max(high) AS h, min(low) AS l, arg_max(bar_ts, (high, -bar)) AS ht,
        arg_min(bar_ts, (low, bar)) AS lt FROM k GROUP BY 1, 2),
q AS (SELECT symbol, period, lag(h) OVER w AS prior_high, lag(ht) OVER w AS prior_high_ts,
        lag(l) OVER w AS prior_low, lag(lt) OVER w AS prior_low_ts FROM p
      WINDOW w AS (PARTITION BY symbol ORDER BY period))
SELECT symbol, bar, period, prior_high, prior_high_ts, prior_low, prior_low_ts FROM k JOIN q USING (symbol, period)"""


def _levels(unit):
    def run(spark, d):
        return B.prior_period_levels(A.hourly(spark, d), unit).select(
            "symbol", "bar", "period", "prior_high", "prior_high_ts", "prior_low", "prior_low_ts"
        )

    return run


for _unit, _name in (("D", "day"), ("W", "week"), ("M", "month")):
    query(f"prior_{_name}_levels", _levels_sql(_name), r="prior_high prior_low", day="period")(_levels(_unit))


@query(
    "pivot_panel",
    f"""WITH {A.PANEL_SQL} SELECT day, any_value(value) FILTER (symbol = 'S1') AS "S1",
    any_value(value) FILTER (symbol = 'S2') AS "S2", any_value(value) FILTER (symbol = 'S3') AS "S3"
    FROM panel GROUP BY day""", r="S1 S2 S3", day="day")
def pivot_panel(spark, d):
    return B.pivot_panel(A.panel(spark, d), ["S1", "S2", "S3"])


# --- session arithmetic ---------------------------------------------------------


@query(
    "session_clock",
    """SELECT event_id,
      (m > 0 AND m <= 375) AS valid,
      CASE WHEN m > 0 AND m <= 375 THEN CAST(ceil(m / 3) AS INT) ELSE -1 END AS slot,
      CAST(greatest(ceil(m / 15), 0) AS INT) AS intervals,
      CASE WHEN m > 0 AND m <= 375 THEN CAST(3 * ceil(m / 3) + 555 AS INT) ELSE -1 END AS end_minute,
      CASE WHEN m >= 1 THEN least(ts, date_trunc('day', ts) + INTERVAL 930 MINUTE) END AS gated
    FROM (SELECT *, hour(ts) * 60 + minute(ts) + second(ts) / 60.0 - 555 AS m FROM events)""",
)
def session_clock(spark, d):
    e = A.table(spark, d, "events")
    ts = F.col("ts")
    m = X.minutes_after_open(ts)
    slot = X.slot_of(ts, 3)
    return e.select(
        "event_id",
        X.in_session(ts).alias("valid"),
        F.coalesce(slot, F.lit(-1)).alias("slot"),
        X.interval_count(F.lit(0), m, 15).alias("intervals"),
        F.coalesce(X.bar_end_minute(slot, 3), F.lit(-1)).alias("end_minute"),
        X.session_gate(ts).alias("gated"),
    )


@query(
    "bar_labels",
    f"""WITH {A.BARS_SQL}
    SELECT symbol, bar, CAST(bar AS VARCHAR) || ': ' || strftime(t, '%d/%m_%H%M') AS label,
      strftime(t, '%H%M') AS short_label, strftime(t, '%d/%m') AS day_label
    FROM (SELECT *, CAST(day AS TIMESTAMP) + to_minutes(CAST(slot * 3 + 555 AS INT)) AS t FROM bars)""",
)
def bar_labels(spark, d):
    end = X.bar_end_ts(F.col("day"), F.col("slot"), 3)
    return A.base_bars(spark, d).select(
        "symbol",
        "bar",
        X.bar_label(F.col("bar"), end).alias("label"),
        X.bar_label_short(end, "3").alias("short_label"),
        X.bar_label_short(end, "D").alias("day_label"),
    )


@query(
    "time_text",
    """SELECT event_id, hour(ts) || ':' || minute(ts) AS hm,
      day(ts) || '/' || month(ts) || '_' || hour(ts) || ':' || minute(ts) AS dmhm FROM events""",
)
def time_text(spark, d):
    e = A.table(spark, d, "events")
    return e.select("event_id", X.fmt_time(F.col("ts")).alias("hm"), X.fmt_datetime(F.col("ts")).alias("dmhm"))


@query(
    "look_back_window",
    "SELECT symbol, count(*) AS n FROM (SELECT 'T' || CAST(user_id AS VARCHAR) AS symbol, ts FROM events) "
    "WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY - INTERVAL 12 HOUR GROUP BY 1",
)
def look_back_window(spark, d):
    now = datetime(2024, 1, 30)
    t = A.ticks(spark, d).filter(X.in_window(F.col("ts"), now, days=7, hours=12))
    return t.groupBy("symbol").agg(F.count("*").alias("n"))


@query(
    "bars_per_day",
    f"""WITH {A.BARS_SQL}, full_days AS (SELECT symbol, day, slot, day_idx FROM bars WHERE day_idx < (SELECT max(day_idx) FROM bars))
    SELECT tf, per_day, count(*) AS n_days, min(n) AS least, max(n) AS most FROM (
      SELECT '3' AS tf, 125 AS per_day, symbol, day, count(*) AS n FROM full_days GROUP BY symbol, day
      UNION ALL SELECT '15', 25, symbol, day, count(DISTINCT (slot - 1) // 5) FROM full_days GROUP BY symbol, day
      UNION ALL SELECT 'D', 1, symbol, day, 1 FROM full_days GROUP BY symbol, day) GROUP BY 1, 2""",
)
def bars_per_day(spark, d):
    """Every whole day of every symbol has the bars that its timeframe asks for."""
    base = A.base_bars(spark, d)
    last = base.agg(F.max("day_idx").alias("last"))
    full = materialise(base.join(last, F.col("day_idx") < F.col("last")).select("symbol", "day", "slot"), "days")
    parts = []
    for tf, step in K.TIMEFRAME_MINUTES.items():
        if tf in ("3", "15", "D"):
            slot = F.lit(0) if tf == "D" else F.floor((F.col("slot") - 1) / (step // 3))
            n = full.groupBy("symbol", "day").agg(F.count_distinct(slot).alias("n"))
            parts.append(n.select(F.lit(tf).alias("tf"), F.lit(X.bars_per_day(tf)).alias("per_day"), "n"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("tf", "per_day").agg(F.count("*").alias("n_days"), F.min("n").alias("least"), F.max("n").alias("most"))

