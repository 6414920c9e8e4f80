"""The given tables seen as market data. All mappings are deterministic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators.scoring import read_daily_panel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as deals: one symbol per user, price, size."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One poll per minute and traded symbol: cumulative size of the day and last price.

    Deals are folded to one row per symbol and minute first, so the running sum
    covers at most a day of minutes.
    """
    t = ticks(spark, sf_dir)
    minute = (F.hour("ts") * 60 + F.minute("ts") + 1).alias("minute")
    per_minute = t.groupBy("symbol", F.to_date("ts").alias("day"), minute).agg(
        F.sum("size").alias("size"), F.max_by("price", "seq").alias("price")
    )
    w = Window.partitionBy("symbol", "day").orderBy("minute")
    stamp = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minute"))
    # The last minute of a day is stamped at the next day's 00:00.
    return per_minute.select(
        "symbol",
        stamp.alias("snap_ts"),
        F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("vol_cum"),
        "price",
    )


def base_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.build_bars(snapshots(spark, sf_dir))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ohlc_bars(ticks(spark, sf_dir), 60)


#: Desks that the users are dealt to, for reports that need long series.
DESKS = 20


def desk_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of all ticks with a desk of users as symbol."""
    t = ticks(spark, sf_dir)
    number = F.substring("symbol", 2, 20).cast("long") % DESKS
    return B.ohlc_bars(t.withColumn("symbol", F.concat(F.lit("G"), number.cast("string"))), 60)


def desk_sql(sql: str) -> str:
    return sql.replace("'T' || CAST(user_id AS VARCHAR) AS symbol", f"'G' || CAST(user_id % {DESKS} AS VARCHAR) AS symbol")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as a daily panel: value = quantity, ltp = average unit price."""
    li = table(spark, sf_dir, "lineitem")
    daily = li.groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.to_date("l_shipdate").alias("day"),
    ).agg(
        F.sum("l_quantity").alias("value"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("ltp"),
    )
    return read_daily_panel(daily, "value")


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier symbols by nation."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("sector"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"),
    )


def index_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping index families: nations (narrow) and regions (broad)."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    all_ = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    symbol = F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol")
    narrow = all_.select(F.col("n_name").alias("index_name"), F.col("n_nationkey").alias("list_pos"), symbol)
    broad = all_.select(F.col("r_name").alias("index_name"), (F.col("r_regionkey") + 100).alias("list_pos"), symbol)
    return narrow.unionByName(broad)


# --- the same roles in SQL ------------------------------------------------------

TICKS_SQL = """
ticks AS MATERIALIZED (
  SELECT 'T' || CAST(user_id AS VARCHAR) AS symbol, ts, event_id AS seq, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size
  FROM events)"""

SNAPSHOTS_SQL = (
    TICKS_SQL
    + """,
per_minute AS (
  SELECT symbol, CAST(ts AS DATE) AS day, CAST(hour(ts) * 60 + minute(ts) + 1 AS INT) AS minute,
         sum(size) AS size, arg_max(price, seq) AS price
  FROM ticks GROUP BY 1, 2, 3),
snaps AS MATERIALIZED (
  SELECT symbol, CAST(day AS TIMESTAMP) + to_minutes(minute) AS snap_ts, day, minute,
         sum(size) OVER (PARTITION BY symbol, day ORDER BY minute ROWS UNBOUNDED PRECEDING) AS vol_cum,
         price
  FROM per_minute)"""
)

BARS_SQL = (
    SNAPSHOTS_SQL
    + """,
slotted AS (
  SELECT *, CAST(ceil((minute - 555) / 3.0) AS INT) AS slot FROM snaps
  WHERE minute - 555 > 0 AND minute - 555 <= 375),
known AS (
  SELECT symbol, day, slot, arg_max(vol_cum, snap_ts) AS vol_cum, arg_max(price, snap_ts) AS price
  FROM slotted GROUP BY ALL),
cal AS (
  SELECT day, row_number() OVER (ORDER BY day) AS day_idx, max(snap_ts) AS last_ts, max(slot) AS last_slot
  FROM slotted GROUP BY day),
uni AS (SELECT DISTINCT symbol FROM snaps WHERE snap_ts IN (SELECT last_ts FROM cal)),
grid AS (
  SELECT u.symbol, c.day, CAST(c.day_idx AS INT) AS day_idx, CAST(s.slot AS INT) AS slot,
         CAST((c.day_idx - 1) * 125 + s.slot AS INT) AS bar,
         (SELECT CAST((max(day_idx) - 1) * 125 + arg_max(last_slot, day_idx) AS INT) FROM cal) AS last_bar
  FROM uni u, cal c, (SELECT unnest(range(1, 126)) AS slot) s
  WHERE s.slot <= CASE WHEN c.day_idx = (SELECT max(day_idx) FROM cal) THEN c.last_slot ELSE 125 END),
seeded AS (
  SELECT g.*, CASE WHEN g.bar = 1 AND k.vol_cum IS NULL THEN 0.0 ELSE k.vol_cum END AS v, k.price AS p
  FROM grid g LEFT JOIN known k USING (symbol, day, slot)),
pts AS (
  SELECT *,
    last_value(v IGNORE NULLS) OVER b AS v0,
    last_value(CASE WHEN v IS NOT NULL THEN slot END IGNORE NULLS) OVER b AS vs0,
    first_value(v IGNORE NULLS) OVER a AS v1,
    first_value(CASE WHEN v IS NOT NULL THEN slot END IGNORE NULLS) OVER a AS vs1,
    last_value(p IGNORE NULLS) OVER b AS p0,
    last_value(CASE WHEN p IS NOT NULL THEN slot END IGNORE NULLS) OVER b AS ps0,
    first_value(p IGNORE NULLS) OVER a AS p1,
    first_value(CASE WHEN p IS NOT NULL THEN slot END IGNORE NULLS) OVER a AS ps1
  FROM seeded
  WINDOW b AS (PARTITION BY symbol, day_idx ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY symbol, day_idx ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT symbol, day, day_idx, slot, bar, last_bar,
    CASE WHEN v0 IS NULL AND v1 IS NULL THEN 0 WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0
         WHEN vs0 = vs1 THEN v0 ELSE v0 + (v1 - v0) / (vs1 - vs0) * (slot - vs0) END AS vol_cum,
    CASE WHEN p0 IS NULL AND p1 IS NULL THEN 0 WHEN p0 IS NULL THEN p1 WHEN p1 IS NULL THEN p0
         WHEN ps0 = ps1 THEN p0 ELSE p0 + (p1 - p0) / (ps1 - ps0) * (slot - ps0) END AS price
  FROM pts),
bars AS MATERIALIZED (
  SELECT *, CASE WHEN slot = 1 THEN vol_cum ELSE greatest(vol_cum - lag(vol_cum) OVER
      (PARTITION BY symbol, day_idx ORDER BY slot), 0) END AS volume
  FROM filled)"""
)

HOURLY_SQL = (
    TICKS_SQL
    + """,
hourly_raw AS (
  SELECT symbol, CAST(ts AS DATE) AS day,
         CAST(ceil((hour(ts) * 60 + minute(ts) + second(ts) / 60.0) / 60.0) AS INT) AS slot,
         price, size, ts, seq
  FROM ticks WHERE hour(ts) * 60 + minute(ts) + second(ts) / 60.0 > 0),
hourly AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY day, slot) AS INT) AS bar,
         CAST(day AS TIMESTAMP) + to_hours(slot) AS bar_ts
  FROM (SELECT symbol, day, slot, arg_min(price, seq) AS open, max(price) AS high,
               min(price) AS low, arg_max(price, seq) AS close, sum(size) AS volume
        FROM hourly_raw GROUP BY 1, 2, 3))"""
)

PANEL_SQL = """
panel AS MATERIALIZED (
  SELECT d.*, CAST(c.day_idx AS INT) AS day_idx FROM (
    SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS day,
           sum(l_quantity) AS value, sum(l_extendedprice) / sum(l_quantity) AS ltp
    FROM lineitem GROUP BY 1, 2) d
  JOIN (SELECT day, row_number() OVER (ORDER BY day) AS day_idx
        FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)) c USING (day))"""

SECTORS_SQL = """
sectors AS (
  SELECT n_name AS sector, 'S' || CAST(s_suppkey AS VARCHAR) AS symbol
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

MEMBERS_SQL = """
members AS (
  SELECT n_name AS index_name, n_nationkey AS list_pos, 'S' || CAST(s_suppkey AS VARCHAR) AS symbol
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT r_name, r_regionkey + 100, 'S' || CAST(s_suppkey AS VARCHAR)
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
