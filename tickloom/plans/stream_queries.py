"""Streaming jobs run to completion over the whole tables, results read back from files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import scalar as X
from tickloom.operators import bars as B
from tickloom.operators import indicators as I
from tickloom.plans import adapters as A
from tickloom.plans.registry import query
from tickloom.plans.signal_sql import Chain
from tickloom.plans.source_queries import DATED, POLLS
from tickloom.session import materialise, scratch_path
from tickloom.sources import sinks as W
from tickloom.streaming import streams as S


def _as_stream(df, name):
    """Write a table to the shared folder and follow it as a stream."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _fed(df, key, name, make, parts=3):
    """Follow a table that grows in parts, by ``key``; the job is restarted for each part."""
    spark = df.sparkSession
    root, out, check = (scratch_path(spark, f"{name}-{x}") for x in ("in", "out", "checkpoint"))
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    step = (hi - lo) // parts + 1 if lo is not None else 1
    for k in range(parts):
        part = df if lo is None else df.filter((F.col(key) >= lo + k * step) & (F.col(key) < lo + (k + 1) * step))
        part.write.mode("append").parquet(root)
        got = make(spark.readStream.schema(df.schema).parquet(root), out, check)
    return got


def _run(stream, name):
    spark = stream.sparkSession
    return S.run_to_files(stream, scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint"))


@query(
    "stream_bars",
    f"""WITH {A.BARS_SQL}, b AS (SELECT symbol, day, slot, vol_cum, price, CAST(day AS TIMESTAMP) + to_minutes(CAST(slot * 3 + 555 AS INT)) AS e FROM known)
    SELECT symbol, strftime(e, '%Y-%m-%d %H:%M') AS bar_end, vol_cum, price FROM b WHERE e <= (SELECT max(e) FROM b) - INTERVAL 6 MINUTE""",
    r="vol_cum price",
)
def stream_bars(spark, d):
    """Bars still open at the end of the data stay in state."""
    out = _run(S.stream_bars(_as_stream(A.snapshots(spark, d), "snaps")), "bars")
    return out.withColumn("bar_end", F.date_format("bar_end", "yyyy-MM-dd HH:mm"))


@query(
    "stream_moving_average",
    f"""WITH {A.BARS_SQL}, v AS MATERIALIZED (SELECT symbol, bar, volume FROM bars)
    SELECT a.symbol, a.bar, any_value(a.volume) AS volume, sum(pow(1 - 1.0::DOUBLE / 8, a.bar - b.bar) * b.volume * CASE WHEN b.bar = 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / 8 END) AS ma
    FROM v a JOIN v b ON a.symbol = b.symbol AND b.bar <= a.bar GROUP BY 1, 2""",
    r="volume ma",
)
def stream_moving_average(spark, d):
    S.use_rocksdb(spark)
    bars = A.base_bars(spark, d).select("symbol", F.col("day").cast("string").alias("day"), "bar", "vol_cum")
    out = _fed(bars, "bar", "ma", lambda rows, path, check: S.run_to_files(S.stream_moving_average(rows), path, check))
    return out.filter("NOT late").drop("late")


@query(
    "stream_corrected_average",
    f"""WITH {A.BARS_SQL}, v AS MATERIALIZED (SELECT symbol, bar, volume FROM bars)
    SELECT a.symbol, a.bar, any_value(a.volume) AS volume, sum(pow(1 - 1.0::DOUBLE / 8, a.bar - b.bar) * b.volume * CASE WHEN b.bar = 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / 8 END) AS ma
    FROM v a JOIN v b ON a.symbol = b.symbol AND b.bar <= a.bar GROUP BY 1, 2""",
    r="volume ma",
)
def stream_corrected_average(spark, d):
    """Every eleventh bar comes 40 bars late; what followed it is corrected, so the last versions equal a reload."""
    S.use_rocksdb(spark)
    late = F.when(F.col("bar") % 11 == 7, 40).otherwise(0)
    bars = A.base_bars(spark, d).select("symbol", F.col("day").cast("string").alias("day"), "bar", "vol_cum", (F.col("bar") + late).alias("at"))
    run = lambda rows, path, check: S.run_to_files(S.stream_moving_average(rows, window=128), path, check)
    return S.latest_version(_fed(bars, "at", "corrected", run))


ALERTS_SQL = """SELECT symbol, alert_id, signal FROM (SELECT *, lag(signal) OVER (PARTITION BY symbol ORDER BY alert_id) AS p FROM (
  SELECT 'C' || o_custkey AS symbol, o_orderkey AS alert_id, CASE WHEN o_totalprice > 250000 THEN 'BUY' ELSE 'SELL' END AS signal FROM orders))
WHERE p IS DISTINCT FROM signal"""


def _alerts(spark, d):
    return A.table(spark, d, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.col("o_orderkey").alias("alert_id"),
        F.when(F.col("o_totalprice") > 250000, "BUY").otherwise("SELL").alias("signal"),
    )


@query("dedup_alerts", ALERTS_SQL)
def dedup_alerts(spark, d):
    return S.dedup_alerts(_alerts(spark, d))


@query("stream_dedup_alerts", ALERTS_SQL)
def stream_dedup_alerts(spark, d):
    S.use_rocksdb(spark)
    return _run(S.dedup_alerts(_as_stream(_alerts(spark, d), "alerts")), "dedup")


@query(
    "stream_once_per_scan",
    """SELECT DISTINCT 'NSE' AS exch, 'T' || user_id AS symbol, event_type AS signal,
      strftime(time_bucket(INTERVAL 3 MINUTE, ts), '%Y-%m-%d %H:%M') AS scan_start FROM events""",
)
def stream_once_per_scan(spark, d):
    """A deal passes once in each scan; all files are there, so none is late."""
    e = A.table(spark, d, "events").select(
        F.lit("NSE").alias("exch"),
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("symbol"),
        F.col("event_type").alias("signal"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    out = _run(S.once_per_scan(_as_stream(e, "deals")), "guard")
    return out.select("exch", "symbol", "signal", F.date_format("scan_start", "yyyy-MM-dd HH:mm").alias("scan_start"))


@query(
    "stream_bar_table",
    f"WITH {A.BARS_SQL} SELECT symbol, bar, vol_cum, price, volume FROM bars",
    r="vol_cum price volume",
)
def stream_bar_table(spark, d):
    """The bar table after three restarts of the job, with new days and symbols in each."""
    store = scratch_path(spark, "bar-table")
    snaps = A.snapshots(spark, d).withColumn("at", F.unix_timestamp("snap_ts"))

    def write(rows, path, check):
        S.follow(rows.drop("at"), S.bar_table_writer(store), check, live=False).awaitTermination()
        return W.read_bars(spark, f"{store}/bars", "3")

    return _fed(snaps, "at", "table", write).select("symbol", "bar", "vol_cum", "price", "volume")


@query(
    "stream_osc_signal",
    Chain().rsi_osc().osc("rsi_fast", "rsi_sig", "c", 50).sql("symbol, bar, c AS code FROM TOP WHERE rsi_sig IS NOT NULL"),
)
def stream_osc_signal(spark, d):
    S.use_rocksdb(spark)
    rows = I.rsi_osc(A.hourly(spark, d)).select(
        "symbol", "bar", F.col("rsi_fast").alias("fast"), F.col("rsi_sig").alias("sig")
    )
    rows = materialise(rows, "osc")
    out = _fed(rows, "bar", "codes", lambda r, path, check: S.run_to_files(S.stream_osc_signal(r, 50), path, check))
    out = out.filter("NOT late").drop("late")
    ready = rows.filter("sig IS NOT NULL").select("symbol", "bar")
    return out.join(ready, ["symbol", "bar"], "left_semi")


def _followed_files(spark, d):
    """Snapshot files land in three parts, by day and poll; the job starts anew for each, some files a batch.

    Each part brings files that are no snapshots too: one without a time in its name, and lines that are cut short.
    """
    s = B.slot_snapshots(A.snapshots(spark, d), 3)
    end = X.bar_end_ts(F.col("day"), F.col("slot"), 3)
    rows = s.select("symbol", "vol_cum", F.lit("0.00").alias("vol_val_cum"), "price", F.date_format(end, "ddMMyyyy").alias("d"), F.date_format(end, "HHmm").alias("hm"), "slot")
    rows = materialise(rows, "rows")
    root, store, check = (scratch_path(spark, f"files-{x}") for x in ("in", "store", "checkpoint"))
    for k in range(3):
        part = rows.filter(F.col("slot") % 3 == k)
        some = part.filter(F.col("slot") == 12 + k)
        cut, odd = some.withColumn("price", F.lit(None).cast("double")), some.withColumn("hm", F.lit("none"))
        whole = part.unionByName(cut).unionByName(odd).drop("slot")
        whole.repartition("d").write.mode("append").option("header", True).partitionBy("d", "hm").csv(root)
        lines = S.stream_lines(spark, root, max_files=1500).withColumn("path", F.col("_metadata.file_path"))
        S.follow(lines, S.snapshot_writer(store, DATED), check, live=False).awaitTermination()
    return store


@query("stream_snapshots", POLLS + " SELECT symbol, snap_ts, vol_cum, price FROM s", r="vol_cum price")
def stream_snapshots(spark, d):
    """The snapshots of all files after three starts of the job equal a batch read."""
    return spark.read.parquet(f"{_followed_files(spark, d)}/snapshots").select("symbol", "snap_ts", "vol_cum", "price")


@query(
    "stream_broken_files",
    POLLS + """, odd AS (SELECT *, CAST((date_diff('minute', CAST(day AS TIMESTAMP), snap_ts) - 555) / 3 AS INT) AS slot FROM s)
    SELECT reason, count(*) AS n FROM odd, (SELECT unnest(['short row', 'no time in the name']) AS reason) WHERE slot IN (12, 13, 14) GROUP BY 1""",
)
def stream_broken_files(spark, d):
    rows = spark.read.parquet(f"{_followed_files(spark, d)}/broken")
    return rows.groupBy("reason").agg(F.sum("n").alias("n"))

