"""Readers and writers, fed with files that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scalar as X
from tickloom.operators import bars as B
from tickloom.operators import scan as G
from tickloom.plans import adapters as A
from tickloom.plans.registry import query
from tickloom.plans.scan_queries import COLS, SCAN, surge_sql
from tickloom.plans.scoring_queries import ASSIGN_MULTI
from tickloom.plans.scoring_queries import M as MEMBERS
from tickloom.plans.deal_queries import MASTER_SQL, OB_SQL, POS_SQL
from tickloom.plans.deal_queries import _book_orders, _master, _positions
from tickloom.session import scratch_path
from tickloom.sources import files as R
from tickloom.sources import sinks as W

DATED = r"d=(\d{8})/hm=(\d{4})/[^/]*\.csv$"


def _snapshot_files(spark, d):
    """Snapshots as one CSV folder per day and poll; a poll every 3 minutes, as the session has them."""
    s = B.slot_snapshots(A.snapshots(spark, d), 3)
    end = X.bar_end_ts(F.col("day"), F.col("slot"), 3)
    path = scratch_path(spark, "csv")
    (
        s.select(
            "symbol",
            "vol_cum",
            F.lit("0.00").alias("vol_val_cum"),
            "price",
            F.date_format(end, "ddMMyyyy").alias("d"),
            F.date_format(end, "HHmm").alias("hm"),
        )
        .repartition("d")
        .write.option("header", True)
        .partitionBy("d", "hm")
        .csv(path)
    )
    return path


POLLS = f"""WITH {A.SNAPSHOTS_SQL}, s AS (SELECT symbol, day, CAST(day AS TIMESTAMP) + to_minutes(CAST(555 + 3 * slot AS INT)) AS snap_ts, vol_cum, price FROM (
  SELECT symbol, day, CAST(ceil((minute - 555) / 3.0) AS INT) AS slot, arg_max(vol_cum, snap_ts) AS vol_cum, arg_max(price, snap_ts) AS price
  FROM snaps WHERE minute > 555 AND minute <= 930 GROUP BY 1, 2, 3))"""


@query("read_snapshots", POLLS + " SELECT symbol, snap_ts, vol_cum, price FROM s", r="vol_cum price")
def read_snapshots(spark, d):
    return R.read_snapshots(spark, _snapshot_files(spark, d), pattern=DATED)


@query(
    "snapshot_manifest",
    POLLS + " SELECT DISTINCT day, snap_ts FROM s WHERE day IN (SELECT DISTINCT day FROM s ORDER BY day DESC LIMIT 5)",
    day="day",
)
def snapshot_manifest(spark, d):
    return R.snapshot_manifest(spark, _snapshot_files(spark, d), 5, DATED).select("day", "snap_ts").distinct()


@query(
    "unknown_symbols",
    f"WITH {A.BARS_SQL} SELECT DISTINCT symbol FROM snaps WHERE symbol NOT IN (SELECT symbol FROM uni)",
)
def unknown_symbols(spark, d):
    snaps = A.snapshots(spark, d)
    universe = B.symbol_universe(snaps, B.snapshot_calendar(snaps.select("snap_ts")))
    return R.unknown_symbols(snaps, universe)


@query(
    "normalise_exchange",
    """SELECT 'P' || l_partkey AS symbol, l_quantity AS vol_cum, printf('%.2f', l_extendedprice) AS vol_val_cum, l_extendedprice / l_quantity AS price
    FROM lineitem WHERE l_discount > 0""",
    r="vol_cum price",
)
def normalise_exchange(spark, d):
    raw = A.table(spark, d, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("Symbol"),
        F.col("l_quantity").alias("Volume (Contracts) - Futures"),
        F.col("l_extendedprice").alias("Value (Lakhs) - Futures"),
        F.when(F.col("l_discount") > 0, F.col("l_extendedprice") / F.col("l_quantity")).alias("Underlying"),
    )
    return R.normalise_exchange(
        raw,
        {
            "Symbol": "symbol",
            "Volume (Contracts) - Futures": "vol_cum",
            "Value (Lakhs) - Futures": "vol_val_cum",
            "Underlying": "price",
        },
    )


@query(
    "exclude_holidays",
    """WITH h AS (SELECT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error' AND value > 300 GROUP BY 1)
    SELECT event_id FROM events WHERE CAST(ts AS DATE) NOT IN (SELECT day FROM h)""",
)
def exclude_holidays(spark, d):
    e = A.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    bad = e.filter("event_type = 'error' AND value > 300").select("day").distinct()
    entry = F.struct(F.date_format("day", "dd-MMM-yyyy").alias("Date"), F.lit("closed").alias("Holiday"))
    calendar = R.parse_holidays(bad.select(F.to_json(F.array(entry)).alias("value")))
    return R.exclude_holidays(e, calendar).select("event_id")


@query(
    "parse_constituents",
    "SELECT o_orderkey, upper(trim(o_orderpriority)) AS symbol FROM orders WHERE o_orderstatus <> 'F'",
)
def parse_constituents(spark, d):
    o = A.table(spark, d, "orders")
    item = F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" ")))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("index itself").alias("symbol")), F.struct(item.alias("symbol"))).alias("data")))
    return R.parse_constituents(o.select("o_orderkey", body.alias("value")))


@query(
    "unpivot_sectors",
    f"{MEMBERS}, {ASSIGN_MULTI} SELECT category AS sector, symbol FROM assigned",
)
def unpivot_sectors(spark, d):
    from tickloom.plans.scoring_queries import category_matrix

    wide = category_matrix(spark, d).drop("row")
    path = scratch_path(spark, "wide")
    wide.write.option("header", True).csv(path)
    return R.read_sector_map(spark, path)


@query("read_symbol_list", "SELECT DISTINCT p_name AS symbol FROM part WHERE p_size > 5 AND p_size <> 50")
def read_symbol_list(spark, d):
    size = F.col("p_size")
    line = F.when(size <= 5, F.concat(F.lit("# "), "p_name")).when(size == 50, "  ").otherwise(F.concat("p_name", F.lit(" ")))
    path = scratch_path(spark, "list")
    A.table(spark, d, "part").select(line.alias("value")).write.text(path)
    return R.read_symbol_list(spark, path).distinct()


@query(
    "read_instruments",
    f"WITH {MASTER_SQL} SELECT exch, inst, symbol, display_raw, security_id, lot, expiry, strike, opt_type FROM master WHERE inst <> 'INDEX'",
    r="strike",
)
def read_instruments(spark, d):
    m = _master(spark, d)
    kind = F.when(F.col("inst") == "INDEX", "OTHER").when(F.col("inst") == "EQUITY", "ES").when(F.col("inst") == "FUTSTK", "FUT").otherwise("OP")
    raw = m.select(
        F.col("exch").alias("EXCH_ID"),
        F.col("inst").alias("INSTRUMENT"),
        kind.alias("INSTRUMENT_TYPE"),
        F.col("symbol").alias("UNDERLYING_SYMBOL"),
        F.col("display_raw").alias("DISPLAY_NAME"),
        F.col("security_id").alias("SECURITY_ID"),
        F.col("security_id").alias("UNDERLYING_SECURITY_ID"),
        F.col("lot").alias("LOT_SIZE"),
        F.nullif("expiry", F.lit("")).alias("SM_EXPIRY_DATE"),
        F.col("strike").alias("STRIKE_PRICE"),
        F.nullif("opt_type", F.lit("")).alias("OPTION_TYPE"),
    )
    paths = []
    for exch in ("NSE", "MCX"):
        paths.append(scratch_path(spark, exch))
        raw.filter(F.col("EXCH_ID") == exch).write.option("header", True).csv(paths[-1])
    return R.read_instruments(spark, paths).drop("load_pos")


@query(
    "read_positions",
    f"WITH {POS_SQL} SELECT security_id, trading_symbol, exchange_seg, product, multiplier, net_qty, buy_qty, sell_qty FROM pos WHERE trading_symbol <> ''",
    r="multiplier",
)
def read_positions(spark, d):
    p = _positions(spark, d).filter("trading_symbol <> ''")
    names = {
        "security_id": "securityId", "trading_symbol": "tradingSymbol", "exchange_seg": "exchangeSegment", "product": "productType",
        "multiplier": "multiplier", "net_qty": "netQty", "buy_qty": "buyQty", "sell_qty": "sellQty", "buy_avg": "buyAvg", "sell_avg": "sellAvg",
    }
    path = scratch_path(spark, "positions")
    p.select(*[F.col(a).alias(b) for a, b in names.items()]).write.json(path)
    return R.read_positions(spark, path).select(
        "security_id", "trading_symbol", "exchange_seg", "product", "multiplier", "net_qty", "buy_qty", "sell_qty"
    )


@query(
    "read_orders",
    f"WITH {OB_SQL} SELECT order_id, status, side, qty, price, trigger_price, CAST(coalesce(n, 0) AS INT) AS n_legs FROM ord LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    r="price trigger_price",
)
def read_orders(spark, d):
    o = _book_orders(spark, d)
    leg = F.transform(
        "legs",
        lambda x: F.struct(
            x["status"].alias("orderStatus"), x["leg"].alias("legName"), x["side"].alias("transactionType"),
            x["qty"].alias("quantity"), x["price"].alias("price"), x["trigger_price"].alias("triggerPrice"),
        ),
    )
    path = scratch_path(spark, "orders")
    o.select(
        F.col("order_id").alias("orderId"), F.col("status").alias("orderStatus"), F.col("symbol").alias("tradingSymbol"),
        F.col("side").alias("transactionType"), F.col("qty").alias("quantity"), "price",
        F.col("trigger_price").alias("triggerPrice"), leg.alias("legDetails"),
    ).write.json(path)
    return R.read_orders(spark, path).select(
        "order_id", "status", "side", "qty", "price", "trigger_price", F.coalesce(F.size("legs"), F.lit(0)).alias("n_legs")
    ).withColumn("n_legs", F.greatest("n_legs", F.lit(0)))


@query("saved_bars", f"WITH {A.BARS_SQL}, {surge_sql()} SELECT {COLS} FROM scan", 2)
def saved_bars(spark, d):
    """Bars are stored, read back and scanned: a restart resumes from the table."""
    path = scratch_path(spark, "store")
    W.write_bars(A.base_bars(spark, d), path, "3")
    return G.surge_scan(W.read_bars(spark, path, "3"))


@query(
    "bucketed_watch_list",
    SCAN
    + """, b AS (SELECT CAST((floor(ltp / 100) + 1) * 100 AS BIGINT) AS below, symbol FROM scan)
    SELECT symbol AS line FROM b UNION ALL SELECT DISTINCT '# Less than ' || below FROM b UNION ALL SELECT '# Timeframe: 3'""",
)
def bucketed_watch_list(spark, d):
    buckets = G.price_buckets(G.surge_scan(A.base_bars(spark, d)), 100)
    path = scratch_path(spark, "watch")
    W.write_lines(W.bucketed_lines(buckets, "Timeframe: 3"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))
