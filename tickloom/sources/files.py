"""Readers for snapshot directories, lists, calendars, masters and broker JSON.

Schemas are explicit everywhere; headers are checked against them, not inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import constants as K
from tickloom.functions import scalar as X

SNAPSHOT_SCHEMA = "symbol STRING, vol_cum STRING, vol_val_cum STRING, price STRING"
SNAPSHOT_PATH = r"(\d{8})/[^/]*_(\d{4})\.csv$"

MASTER_SCHEMA = (
    "EXCH_ID STRING, INSTRUMENT STRING, INSTRUMENT_TYPE STRING, UNDERLYING_SYMBOL STRING, "
    "DISPLAY_NAME STRING, SECURITY_ID STRING, UNDERLYING_SECURITY_ID STRING, LOT_SIZE INT, "
    "SM_EXPIRY_DATE STRING, STRIKE_PRICE DOUBLE, OPTION_TYPE STRING"
)
POSITION_SCHEMA = (
    "securityId STRING, tradingSymbol STRING, exchangeSegment STRING, productType STRING, "
    "multiplier DOUBLE, realizedProfit DOUBLE, unrealizedProfit DOUBLE, buyAvg DOUBLE, "
    "sellAvg DOUBLE, netQty INT, buyQty INT, sellQty INT"
)
ORDER_SCHEMA = (
    "orderId STRING, orderStatus STRING, securityId STRING, tradingSymbol STRING, orderType STRING, "
    "transactionType STRING, legName STRING, quantity INT, price DOUBLE, triggerPrice DOUBLE, "
    "legDetails ARRAY<STRUCT<orderStatus: STRING, legName: STRING, transactionType: STRING, "
    "quantity: INT, price: DOUBLE, triggerPrice: DOUBLE>>"
)
ALERT_SCHEMA = (
    "alertId STRING, alertStatus STRING, "
    "condition STRUCT<userNote: STRING, comparingValue: DOUBLE, expDate: STRING>, "
    "orders ARRAY<STRUCT<securityId: STRING, quantity: INT, price: DOUBLE, transactionType: STRING>>"
)


def path_time(path: Column, pattern: str = SNAPSHOT_PATH) -> Column:
    """Snapshot time from ``ddMMyyyy/name_HHMM.csv``; NULL when the path has none."""
    text = F.concat(F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2))
    return F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("ddMMyyyyHHmm")).cast("timestamp_ntz")


def snapshot_manifest(
    spark: SparkSession, root: str, last_n_days: int | None = None, pattern: str = SNAPSHOT_PATH
) -> DataFrame:
    """(path, snap_ts, day) of the in-session snapshot files, header-only ones included.

    Lists files only: the content column is never read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(root)
        .select("path", path_time(F.col("path"), pattern).alias("snap_ts"))
    )
    files = files.filter(X.in_session(F.col("snap_ts"))).withColumn("day", F.to_date("snap_ts"))
    if last_n_days is None:
        return files
    newest = files.select("day").distinct().orderBy(F.desc("day")).limit(last_n_days)
    return files.join(newest, "day", "left_semi").select("path", "snap_ts", "day")


def broken_rows(raw: DataFrame, pattern: str = SNAPSHOT_PATH, path: Column | None = None) -> DataFrame:
    """(path, reason, n): rows that no snapshot is made of, or not a whole one, by file and reason."""
    path = F.col("_metadata.file_path") if path is None else path
    short = F.col("symbol").isNull() | F.col("price").isNull()
    numbers = F.col("vol_cum").try_cast("double").isNull() | F.col("price").try_cast("double").isNull()
    reason = F.when(path_time(path, pattern).isNull(), "no time in the name").when(short, "short row").when(numbers, "not a number")
    rows = raw.select(path.alias("path"), reason.alias("reason")).filter("reason IS NOT NULL")
    return rows.groupBy("path", "reason").agg(F.count("*").alias("n"))


def _clean(raw: DataFrame, pattern: str, path: Column | None = None) -> DataFrame:
    """Short rows go; each number is parsed on its own, so one bad value keeps the other."""
    path = F.col("_metadata.file_path") if path is None else path
    unquoted = F.trim(F.regexp_replace("symbol", "[\"']", ""))
    return X.rename_symbols(
        raw.filter("symbol IS NOT NULL AND price IS NOT NULL").select(
            unquoted.alias("symbol"),
            path_time(path, pattern).alias("snap_ts"),
            F.col("vol_cum").try_cast("double").alias("vol_cum"),
            F.col("price").try_cast("double").alias("price"),
        )
    ).filter(X.in_session(F.col("snap_ts")))


def read_snapshots(
    spark: SparkSession, root: str, last_n_days: int | None = None, pattern: str = SNAPSHOT_PATH
) -> DataFrame:
    """Snapshots (symbol, snap_ts, vol_cum, price). Only the wanted days are opened.

    The list of day folders (at most ``last_n_days``) is the one thing the driver reads.
    """
    paths = [root]
    if last_n_days is not None:
        days = snapshot_manifest(spark, root, last_n_days, pattern).select("day").distinct()
        paths = [f"{root}/{r.day:%d%m%Y}" for r in days.collect()]
    raw = (
        spark.read.schema(SNAPSHOT_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(paths)
    )
    return _clean(raw, pattern)


def unknown_symbols(snaps: DataFrame, universe: DataFrame) -> DataFrame:
    return snaps.select("symbol").join(universe, "symbol", "left_anti").distinct()


def normalise_exchange(df: DataFrame, column_map: dict[str, str], money: str = "vol_val_cum") -> DataFrame:
    """Raw export columns to ours (``{raw: ours}``); incomplete rows go, money as 2-decimal text."""
    out = df.select(*[F.col(f"`{raw}`").alias(ours) for raw, ours in column_map.items()])
    out = out.dropna(subset=list(column_map.values()))
    if money in out.columns:
        plain = F.regexp_replace(F.col(money).cast("string"), ",", "").try_cast("double")
        out = out.withColumn(money, F.format_string("%.2f", plain))
    return out


def parse_holidays(json_df: DataFrame, col: str = "value") -> DataFrame:
    """One JSON array of {Date: dd-MMM-yyyy} per row to (day, name)."""
    kind = "array<struct<`Sr No.`: string, Date: string, Holiday: string>>"
    rows = json_df.select(F.explode(F.from_json(col, kind)).alias("h"))
    day = F.to_date(F.try_to_timestamp(F.col("h.Date"), F.lit("dd-MMM-yyyy")))
    return rows.select(day.alias("day"), F.col("h.Holiday").alias("name"))


def exclude_holidays(df: DataFrame, calendar: DataFrame, day: str = "day") -> DataFrame:
    return df.join(calendar.select(F.col("day").alias(day)), day, "left_anti")


def parse_constituents(json_df: DataFrame, col: str = "value") -> DataFrame:
    """Index JSON ({data: [{symbol}, ...]}) to symbols; the first element is the index itself."""
    data = F.from_json(col, "struct<data: array<struct<symbol: string>>>")["data"]
    keep = [c for c in json_df.columns if c != col]
    rows = json_df.select(*keep, F.explode(F.slice(data, 2, F.greatest(F.size(data), F.lit(1)))).alias("d"))
    symbol = F.upper(F.trim("d.symbol"))
    return rows.select(*keep, symbol.alias("symbol")).filter("symbol <> ''")


def unpivot_sectors(wide: DataFrame) -> DataFrame:
    """One column per sector to (sector, symbol); pads go."""
    long = wide.unpivot([], wide.columns, "sector", "symbol")
    return long.select("sector", F.trim("symbol").alias("symbol")).filter("symbol <> ''")


def read_sector_map(spark: SparkSession, path: str) -> DataFrame:
    return unpivot_sectors(spark.read.option("header", True).csv(path))


def read_symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """One symbol per line; blanks and # comments go."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("symbol")).filter("symbol <> '' AND symbol NOT LIKE '#%'")


def read_instruments(
    spark: SparkSession,
    paths: list[str],
    exchanges: list[str] = K.MASTER_EXCHANGES,
    segments: list[str] = K.MASTER_SEGMENTS,
    types: list[str] = K.MASTER_TYPES,
) -> DataFrame:
    """Segment files of the instrument master in our names, wanted rows only.

    ``load_pos`` orders rows as read: by file in the given order, then by line.
    """
    parts = None
    for i, path in enumerate(paths):
        raw = spark.read.schema(MASTER_SCHEMA).option("header", True).option("enforceSchema", False).csv(path)
        part = raw.withColumn("load_pos", F.lit(i).cast("long") * (1 << 50) + F.monotonically_increasing_id())
        parts = part if parts is None else parts.unionByName(part)
    kept = parts.filter(
        F.col("EXCH_ID").isin(exchanges)
        & F.col("INSTRUMENT").isin(segments)
        & F.col("INSTRUMENT_TYPE").isin(types)
    )
    return kept.select(
        "load_pos",
        F.col("EXCH_ID").alias("exch"),
        F.col("INSTRUMENT").alias("inst"),
        F.col("UNDERLYING_SYMBOL").alias("symbol"),
        F.col("DISPLAY_NAME").alias("display_raw"),
        F.col("SECURITY_ID").alias("security_id"),
        F.col("LOT_SIZE").alias("lot"),
        F.coalesce("SM_EXPIRY_DATE", F.lit("")).alias("expiry"),
        F.coalesce("STRIKE_PRICE", F.lit(0.0)).alias("strike"),
        F.coalesce("OPTION_TYPE", F.lit("")).alias("opt_type"),
    )


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(POSITION_SCHEMA).json(path)

    def zero(c: str) -> Column:
        return F.coalesce(c, F.lit(0))

    return raw.select(
        F.monotonically_increasing_id().alias("seq"),
        F.coalesce("securityId", F.lit("")).alias("security_id"),
        F.col("tradingSymbol").alias("trading_symbol"),
        F.coalesce("exchangeSegment", F.lit("NSE_EQ")).alias("exchange_seg"),
        F.coalesce("productType", F.lit("INTRADAY")).alias("product"),
        F.coalesce("multiplier", F.lit(1.0)).alias("multiplier"),
        zero("realizedProfit").alias("realized"),
        zero("unrealizedProfit").alias("unrealized"),
        zero("netQty").alias("net_qty"),
        zero("buyQty").alias("buy_qty"),
        zero("sellQty").alias("sell_qty"),
        zero("buyAvg").alias("buy_avg"),
        zero("sellAvg").alias("sell_avg"),
    )


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """Plain, super and forever orders share one shape; ``legs`` is NULL for plain ones."""
    raw = spark.read.schema(ORDER_SCHEMA).json(path)
    legs = F.transform(
        "legDetails",
        lambda x: F.struct(
            x["orderStatus"].alias("status"),
            x["legName"].alias("leg"),
            x["transactionType"].alias("side"),
            x["quantity"].alias("qty"),
            x["price"].alias("price"),
            x["triggerPrice"].alias("trigger_price"),
        ),
    )
    return raw.select(
        F.col("tradingSymbol").alias("symbol"),
        F.col("orderId").alias("order_id"),
        F.col("orderStatus").alias("status"),
        F.col("securityId").alias("security_id"),
        F.coalesce("transactionType", F.lit("")).alias("side"),
        F.coalesce("quantity", F.lit(0)).alias("qty"),
        F.coalesce("price", F.lit(0.0)).alias("price"),
        F.coalesce("triggerPrice", F.lit(0.0)).alias("trigger_price"),
        F.col("orderType").alias("order_type"),
        F.col("legName").alias("leg"),
        legs.alias("legs"),
    )


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(ALERT_SCHEMA).json(path)
    orders = F.transform(
        "orders",
        lambda x: F.struct(
            x["securityId"].alias("security_id"),
            x["transactionType"].alias("side"),
            x["quantity"].alias("qty"),
            x["price"].alias("price"),
        ),
    )
    return raw.select(
        F.col("alertId").alias("alert_id"),
        F.col("alertStatus").alias("status"),
        F.struct(
            F.col("condition.userNote").alias("note"),
            F.col("condition.comparingValue").alias("value"),
            F.col("condition.expDate").alias("expires"),
        ).alias("condition"),
        orders.alias("orders"),
    )
