"""Positions and orders to profit and loss and one order book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import constants as K
from tickloom.functions import scalar as X
from tickloom.functions.ranking import range_numbers
from tickloom.operators import instruments as N
from tickloom.operators import tickets as T


def aggregate_positions(pos: DataFrame) -> DataFrame:
    """One row per security from position rows in ``seq`` order.

    The first row names the position; the product is that of the last row with a net
    quantity, else of the first row. Sums combine map-side; the few descriptive fields
    come from the first and the last open row, found by their sequence numbers.
    """
    rows = pos.filter(F.coalesce("trading_symbol", F.lit("")) != "")
    mult = F.col("multiplier")
    sums = rows.groupBy("security_id").agg(
        F.sum("realized").alias("realized"),
        F.sum(F.col("unrealized") * mult).alias("unrealized"),
        F.sum("net_qty").alias("net_qty"),
        F.sum("buy_qty").alias("buy_qty"),
        F.sum("sell_qty").alias("sell_qty"),
        F.sum(F.col("buy_avg") * F.col("buy_qty")).alias("buy_value"),
        F.sum(F.col("sell_avg") * F.col("sell_qty")).alias("sell_value"),
        F.min("seq").alias("first_seq"),
        F.max(F.when(F.col("net_qty") != 0, F.col("seq"))).alias("open_seq"),
    )
    sums = sums.withColumn("product_seq", F.coalesce("open_seq", "first_seq"))
    head = rows.select(
        F.col("seq").alias("first_seq"), "security_id", "trading_symbol", "exchange_seg", "multiplier"
    )
    product = rows.select(F.col("seq").alias("product_seq"), "security_id", "product")
    return (
        sums.join(head, ["security_id", "first_seq"])
        .join(product, ["security_id", "product_seq"])
        .drop("first_seq", "open_seq", "product_seq")
    )


def position_report(agg: DataFrame) -> DataFrame:
    """Active and closed positions with profit, entry price and implied last price."""

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    net, mult = F.col("net_qty"), F.col("multiplier")
    buy_avg, sell_avg = ratio("buy_value", "buy_qty"), ratio("sell_value", "sell_qty")
    active = net != 0
    entry = F.when(net > 0, buy_avg).when(net < 0, sell_avg).otherwise(0.0)
    # Long: entry + u/(n*m); short: entry - u/(|n|*m). Both are entry + u/(n*m).
    ltp = F.when(active, entry + F.col("unrealized") / F.nullif(net * mult, F.lit(0.0))).otherwise(0.0)
    traded = (F.col("buy_qty") > 0) | (F.col("sell_qty") > 0)
    return agg.filter(active | traded).select(
        "security_id",
        "trading_symbol",
        "exchange_seg",
        "product",
        F.when(active, "active").otherwise("closed").alias("status"),
        (net * mult).alias("qty"),
        "buy_qty",
        "sell_qty",
        F.when(active, F.col("unrealized") + F.col("realized")).otherwise(F.col("realized")).alias("pnl"),
        entry.alias("entry_price"),
        ltp.alias("ltp"),
        F.when(active, 0.0).otherwise(buy_avg).alias("buy_avg"),
        F.when(active, 0.0).otherwise(sell_avg).alias("sell_avg"),
    )


def with_instruments(report: DataFrame, master: DataFrame) -> DataFrame:
    """Positions with their instrument: display_name, base_symbol, exchange, family, strike, opt_type, expiry.

    An unknown security is called by its trading symbol and has an empty family, option type and expiry.
    """
    info = N.instrument_details(master).select(
        "security_id", F.col("display").alias("_d"), F.col("symbol").alias("_s"), "inst",
        F.col("strike").alias("_k"), F.col("opt_type").alias("_o"), F.col("expiry").alias("_e"),
    )
    return report.join(info, "security_id", "left").withColumns(
        {
            "display_name": F.coalesce("_d", "trading_symbol"),
            "base_symbol": F.coalesce("_s", "trading_symbol"),
            "exchange": F.substring_index("exchange_seg", "_", 1),
            "family": N.instrument_family(F.coalesce("inst", F.lit(""))),
            "strike": F.coalesce("_k", F.lit(0.0)),
            "opt_type": F.coalesce("_o", F.lit("")),
            "expiry": F.coalesce("_e", F.lit("")),
        }
    ).drop("_d", "_s", "_k", "_o", "_e", "inst")


def pnl_totals(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"))


def is_pending(status: Column) -> Column:
    return status.isin(*K.PENDING_STATUSES)


def pending_orders(orders: DataFrame) -> DataFrame:
    return orders.filter(is_pending(F.col("status"))).select(
        "order_id", "symbol", F.coalesce("order_type", F.lit("MARKET")).alias("type"), "side", "qty", "price", "trigger_price"
    )


def explode_legs(orders: DataFrame) -> DataFrame:
    """Pending header and pending legs of super orders; legs default to the header's fields."""
    header = F.struct(
        F.col("status").alias("status"),
        F.lit("ENTRY_LEG").alias("leg"),
        F.col("side").alias("side"),
        F.col("qty").alias("qty"),
        F.col("price").alias("price"),
        F.col("trigger_price").alias("trigger_price"),
    )
    legs = F.transform(
        F.coalesce("legs", F.array().cast("array<struct<status:string,leg:string,side:string,qty:int,price:double,trigger_price:double>>")),
        lambda x: F.struct(
            x["status"].alias("status"),
            F.coalesce(x["leg"], F.lit("")).alias("leg"),
            F.coalesce(x["side"], F.col("side")).alias("side"),
            F.coalesce(x["qty"], F.col("qty")).alias("qty"),
            F.coalesce(x["price"], F.col("price")).alias("price"),
            F.coalesce(x["trigger_price"], F.col("trigger_price")).alias("trigger_price"),
        ),
    )
    rows = orders.select("symbol", "order_id", F.inline(F.concat(F.array(header), legs)))
    return rows.filter(is_pending(F.col("status"))).drop("status").distinct()


def alert_orders(alerts: DataFrame, master: DataFrame | None = None) -> DataFrame:
    """Pending conditional alerts with the fields of their first order and of their condition.

    Named by the display name of the security that they order, where ``master`` knows it.
    """
    first = F.get("orders", 0)
    rows = alerts.filter(is_pending(F.col("status"))).select(
        F.coalesce(first["security_id"], F.lit("")).alias("security_id"),
        F.col("alert_id").alias("order_id"),
        F.coalesce(first["side"], F.lit("")).alias("side"),
        F.coalesce(first["qty"], F.lit(0)).alias("qty"),
        F.coalesce(first["price"], F.lit(0.0)).alias("price"),
        F.coalesce("condition.value", F.lit(0.0)).alias("trigger_price"),
        F.coalesce("condition.note", F.lit("")).alias("note"),
        F.coalesce("condition.expires", F.lit("")).alias("expires"),
    )
    fallback = F.concat(F.lit("Trig: "), F.col("security_id"))
    if master is None:
        return rows.withColumn("symbol", fallback)
    info = N.instrument_details(master).select("security_id", F.col("display").alias("_d"))
    return rows.join(info, "security_id", "left").withColumn("symbol", F.coalesce("_d", fallback)).drop("_d")


def order_book(pending: DataFrame, legs: DataFrame, forever: DataFrame, alerts: DataFrame) -> DataFrame:
    """The four kinds of open orders in one shape."""

    def shape(df: DataFrame, kind: Column, leg: Column, tail: Column | None = None) -> DataFrame:
        detail = X.order_detail(F.col("qty"), F.col("trigger_price"), F.col("price"))
        if tail is not None:
            detail = F.concat(detail, tail)
        return df.select("symbol", "order_id", leg.alias("leg"), kind.alias("type"), "side", detail.alias("detail"))

    named = (F.col("leg") != "") & (F.col("leg") != "ENTRY_LEG")
    tail = F.when(named, F.concat(F.lit(" ("), F.col("leg"), F.lit(")"))).otherwise("")
    none = F.lit("")
    return (
        shape(pending, F.col("type"), none)
        .unionByName(shape(legs, F.lit("SUPER"), F.col("leg"), tail))
        .unionByName(shape(forever, F.lit("FOREVER"), F.coalesce("leg", F.lit("TARGET_LEG"))))
        .unionByName(shape(alerts, F.lit("ALERT"), none))
    )


def orphan_orders(legs: DataFrame, report: DataFrame, name: str = "trading_symbol") -> DataFrame:
    """Pending legs of symbols without an active position."""
    active = report.filter("status = 'active'").select(F.col(name).alias("symbol"))
    return legs.join(active, "symbol", "left_anti")


def close_tickets(report: DataFrame, cfg: dict | None = None) -> DataFrame:
    """The order that flattens each active position."""
    rows = report.filter("status = 'active'").withColumn(
        "side", F.when(F.col("qty") > 0, "SELL").otherwise("BUY")
    )
    rows = T.price_levels(rows, "ltp", "side", cfg=cfg)
    priced = F.col("ltp") > 0
    return rows.select(
        "security_id",
        "exchange_seg",
        "product",
        "side",
        F.abs("qty").alias("quantity"),
        F.when(priced, F.col("limit")).alias("price"),
        F.when(priced, "LIMIT").otherwise("MARKET").alias("order_type"),
    )


def live_payload(report: DataFrame) -> DataFrame:
    """(key, payload) rows, keyed active_<id> or closed_<id>: one row per position."""
    body = F.to_json(F.struct("pnl", "qty", "trading_symbol", "exchange_seg", "buy_qty", "sell_qty", "status"))
    return report.filter("security_id <> ''").select(
        F.concat_ws("_", "status", "security_id").alias("key"), body.alias("payload")
    )


def live_payload_maps(report: DataFrame, most: int) -> DataFrame:
    """The payload as maps of at most ``most`` keys each: (part, payload), keys in order.

    There are more maps where there are more positions, so none of them grows.
    """
    rows = range_numbers(live_payload(report).withColumn("_all", F.lit(0)), "_all", [F.col("key")], "_nth")
    return rows.groupBy(F.floor((F.col("_nth") - 1) / most).alias("part")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "payload")))).alias("payload")
    )


