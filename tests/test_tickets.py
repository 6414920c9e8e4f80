"""Ticket rules, instrument fields of positions and alerts, worked by hand."""

from pyspark.sql import functions as F

from tickloom.operators import portfolio as P
from tickloom.operators import tickets as T

SCHEMA = (
    "ticket_id INT, route STRING, family STRING, entry DOUBLE, limit DOUBLE, stop DOUBLE, target DOUBLE, trail DOUBLE, "
    "given_limit DOUBLE, given_stop DOUBLE, given_target DOUBLE, given_trigger DOUBLE, given_product STRING"
)


def test_rules_take_the_first_source_with_a_value(spark):
    levels = (100.0, 101.0, 99.0, 104.0, 1.0)
    rows = [
        (1, "SUPER", "cash", *levels, 0.0, 0.0, 0.0, 7.0, "CNC"),
        (2, "SUPER", "derivative", *levels, 90.0, 91.0, 92.0, 0.0, "MARGIN"),
        (3, "FOREVER", "derivative", *levels, 0.0, 5.0, 5.0, 0.0, "CNC"),
        (4, "FOREVER", "cash", *levels, 90.0, 0.0, 0.0, 95.0, "INTRADAY"),
        (5, "SIMPLE", "derivative", *levels, 90.0, 1.0, 1.0, 95.0, "CNC"),
        (6, "SIMPLE", "cash", *levels, 0.0, 0.0, 0.0, 0.0, "CNC"),
        (7, "SIMPLE", "derivative", *levels, None, None, None, 95.0, "INTRADAY"),
        (8, "ALERT", "cash", *levels, 90.0, 90.0, 90.0, 90.0, "INTRADAY"),
        (9, "OTHER", "cash", *levels, 90.0, 90.0, 90.0, 90.0, "INTRADAY"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = T.apply_rules(df, T.rule_table(spark)).orderBy("ticket_id").select(*T.WORDS, *T.NUMBERS).collect()
    assert [tuple(r) for r in out] == [
        ("LIMIT", "CNC", 101, 0, 99, 104, 1),
        ("LIMIT", "MARGIN", 90, 0, 91, 92, 1),
        ("LIMIT", "MARGIN", 101, 100, 0, 0, 0),
        ("LIMIT", "CNC", 90, 95, 0, 0, 0),
        ("STOP_LOSS", "MARGIN", 90, 95, 0, 0, 0),
        ("MARKET", "CNC", 0, 0, 0, 0, 0),
        ("STOP_LOSS_MARKET", "INTRADAY", 0, 95, 0, 0, 0),
        (None, "INTRADAY", 0, 100, 0, 0, 0),
        (None, None, 0, 0, 0, 0, 0),
    ]


def test_alerts_on_an_unlisted_underlying_go(spark):
    rows = [(1, "NSE", "A", "UNDERLYING_ALERT", "EQUITY"), (2, "NSE", "B", "UNDERLYING_ALERT", "EQUITY"), (3, "NSE", "B", "ALERT", None), (4, "NSE", "A", "UNDERLYING_ALERT", "FUTCOM")]
    t = spark.createDataFrame(rows, "ticket_id INT, exch STRING, symbol STRING, route STRING, underlying_seg STRING")
    cash = spark.createDataFrame([("NSE", "A", "77", 1)], "exch STRING, symbol STRING, security_id STRING, lot INT")
    out = {r.ticket_id: r.underlying_id for r in T._with_underlying(t, cash).collect()}
    assert out == {1: "77", 3: None}


MASTER = "security_id STRING, load_pos LONG, display STRING, symbol STRING, exch STRING, inst STRING, expiry STRING, strike DOUBLE, opt_type STRING"


def test_positions_and_alerts_take_the_last_instrument_but_no_later_index(spark):
    rows = [
        ("1", 1, "A one", "A", "NSE", "EQUITY", "", 0.0, ""),
        ("1", 2, "A CE 5", "A", "NSE", "OPTSTK", "2024-03-28", 5.0, "CE"),
        ("1", 3, "index A", "A", "NSE", "INDEX", "", 0.0, ""),
        ("2", 4, "index B", "B", "NSE", "INDEX", "", 0.0, ""),
        ("3", 5, "C fut", "C", "MCX", "FUTCOM", "2024-03-28", 0.0, ""),
    ]
    master = spark.createDataFrame(rows, MASTER)
    rep = spark.createDataFrame([(str(k), f"T{k}", "NSE_FNO") for k in range(1, 5)], "security_id STRING, trading_symbol STRING, exchange_seg STRING")
    got = {r.security_id: (r.display_name, r.base_symbol, r.exchange, r.family, r.strike, r.opt_type, r.expiry) for r in P.with_instruments(rep, master).collect()}
    assert got == {
        "1": ("A CE 5", "A", "NSE", "OPT", 5.0, "CE", "2024-03-28"),
        "2": ("index B", "B", "NSE", "EQ", 0.0, "", ""),
        "3": ("C fut", "C", "NSE", "FUT", 0.0, "", "2024-03-28"),
        "4": ("T4", "T4", "NSE", "", 0.0, "", ""),
    }
    order = "ARRAY<STRUCT<security_id: STRING, side: STRING, qty: INT, price: DOUBLE>>"
    alerts = spark.createDataFrame(
        [("x", "ACTIVE", ("n", 9.0, None), [("3", "BUY", 2, 5.0)]), ("y", "PENDING", None, []), ("z", "TRADED", None, None), ("w", "TRANSIT", None, [("9", None, None, None)])],
        f"alert_id STRING, status STRING, condition STRUCT<note: STRING, value: DOUBLE, expires: STRING>, orders {order}",
    )
    got = {r.order_id: (r.symbol, r.side, r.qty, r.price, r.trigger_price, r.note) for r in P.alert_orders(alerts, master).collect()}
    assert got == {"x": ("C fut", "BUY", 2, 5.0, 9.0, "n"), "y": ("Trig: ", "", 0, 0.0, 0.0, ""), "w": ("Trig: 9", "", 0, 0.0, 0.0, "")}


def test_payload_maps_stay_small(spark):
    rows = spark.range(100).select(
        F.col("id").cast("string").alias("security_id"), F.lit("active").alias("status"), F.lit(1.0).alias("pnl"), F.lit(1).alias("qty"),
        F.lit("t").alias("trading_symbol"), F.lit("e").alias("exchange_seg"), F.lit(1).alias("buy_qty"), F.lit(0).alias("sell_qty"),
    )
    sizes = sorted(len(r.payload) for r in P.live_payload_maps(rows, 16).collect())
    assert sizes == [4] + [16] * 6
