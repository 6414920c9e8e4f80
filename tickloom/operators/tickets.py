"""Order tickets as plain tables: ladders, quantities, segments, routes. Nothing is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import constants as K
from tickloom.functions import scalar as X
from tickloom.operators import instruments as N


def adjust_price(base: Column, percent: float, signal: Column, bump: Column) -> Column:
    """Up and rounded up for BUY, down and rounded down for SELL; 0 percent gives 0."""
    if percent == 0:
        return F.lit(0.0)
    p = F.when(bump, K.OPTION_BUMP * percent).otherwise(percent)
    up, down = F.ceil(base * (1 + p / 100)), F.floor(base * (1 - p / 100))
    return F.when(signal == "BUY", up).otherwise(down).cast("double")


def price_levels(
    df: DataFrame, price: str = "price", signal: str = "signal", bump: Column | None = None, cfg: dict | None = None
) -> DataFrame:
    """Entry, limit, stop, stop limit, target and trail from a raw price."""
    cfg = {**K.LADDER, **(cfg or {})}
    bump = F.lit(False) if bump is None else bump
    sig = F.col(signal)
    inv = X.invert_side(sig)
    df = df.withColumn("entry", adjust_price(F.col(price), cfg["entry"], sig, bump))
    df = df.withColumns(
        {
            "limit": adjust_price(F.col("entry"), cfg["limit"], sig, bump),
            "stop": adjust_price(F.col("entry"), cfg["stop"], inv, bump),
            "target": adjust_price(F.col("entry"), cfg["target"], sig, bump),
        }
    )
    trail = cfg["trail"] * F.when(bump, K.OPTION_BUMP).otherwise(1)
    return df.withColumns(
        {
            "stop_limit": adjust_price(F.col("stop"), cfg["limit"], inv, bump),
            "trail": F.ceil(F.col("entry") * trail / 100).cast("double") if cfg["trail"] > 0 else F.lit(0.0),
        }
    )


def order_quantity(amount: Column, price: Column, lot: Column, base: Column) -> Column:
    lots = F.ceil(amount / (price * lot))
    return F.when((amount > 0) & (price > 0), lots * lot).otherwise(base * lot).cast("long")


def segment(exch: Column, mode: Column, is_index: Column) -> Column:
    """Order segment, '' when the mode is not traded, NULL for other exchanges."""
    nse = F.when(
        is_index, F.when(mode == "OPT", "OPTIDX").when(mode == "FUT", "FUTIDX").otherwise("")
    ).otherwise(
        F.when(mode == "EQ", "EQUITY").when(mode == "OPT", "OPTSTK").when(mode == "FUT", "FUTSTK").otherwise("")
    )
    mcx = F.when(mode == "OPT", "OPTFUT").when(mode == "FUT", "FUTCOM").otherwise("")
    return F.when(exch == "NSE", nse).when(exch == "MCX", mcx)


def exchange_segment(exch: Column, seg: Column) -> Column:
    suffix = F.coalesce(X.lookup(K.SEGMENT_SUFFIX, seg), F.lit(""))
    return F.when(seg == "INDEX", "IDX_I").otherwise(F.concat(exch, F.lit("_"), suffix))


def contract_name(symbol: Column, seg: Column, strike: Column, opt_type: Column, expiry: Column) -> Column:
    return (
        F.when(
            seg.isin(*K.OPTION_SEGMENTS), F.concat_ws(" ", symbol, strike.cast("string"), opt_type, expiry)
        )
        .when(seg.isin(*K.FUTURE_SEGMENTS), F.concat_ws(" ", symbol, F.lit("Fut"), expiry))
        .otherwise(F.concat_ws(" ", symbol, seg))
    )


def classify_order(df: DataFrame) -> DataFrame:
    """Add seg, exchange_seg, contract and order_type to (exch, mode, is_index, symbol, ...)."""
    df = df.withColumn("seg", segment(F.col("exch"), F.col("mode"), F.col("is_index")))
    return df.withColumns(
        {
            "exchange_seg": exchange_segment(F.col("exch"), F.col("seg")),
            "contract": contract_name(*[F.col(c) for c in ("symbol", "seg", "strike", "opt_type", "expiry")]),
            "order_type": X.order_type(F.col("trigger_price"), F.col("limit_price")),
        }
    )


def option_params(df: DataFrame, **tables) -> DataFrame:
    """Option type, final side and strike for mode OPT.

    Columns: mode, signal, symbol, entry, and the overrides o_opt_type, o_strike and
    the settings call_strike, put_strike, any_strike (NULL when not set).
    """
    is_opt = F.col("mode") == "OPT"
    sig = F.col("signal")
    given = F.coalesce("o_opt_type", F.lit("")) != ""
    step = N.strike_interval(F.col("symbol"), F.col("entry"), **tables)
    computed = F.when(sig == "BUY", F.floor(F.col("entry") / step)).otherwise(F.ceil(F.col("entry") / step)) * step
    side_strike = F.when(sig == "BUY", F.col("call_strike")).otherwise(F.col("put_strike"))

    def unless_zero(c: Column) -> Column:
        return F.when(c != 0, c)

    strike = F.when(F.col("o_strike") > 0, F.col("o_strike")).otherwise(
        F.coalesce(unless_zero(side_strike), unless_zero(F.col("any_strike")), computed.cast("double"))
    )
    opt = F.when(given, F.col("o_opt_type")).otherwise(F.when(sig == "BUY", "CE").otherwise("PE"))
    return df.withColumns(
        {
            "opt_type": F.when(is_opt, opt),
            "strike": F.when(is_opt, strike),
            "final_signal": F.when(is_opt & ~given, "BUY").otherwise(sig),
        }
    )


def route_order(mode: str, exch: Column, seg: Column) -> Column:
    """Kind of order an instrument gets under a placing mode."""
    is_opt, is_fut = seg.isin(*K.OPTION_SEGMENTS), seg.isin(*K.FUTURE_SEGMENTS)
    if mode == "ALERT":
        by_mode = F.when((is_opt | is_fut) & (exch != "MCX"), "UNDERLYING_ALERT").otherwise("ALERT")
    elif mode == "FOREVER":
        by_mode = F.when(is_opt, "SIMPLE").when(is_fut, "FOREVER").otherwise("SUPER")
    elif mode == "SUPER":
        by_mode = F.when(is_opt, "SIMPLE").otherwise("SUPER")
    else:
        by_mode = F.lit("SIMPLE")
    return F.when(is_opt & (exch == "MCX"), "SIMPLE").otherwise(by_mode)


#: Where each field of a ticket comes from: route, family (derivative, cash or any), field, priority, source.
#: Of the sources that have a value the one of the lowest priority counts. Quoted sources are words.
RULES = [
    ("SUPER", "any", "order_type", 1, "'LIMIT'"),
    ("SUPER", "any", "product", 1, "given_product"),
    ("SUPER", "any", "price", 1, "given_limit"),
    ("SUPER", "any", "price", 2, "limit"),
    ("SUPER", "any", "stop_price", 1, "given_stop"),
    ("SUPER", "any", "stop_price", 2, "stop"),
    ("SUPER", "any", "target_price", 1, "given_target"),
    ("SUPER", "any", "target_price", 2, "target"),
    ("SUPER", "any", "trail_jump", 1, "trail"),
    ("FOREVER", "any", "order_type", 1, "'LIMIT'"),
    ("FOREVER", "derivative", "product", 1, "'MARGIN'"),
    ("FOREVER", "cash", "product", 1, "'CNC'"),
    ("FOREVER", "any", "trigger_price", 1, "given_trigger"),
    ("FOREVER", "any", "trigger_price", 2, "entry"),
    ("FOREVER", "any", "price", 1, "given_limit"),
    ("FOREVER", "any", "price", 2, "limit"),
    ("SIMPLE", "any", "order_type", 1, "priced_type"),
    ("SIMPLE", "derivative", "product", 1, "margin_for_delivery"),
    ("SIMPLE", "any", "product", 2, "given_product"),
    ("SIMPLE", "any", "price", 1, "given_limit"),
    ("SIMPLE", "any", "trigger_price", 1, "given_trigger"),
    ("ALERT", "any", "product", 1, "given_product"),
    ("ALERT", "any", "trigger_price", 1, "entry"),
    ("UNDERLYING_ALERT", "any", "product", 1, "given_product"),
    ("UNDERLYING_ALERT", "any", "trigger_price", 1, "entry"),
]
NUMBERS, WORDS = ("price", "trigger_price", "stop_price", "target_price", "trail_jump"), ("order_type", "product")
GIVEN = ("given_limit", "given_stop", "given_target", "given_trigger")


def rule_table(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    """(route, family, rules): one row per kind of order and family, with its rules as an array."""
    rows = spark.createDataFrame(rules, "route STRING, family STRING, field STRING, priority INT, source STRING")
    either = F.explode(F.when(F.col("family") == "any", F.array(F.lit("derivative"), F.lit("cash"))).otherwise(F.array("family")))
    return rows.withColumn("family", either).groupBy("route", "family").agg(F.collect_list(F.struct("field", "priority", "source")).alias("rules"))


def apply_rules(df: DataFrame, table: DataFrame) -> DataFrame:
    """Resolve each field by its first rule whose source has a value; numbers without one are 0, words null.

    Tickets meet the rules by one join on (route, family); the least (priority, value) of a field is its value.
    """
    positive = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double"))
    number_of = {r[4]: positive(r[4]) for r in RULES if r[2] in NUMBERS}
    fixed = {r[4]: F.lit(r[4].strip("'")) for r in RULES if r[4].startswith("'")}
    margin = F.when(F.col("given_product") == "CNC", "MARGIN")
    word_of = fixed | {"given_product": F.col("given_product"), "margin_for_delivery": margin}
    word_of["priced_type"] = X.order_type(F.col("given_trigger"), F.col("given_limit"))

    def as_map(sources: dict[str, Column]) -> Column:
        return F.create_map(*[x for k, v in sources.items() for x in (F.lit(k), v)])

    def first(field: str, sources: str) -> Column:
        own = F.filter("rules", lambda r: (r["field"] == field) & F.col(sources)[r["source"]].isNotNull())
        return F.array_min(F.transform(own, lambda r: F.struct(r["priority"], F.col(sources)[r["source"]].alias("value"))))["value"]

    df = df.join(table, ["route", "family"], "left").withColumns({"_numbers": as_map(number_of), "_words": as_map(word_of)})
    fields = {f: F.coalesce(first(f, "_numbers"), F.lit(0.0)) for f in NUMBERS} | {f: first(f, "_words") for f in WORDS}
    return df.withColumns(fields).drop("rules", "_numbers", "_words")


def order_tickets(
    signals: DataFrame,
    settings: tuple[DataFrame, DataFrame, dict],
    cash_index: DataFrame,
    contract_index: DataFrame,
    mode: str = "SUPER",
    ladder: dict | None = None,
    **tables,
) -> DataFrame:
    """Signals (ticket_id, symbol, exch, signal, quant, entry) to complete tickets.

    Signals may bring given_limit, given_stop, given_target, given_trigger (0 or missing: none) and
    given_product (missing: INTRADAY). Settings, segment, strike, instrument with fallback, ladder, quantity,
    route, the fields that RULES name, and trigger operator. Signals without a segment or an instrument give no
    ticket, nor do alerts on an underlying that has none.
    """
    t = resolve_inputs(N.resolve_settings(signals, *settings))
    t = t.withColumn("mode", F.col("order_mode"))
    t = t.withColumn("seg", segment(F.col("exch"), F.col("mode"), F.col("is_index")))
    t = option_params(t.filter("seg <> ''"), **tables)
    t = N.lookup_with_fallback(t, cash_index, contract_index, **tables).filter("security_id IS NOT NULL")
    is_opt, is_fut = F.col("seg").isin(*K.OPTION_SEGMENTS), F.col("seg").isin(*K.FUTURE_SEGMENTS)
    t = t.withColumn("route", route_order(mode, F.col("exch"), F.col("seg")))
    bracket, underlying = F.col("route") == "SUPER", F.col("route") == "UNDERLYING_ALERT"
    t = t.withColumns(
        {
            # Only the bracketed order takes a given limit for a missing price, and widens its ladder for options.
            "raw_price": F.when(bracket & (F.col("entry") <= 0), F.col("given_limit")).otherwise(F.col("entry")),
            "ladder_side": F.when(underlying, F.col("signal")).otherwise(F.col("final_signal")),
            "family": F.when(is_opt | is_fut, "derivative").otherwise("cash"),
            "underlying_seg": F.when(underlying, F.coalesce(X.lookup(K.UNDERLYING_SEGMENT, F.col("seg")), F.col("seg"))),
        }
    )
    t = price_levels(t, "raw_price", "ladder_side", is_opt & bracket, ladder)
    t = apply_rules(t, rule_table(signals.sparkSession))
    t = _with_underlying(t, cash_index)
    sized = order_quantity(F.col("deal_amount"), F.col("entry"), F.col("lot"), F.col("quant"))
    operator = F.when(F.col("ladder_side") == "BUY", "GREATER_THAN").otherwise("LESS_THAN")
    alert = F.col("route").isin("ALERT", "UNDERLYING_ALERT")
    own_seg = exchange_segment(F.col("exch"), F.col("seg"))
    return t.withColumns(
        {
            "quantity": F.when(F.col("route") == "SIMPLE", F.col("quant") * F.col("lot")).otherwise(sized).cast("long"),
            "exchange_seg": own_seg,
            "contract": contract_name(*[F.col(c) for c in ("symbol", "seg", "strike", "opt_type", "used_expiry")]),
            "trigger_operator": F.when(alert, operator),
            "watched_id": F.when(underlying, F.col("underlying_id")).when(alert, F.col("security_id")),
            "watched_seg": F.when(underlying, exchange_segment(F.col("exch"), F.col("underlying_seg"))).when(alert, own_seg),
        }
    ).select(
        "ticket_id",
        "symbol",
        "exchange_seg",
        "contract",
        "security_id",
        F.col("final_signal").alias("side"),
        "quantity",
        "route",
        *WORDS,
        "entry",
        "limit",
        "stop",
        "stop_limit",
        "target",
        "trail",
        *NUMBERS,
        "fell_back",
        "trigger_operator",
        "underlying_seg",
        "watched_id",
        "watched_seg",
    )


def _with_underlying(t: DataFrame, cash_index: DataFrame) -> DataFrame:
    """Add underlying_id; alerts on an underlying that is not listed go."""
    found = cash_index.select("exch", "symbol", F.col("security_id").alias("underlying_id"))
    cash = F.col("underlying_seg").isin(*K.CASH_SEGMENTS)
    t = t.join(found, ["exch", "symbol"], "left").withColumn("underlying_id", F.when(cash, F.col("underlying_id")))
    return t.filter("route <> 'UNDERLYING_ALERT' OR underlying_id IS NOT NULL")


def resolve_inputs(df: DataFrame) -> DataFrame:
    """Quantity rule, and empty overrides for signals that carry none."""
    empty = {"o_opt_type": F.lit(None).cast("string"), "o_strike": F.lit(None).cast("double"), "given_product": F.lit(None).cast("string")}
    empty |= {c: F.lit(None).cast("double") for c in GIVEN}
    for name, none in empty.items():
        if name not in df.columns:
            df = df.withColumn(name, none)
    fill = {c: F.coalesce(c, F.lit(0.0)) for c in GIVEN} | {"given_product": F.coalesce("given_product", F.lit("INTRADAY"))}
    return df.withColumns(fill).withColumn(
        "quant", F.when(F.col("quant") > 1, F.col("quant")).otherwise(F.col("quantity"))
    ).drop("quantity")
