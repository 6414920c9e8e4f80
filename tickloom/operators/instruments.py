"""Instrument master: names, keys, lookups and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import constants as K
from tickloom.functions import scalar as X


def display_name(inst: Column, symbol: Column, raw: Column) -> Column:
    """Display text by instrument family."""
    text = F.trim(raw)
    has = F.upper(text).startswith(F.upper(symbol))
    clean = F.btrim(F.substr(text, F.length(symbol) + 1), F.lit(" -()"))
    cash = (
        F.when(F.upper(text) == F.upper(symbol), F.concat(symbol, F.lit(" - EQ")))
        .when(has & (clean != ""), F.concat(symbol, F.lit(" - EQ ("), clean, F.lit(")")))
        .when(has, F.concat(symbol, F.lit(" - EQ")))
        .otherwise(F.concat(symbol, F.lit(" - EQ ("), text, F.lit(")")))
    )
    return (
        F.when(inst.startswith("OPT"), F.when(has, text).otherwise(F.concat_ws(" ", symbol, text)))
        .when(inst.startswith("FUT"), F.when(has, text).otherwise(F.concat_ws(" ", symbol, F.lit("FUT"), text)))
        .otherwise(cash)
    )


def family(inst: Column) -> Column:
    return F.when(inst.startswith("OPT"), "OPT").when(inst.startswith("FUT"), "FUT").otherwise("EQ")


def option_side(raw: Column) -> Column:
    t = F.upper(F.trim(raw))
    return F.when(t.startswith("C"), "CE").when(t.startswith("P"), "PE").otherwise("")


def month_tag(expiry: Column) -> Column:
    months = dict(enumerate(K.MONTH_WORDS, 1))
    return F.coalesce(X.lookup(months, F.substring(expiry, 6, 2).try_cast("int")), F.lit(""))


def live_instruments(df: DataFrame, today: str) -> DataFrame:
    """All cash instruments, and derivatives that expire on or after ``today`` (yyyy-MM-dd)."""
    cash = F.col("inst").isin(*K.CASH_SEGMENTS)
    return df.filter(cash | (F.substring_index(F.col("expiry"), " ", 1) >= today))


def instrument_index(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cash index, contract index) from rows in ``load_pos`` order.

    The last row wins for a cash key, the first for a contract key; an INDEX row never
    replaces an earlier row with the same id.
    """
    cash = F.col("inst").isin(*K.CASH_SEGMENTS)
    first_seen = df.groupBy("security_id").agg(F.min("load_pos").alias("first_pos"))
    kept = (
        df.filter(cash)
        .join(first_seen, "security_id")
        .filter((F.col("inst") != "INDEX") | (F.col("load_pos") == F.col("first_pos")))
    )
    last = kept.groupBy("exch", "symbol").agg(F.max("load_pos").alias("load_pos"))
    cash_index = kept.join(last, ["exch", "symbol", "load_pos"]).select("exch", "symbol", "security_id", "lot")

    option = F.col("inst").startswith("OPT")
    contracts = df.filter(~cash).select(
        "exch",
        "inst",
        "symbol",
        F.substring_index("expiry", " ", 1).alias("expiry"),
        F.when(option, F.col("strike")).otherwise(-1.0).alias("strike"),
        F.when(option, F.upper(F.trim("opt_type"))).otherwise("").alias("opt_type"),
        "security_id",
        "lot",
        "load_pos",
    )
    key = ["exch", "inst", "symbol", "expiry", "strike", "opt_type"]
    first = contracts.groupBy(*key).agg(F.min("load_pos").alias("load_pos"))
    return cash_index, contracts.join(first, key + ["load_pos"]).drop("load_pos")


def lookup_instruments(tickets: DataFrame, cash_index: DataFrame, contract_index: DataFrame) -> DataFrame:
    """Add security_id, lot and used_expiry to tickets (ticket_id, exch, seg, symbol, expiry, strike, opt_type).

    Contracts: the wanted expiry when listed, else the nearest listed one.
    """
    cash = F.col("seg").isin(*K.CASH_SEGMENTS)
    spot = tickets.filter(cash).join(cash_index, ["exch", "symbol"], "left")
    listed = contract_index.select("exch", F.col("inst").alias("seg"), "symbol", "expiry").distinct()
    nearest = listed.groupBy("exch", "seg", "symbol").agg(F.min("expiry").alias("nearest"))
    series = ["exch", "seg", "symbol"]
    derived = (
        tickets.filter(~cash)
        .join(nearest, series, "left")
        .join(listed.withColumn("hit", F.lit(True)), series + ["expiry"], "left")
        .withColumn("used_expiry", F.when(F.col("hit"), F.col("expiry")).otherwise(F.col("nearest")))
        .drop("nearest", "hit")
    )
    found = contract_index.withColumnsRenamed(
        {"inst": "seg", "expiry": "used_expiry", "strike": "_k", "opt_type": "_o"}
    )
    derived = (
        derived.withColumn("_k", F.coalesce("strike", F.lit(-1.0)))
        .withColumn("_o", F.coalesce("opt_type", F.lit("")))
        .join(found, series + ["used_expiry", "_k", "_o"], "left")
        .drop("_k", "_o")
    )
    return spot.withColumn("used_expiry", F.lit(None).cast("string")).unionByName(derived)


def strike_interval(
    symbol: Column,
    price: Column,
    index: dict | None = None,
    commodity: dict | None = None,
    bands: list | None = None,
) -> Column:
    """Strike step: index table, commodity table, then the price band (short option tables)."""
    key = F.upper(F.trim(symbol))
    by_band = F.lit(K.EQUITY_STRIKE_DEFAULT)
    for top, step in reversed(K.EQUITY_STRIKE_BANDS if bands is None else bands):
        by_band = F.when(price <= top, step).otherwise(by_band)
    return F.coalesce(
        X.lookup(K.INDEX_STRIKE_STEP if index is None else index, key).cast("int"),
        X.lookup(K.COMMODITY_STRIKE_STEP if commodity is None else commodity, key).cast("int"),
        by_band,
    )


def strike_price(df: DataFrame, symbol: str = "symbol", price: str = "price", signal: str = "signal", **tables) -> DataFrame:
    """Add interval, strike, option_type; unusable rows get a text in ``reject`` instead."""
    p, sig = F.col(price), F.upper(F.trim(signal))
    step = strike_interval(F.col(symbol), p, **tables)
    reject = F.when(F.coalesce(p, F.lit(0.0)) <= 0, "price must be > 0").when(
        ~F.coalesce(sig.isin("BUY", "SELL"), F.lit(False)), "signal must be BUY or SELL"
    )
    strike = F.when(sig == "BUY", F.floor(p / step) * step).otherwise(F.ceil(p / step) * step)
    side = F.when(sig == "BUY", "CALL").otherwise("PUT")
    return df.withColumn("reject", reject).withColumns(
        {
            "interval": F.when(F.col("reject").isNull(), step),
            "strike": F.when(F.col("reject").isNull(), strike.cast("double")),
            "option_type": F.when(F.col("reject").isNull(), side),
        }
    )


def fallback_strike(symbol: Column, strike: Column, opt_type: Column, **tables) -> Column:
    """Strike on the next coarser step, NULL when there is none or it is the same."""
    interval = strike_interval(symbol, strike, **tables)
    coarser = F.filter(F.array(*[F.lit(s) for s in K.FALLBACK_STEPS]), lambda s: s > interval)
    step = F.get(coarser, F.lit(0))
    moved = F.when(opt_type == "CE", F.floor(strike / step) * step).otherwise(F.ceil(strike / step) * step)
    moved = moved.cast("double")
    return F.when((moved != 0) & (moved != strike), moved)


def lookup_with_fallback(
    tickets: DataFrame, cash_index: DataFrame, contract_index: DataFrame, **tables
) -> DataFrame:
    """Lookup, then a second one at the fallback strike for options not found."""
    first = lookup_instruments(tickets, cash_index, contract_index)
    moved = fallback_strike(F.col("symbol"), F.col("strike"), F.col("opt_type"), **tables)
    retry = (
        F.col("security_id").isNull() & F.col("seg").isin(*K.OPTION_SEGMENTS)
    )
    first = first.withColumn("_retry", F.when(retry, moved))
    second = contract_index.select(
        "exch",
        F.col("inst").alias("seg"),
        "symbol",
        F.col("expiry").alias("used_expiry"),
        F.col("strike").alias("_retry"),
        "opt_type",
        F.col("security_id").alias("_id"),
        F.col("lot").alias("_lot"),
    )
    return (
        first.join(second, ["exch", "seg", "symbol", "used_expiry", "_retry", "opt_type"], "left")
        .withColumns(
            {
                "strike": F.when(F.col("_id").isNotNull(), F.col("_retry")).otherwise(F.col("strike")),
                "fell_back": F.col("_id").isNotNull(),
                "security_id": F.coalesce("security_id", "_id"),
                "lot": F.coalesce("lot", "_lot", F.lit(0)),
            }
        )
        .drop("_retry", "_id", "_lot")
    )


def resolve_settings(df: DataFrame, symbol_cfg: DataFrame, group_cfg: DataFrame, defaults: dict) -> DataFrame:
    """Settings per (symbol, exch): own value, else the group's, else the default.

    ``symbol_cfg``: exch, symbol, grp and settings. ``group_cfg``: exch, grp, is_fallback
    (the group of unlisted symbols of the exchange), is_index and settings.
    """
    names = list(defaults)
    own = symbol_cfg.select("exch", "symbol", "grp", *[F.col(n).alias(f"s_{n}") for n in names])
    group = group_cfg.select("exch", "grp", "is_index", *[F.col(n).alias(f"g_{n}") for n in names])
    spare = group_cfg.filter("is_fallback").select("exch", F.col("grp").alias("spare_grp"))
    out = (
        df.join(own, ["exch", "symbol"], "left")
        .join(spare, "exch", "left")
        .withColumn("grp", F.coalesce("grp", "spare_grp"))
        .join(group, ["exch", "grp"], "left")
    )
    values = {n: F.coalesce(f"s_{n}", f"g_{n}", F.lit(v)) for n, v in defaults.items()}
    values["is_index"] = F.coalesce("is_index", F.lit(False))
    drop = [f"{p}_{n}" for p in "sg" for n in names] + ["spare_grp"]
    return out.withColumns(values).drop(*drop)


def name_key(col: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(col)), r"\s+", " ")


def by_display_name(df: DataFrame, master: DataFrame) -> DataFrame:
    """Rows whose text is a display name take the instrument's fields where they have none."""
    first = master.groupBy(name_key(F.col("display")).alias("_key")).agg(F.min("load_pos").alias("load_pos"))
    named = first.join(master, "load_pos").select(
        "_key",
        F.col("symbol").alias("m_symbol"),
        F.col("exch").alias("m_exch"),
        F.col("inst_type").alias("m_inst_type"),
        F.col("strike").alias("m_strike"),
        F.col("opt_type").alias("m_opt_type"),
        F.col("expiry").alias("m_expiry"),
    )

    def text(own: str, found: str) -> Column:
        return F.coalesce(F.when(F.col(own) != "", F.col(own)), F.col(found))

    return (
        df.withColumn("_key", name_key(F.col("symbol")))
        .join(named, "_key", "left")
        .withColumns(
            {
                "symbol": F.coalesce("m_symbol", "symbol"),
                "exch": F.coalesce("m_exch", "exch"),
                "inst_type": text("inst_type", "m_inst_type"),
                "opt_type": text("opt_type", "m_opt_type"),
                "expiry": text("expiry", "m_expiry"),
                "strike": F.when(F.col("strike") > 0, F.col("strike")).otherwise(
                    F.coalesce(F.when(F.col("m_strike") > 0, F.col("m_strike")), "strike")
                ),
            }
        )
        .drop("_key", "m_symbol", "m_exch", "m_inst_type", "m_strike", "m_opt_type", "m_expiry")
    )


def enrich_ids(df: DataFrame, master: DataFrame, fallback: str) -> DataFrame:
    """Display name and base symbol by security id, the ``fallback`` column when unknown."""
    info = master.select("security_id", F.col("display").alias("_d"), F.col("symbol").alias("_s"))
    return (
        df.join(info, "security_id", "left")
        .withColumns(
            {
                "display_name": F.coalesce("_d", fallback),
                "base_symbol": F.coalesce("_s", fallback),
            }
        )
        .drop("_d", "_s")
    )


def instrument_details(master: DataFrame) -> DataFrame:
    """One row per security id: the last in ``load_pos`` order, but an INDEX row never replaces an earlier one."""
    first = master.groupBy("security_id").agg(F.min("load_pos").alias("_first"))
    kept = master.join(first, "security_id").filter((F.col("inst") != "INDEX") | (F.col("load_pos") == F.col("_first")))
    row = F.struct("display", "symbol", "exch", "inst", "expiry", "strike", "opt_type")
    return kept.groupBy("security_id").agg(F.max_by(row, "load_pos").alias("_i")).select("security_id", "_i.*")


def instrument_family(inst: Column) -> Column:
    """OPT, FUT or EQ; '' for what is none of them."""
    return (
        F.when(inst.contains("OPT"), "OPT").when(inst.contains("FUT"), "FUT").when(inst.contains("EQ") | (inst == "INDEX"), "EQ").otherwise("")
    )
