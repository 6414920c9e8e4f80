"""Row-level expressions: session arithmetic, text clean-up, price and order rules."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import constants as K


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a short option map, NULL when absent."""
    if not mapping:
        return F.lit(None)
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def rename_symbols(df: DataFrame, mapping=None, col: str = "symbol") -> DataFrame:
    """Replace known tickers; ``mapping`` is a dict or a DataFrame (symbol, new_symbol)."""
    if isinstance(mapping, DataFrame):
        named = mapping.select(F.col("symbol").alias(col), "new_symbol")
        return (
            df.join(named, col, "left")
            .withColumn(col, F.coalesce("new_symbol", col))
            .drop("new_symbol")
        )
    mapping = K.TICKER_RENAMES if mapping is None else mapping
    return df.withColumn(col, F.coalesce(lookup(mapping, F.col(col)), F.col(col)))


# --- session arithmetic -------------------------------------------------------


def minutes_after_open(ts: Column, open_min: int = K.SESSION_OPEN_MIN) -> Column:
    clock = F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60.0
    return clock - open_min


def interval_count(start: Column, end: Column, tf: int) -> Column:
    """Number of ``tf``-minute intervals begun in (start, end]; 0 if not after start."""
    return F.greatest(F.ceil((end - start) / tf), F.lit(0)).cast("int")


def in_session(
    ts: Column, open_min: int = K.SESSION_OPEN_MIN, length: int = K.SESSION_MINUTES
) -> Column:
    m = minutes_after_open(ts, open_min)
    return (m > 0) & (m <= length)


def bars_per_day(tf: str, session_minutes: int = K.SESSION_MINUTES) -> int:
    step = K.TIMEFRAME_MINUTES[tf]
    return 1 if tf == "D" else -(-session_minutes // step)


def slot_of(
    ts: Column,
    tf_minutes: int,
    open_min: int = K.SESSION_OPEN_MIN,
    length: int = K.SESSION_MINUTES,
) -> Column:
    """Right-closed slot, 1-based; NULL outside the session."""
    m = minutes_after_open(ts, open_min)
    return F.when((m > 0) & (m <= length), F.ceil(m / tf_minutes).cast("int"))


def bar_index(day_idx: Column, slot: Column, per_day: int) -> Column:
    return ((day_idx - 1) * per_day + slot).cast("int")


def bar_end_minute(slot: Column, tf_minutes: int, open_min: int = K.SESSION_OPEN_MIN) -> Column:
    """Minute of day at which a slot closes."""
    return (slot * tf_minutes + open_min).cast("int")


def bar_end_ts(
    day: Column, slot: Column, tf_minutes: int, open_min: int = K.SESSION_OPEN_MIN
) -> Column:
    """Closing timestamp of a slot on a day."""
    minute = bar_end_minute(slot, tf_minutes, open_min)
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute)


def session_gate(
    ts: Column, open_min: int = K.SESSION_OPEN_MIN, length: int = K.SESSION_MINUTES
) -> Column:
    """NULL until a full minute after the open; the close when later than the close."""
    m = minutes_after_open(ts, open_min)
    close = F.date_trunc("day", ts) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(open_min + length)
    )
    return F.when(m >= 1, F.least(ts, close.cast("timestamp_ntz")))


def bar_label(bar: Column, end: Column) -> Column:
    """Long display label of a bar end."""
    return F.concat(bar.cast("string"), F.lit(": "), F.date_format(end, "dd/MM_HHmm"))


def bar_label_short(end: Column, tf: str) -> Column:
    """Short display label: the day for daily bars, the time otherwise."""
    return F.date_format(end, "dd/MM" if tf == "D" else "HHmm")


def fmt_time(ts: Column) -> Column:
    return F.concat(F.hour(ts).cast("string"), F.lit(":"), F.minute(ts).cast("string"))


def fmt_datetime(ts: Column) -> Column:
    day = F.concat(F.dayofmonth(ts).cast("string"), F.lit("/"), F.month(ts).cast("string"))
    return F.concat(day, F.lit("_"), fmt_time(ts))


def window_start(now: datetime, days: float = 0, hours: float = 0) -> datetime:
    return now - timedelta(days=days, hours=hours)


def in_window(ts: Column, now: datetime, days: float = 0, hours: float = 0) -> Column:
    return ts >= F.lit(window_start(now, days, hours)).cast("timestamp_ntz")


# --- filters --------------------------------------------------------------------


def ltp_filter(df: DataFrame, text: str | None, col: str = "ltp") -> DataFrame:
    """Inclusive ``lo-hi`` range; anything that does not parse filters nothing."""
    try:
        lo, hi = (int(x) for x in (text or "").split("-"))
    except ValueError:
        return df
    return df.filter(F.col(col).between(lo, hi))


def ma_action_filter(df: DataFrame, price: str = "na", volume: str = "na") -> DataFrame:
    for want, col in ((price, "price_ma_action"), (volume, "vol_ma_action")):
        if want == "up":
            df = df.filter(F.col(col) > 0)
        elif want == "down":
            df = df.filter(F.col(col) < 0)
    return df


def sort_by(df: DataFrame, key: str, order: str = "desc") -> DataFrame:
    """NULL counts as the smallest value, in both directions."""
    col = F.col(key)
    first = col.desc_nulls_last() if order.lower() == "desc" else col.asc_nulls_first()
    return df.orderBy(first, "symbol")


# --- symbol text ------------------------------------------------------------------


def clean_symbol(col: Column) -> Column:
    text = F.regexp_replace(F.upper(col), r"1!$", "")
    text = F.regexp_replace(text, r"!$", "")
    return F.regexp_replace(text, r"[^A-Z0-9&]", "")


def repair_symbol(col: Column) -> Column:
    """Undo known misreadings, in this order, then clean."""
    text = F.upper(col)
    for wrong, right in (("T1!", "1!"), ("OH", "O1!"), ("EO", "CO")):
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return clean_symbol(text)


def first_number(col: Column) -> Column:
    return F.regexp_extract(col, r"(\d+(\.\d+)?)", 1)


def index_slug(col: Column) -> Column:
    """File name of a list: its letters and digits, in words joined by underscores."""
    known = F.regexp_replace(F.lower(col), r"[^a-z0-9_/\-\s]", "")
    words = F.array_remove(F.split(known, r"[_/\-\s]+"), "")
    return F.concat(F.array_join(words, "_"), F.lit(".csv"))


# --- signals ------------------------------------------------------------------------


def decode_signal(code: Column) -> Column:
    return F.coalesce(lookup(K.SIGNAL_TEXT, code), F.lit(K.SIGNAL_TEXT[0]))


def is_entry_exit(code: Column) -> Column:
    return code.isin(K.ENTER_LONG, K.ENTER_SHORT, K.EXIT_LONG, K.EXIT_SHORT)


def trend_num(code: Column) -> Column:
    return (
        F.when(code.isin(K.ENTER_LONG, K.LONG, K.EXIT_SHORT), 1)
        .when(code.isin(K.ENTER_SHORT, K.SHORT, K.EXIT_LONG), -1)
        .otherwise(0)
    )


def invert_side(signal: Column) -> Column:
    return F.when(signal == "BUY", "SELL").otherwise("BUY")


# --- order text and types ------------------------------------------------------------


def order_type(trigger: Column, limit: Column) -> Column:
    return (
        F.when((trigger > 0) & (limit > 0), "STOP_LOSS")
        .when(trigger > 0, "STOP_LOSS_MARKET")
        .when(limit > 0, "LIMIT")
        .otherwise("MARKET")
    )


def order_detail(qty: Column, trigger: Column, limit: Column) -> Column:
    """``Qty: n | Trig: x | Lmt: y`` with zero or missing parts left out."""

    def part(label: str, value: Column, text: Column) -> Column:
        return F.when(value, F.concat(F.lit(label), text.cast("string")))

    return F.concat_ws(
        " | ",
        part("Qty: ", qty != 0, qty.cast("long")),
        part("Trig: ", trigger > 0, trigger),
        part("Lmt: ", limit > 0, limit),
    )
