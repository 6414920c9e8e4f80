"""Moving averages and oscillators over grid bars, daily series and hourly bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions.recurrence import decayed_in_blocks
from tickloom.operators import bars as B
from tickloom.operators import indicators as I
from tickloom.plans import adapters as A
from tickloom.plans.registry import query
from tickloom.plans.signal_sql import Chain
from tickloom.session import materialise

# A symbol's daily closes, numbered; the averages seeded by the first value run on these.
DAILY_SQL = f"""WITH {A.PANEL_SQL}, daily AS MATERIALIZED (SELECT symbol, value, ltp,
  row_number() OVER (PARTITION BY symbol ORDER BY day) AS bar FROM panel)"""


def _daily(spark, d):
    w = Window.partitionBy("symbol").orderBy("day")
    return A.panel(spark, d).select("symbol", "value", "ltp", F.row_number().over(w).alias("bar"))


def _fold_sql(alpha: str) -> str:
    return f"""{DAILY_SQL} SELECT a.symbol, a.bar, sum(pow(1 - {alpha}, a.bar - b.bar) * b.value *
  CASE WHEN b.bar = 1 THEN 1.0::DOUBLE ELSE {alpha} END) AS ma
  FROM daily a JOIN daily b ON a.symbol = b.symbol AND b.bar <= a.bar GROUP BY 1, 2"""


for _name, _fn, _alpha in (
    ("ema", lambda: I.ema("value", 8), "(2.0::DOUBLE / 9)"),
    ("rma", lambda: I.rma("value", 8), "(1.0::DOUBLE / 8)"),
    ("ewma", lambda: I.ewma("value", 0.94), "(1 - 0.94::DOUBLE)"),
    ("exp_ma", lambda: I.exp_ma("value", 0.3), "(0.3::DOUBLE)"),
    ("moving_average_fallback", lambda: I.moving_average("hull", "value", 21), "(1.0::DOUBLE / 21)"),
):
    query(_name, _fold_sql(_alpha), r="ma")(
        lambda spark, d, f=_fn: _daily(spark, d).select("symbol", "bar", f().alias("ma"))
    )


@query("rma_in_blocks", _fold_sql("(1.0::DOUBLE / 8)"), r="ma")
def rma_in_blocks(spark, d):
    """The same average with each series cut into blocks (small ones, to have many)."""
    daily = _daily(spark, d).withColumn("pos", F.col("bar") - 1)
    out = decayed_in_blocks(daily, "symbol", "pos", "value", 1.0 / 8, "ma", block=64)
    return out.select("symbol", "bar", "ma")


@query(
    "sma",
    f"""{DAILY_SQL} SELECT symbol, bar, CASE WHEN bar >= 21 THEN avg(value) OVER (PARTITION BY symbol ORDER BY bar
      ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) ELSE 0 END AS ma FROM daily""",
    r="ma",
)
def sma(spark, d):
    return _daily(spark, d).select("symbol", "bar", I.sma("value", 21).alias("ma"))


@query(
    "ma_report",
    f"""{DAILY_SQL}, e AS (SELECT a.symbol, a.bar, sum(pow(1 - 2.0::DOUBLE / 9, a.bar - b.bar) * b.ltp *
      CASE WHEN b.bar = 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE / 9 END) AS ema FROM daily a JOIN daily b ON a.symbol = b.symbol AND b.bar <= a.bar GROUP BY 1, 2)
    SELECT symbol, bar, avg(ltp) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS sma, ema
    FROM daily JOIN e USING (symbol, bar)""",
    r="sma ema",
)
def ma_report(spark, d):
    return I.ma_report(_daily(spark, d), "ltp", 8).select("symbol", "bar", "sma", "ema")


@query(
    "indicator_series",
    f"""WITH {A.BARS_SQL}, one AS MATERIALIZED (SELECT symbol, bar, volume FROM bars WHERE symbol = (SELECT min(symbol) FROM bars))
    SELECT a.symbol, a.bar, sum(pow(1 - 2.0::DOUBLE / 22, a.bar - b.bar) * b.volume *
      CASE WHEN b.bar = 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE / 22 END) AS value
    FROM one a JOIN one b ON b.bar <= a.bar GROUP BY 1, 2""",
    r="value",
)
def indicator_series(spark, d):
    bars = materialise(A.base_bars(spark, d), "bars")
    return I.indicator_series(bars, bars.agg(F.min("symbol")).first()[0], "volume", "ema", 21)


def _hourly(spark, d):
    return A.hourly(spark, d)


def _chain(name, build, cols, transform):
    sql = build(Chain()).sql(f"symbol, bar, {', '.join(cols)} FROM TOP")
    query(name, sql, r=" ".join(cols))(
        lambda spark, d: transform(_hourly(spark, d)).select("symbol", "bar", *cols)
    )


_chain("seeded_rma", lambda c: c.rma({"ma": ("close", 8)}), ["ma"], lambda h: I.seeded_rma(h, {"ma": ("close", 8)}))
_chain(
    "ma_bundle",
    lambda c: c.rma({f"ma{i}": ("close", n) for i, n in enumerate((8, 21, 55, 233), 1)}),
    ["ma1", "ma2", "ma3", "ma4"],
    lambda h: I.ma_bundle(h),
)
_chain("rsi", lambda c: c.rsi("close", 8, "rsi"), ["rsi"], lambda h: I.rsi(h))
_chain(
    "roc",
    lambda c: c.step("CASE WHEN lag(close, 8) OVER w <> 0 THEN 100 * (close - lag(close, 8) OVER w) / lag(close, 8) OVER w END AS roc"),
    ["roc"],
    lambda h: h.withColumn("roc", I.roc("close", 8)),
)
_chain(
    "rolling_range_and_deviation",
    lambda c: c.step(", ".join([c.full("high", 20, "max", "hi"), c.full("low", 20, "min", "lo"), c.full("close", 20, "stddev_pop", "sd")])),
    ["hi", "lo", "sd"],
    lambda h: h.withColumns({"hi": I.highest("high", 20), "lo": I.lowest("low", 20), "sd": I.rolling_std("close", 20)}),
)
_chain(
    "linear_regression_and_change",
    lambda c: c.step("(-lag(close, 2) OVER w + 2 * lag(close) OVER w + 5 * close) / 6 AS lr, close - lag(close) OVER w AS ch"),
    ["lr", "ch"],
    lambda h: h.withColumns({"lr": I.linreg3("close"), "ch": I.change("close")}),
)
_chain(
    "slope_angle",
    lambda c: c.trend("close", "t").step("an_t AS angle"),
    ["angle"],
    lambda h: I.angle(h, "close"),
)
_chain("osc_trend", lambda c: c.trend("close", "trend"), ["trend"], lambda h: I.osc_trend(h, "close"))
_chain("rsi_osc", lambda c: c.rsi_osc(), ["rsi_fast", "rsi_sig"], lambda h: I.rsi_osc(h))
_chain("roc_osc", lambda c: c.roc(), ["roc_fast", "roc_sig"], lambda h: I.roc_osc(h))
_chain("kst", lambda c: c.kst(), ["kst_fast", "kst_sig"], lambda h: I.kst(h))
_chain("kst_raw", lambda c: c.kst_raw("close", "k").step("k_raw AS kst_raw"), ["kst_raw"], lambda h: I.kst_raw(h))
_chain(
    "vol_rsi",
    lambda c: c.rsi("volume", 8, "v8").rma({"vol_rsi": ("v8", 21)}),
    ["vol_rsi"],
    lambda h: I.vol_rsi(h),
)
TR = "CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr"
_chain("atr", lambda c: c.step(TR).rma({"atr": ("tr", 5)}), ["atr"], lambda h: I.atr(h, 5))
_chain(
    "cum_mean_true_range",
    lambda c: c.step(TR).step("CASE WHEN bar > 1 THEN sum(CASE WHEN bar > 1 THEN tr END) OVER g / (bar - 1) END AS mean_tr"),
    ["mean_tr"],
    lambda h: I.cum_mean_tr(h),
)
_chain(
    "choppiness",
    lambda c: c.step(TR)
    .step(", ".join([c.full("tr", 21, "sum", "str"), c.full("high", 21, "max", "hi"), c.full("low", 21, "min", "lo")]))
    .step("CASE WHEN hi - lo > 0 AND str > 0 THEN 100 * log10(str / (hi - lo)) / log10(21.0::DOUBLE) END AS chop"),
    ["chop"],
    lambda h: I.choppiness(h),
)
_chain(
    "lineup_status",
    lambda c: c.rma({f"ma{i}": ("close", n) for i, n in enumerate((8, 21, 55, 233), 1)}).step(
        """CASE WHEN coalesce((ma1<=ma2 AND ma2<=ma3 AND ma3<=ma4) OR (ma1>=ma2 AND ma2>=ma3 AND ma3>=ma4), false) THEN 4
        WHEN coalesce((ma1<=ma2 AND ma2<=ma3) OR (ma1>=ma2 AND ma2>=ma3), false) THEN 3
        WHEN coalesce(ma1<=ma2 OR ma1>=ma2, false) THEN 2 ELSE 0 END AS lineup"""
    ),
    ["lineup"],
    lambda h: I.ma_bundle(h).withColumn("lineup", I.lineup_status(*[F.col(f"ma{i}") for i in range(1, 5)])),
)


@query(
    "crossings",
    Chain().rma({"f": ("close", 8), "s": ("close", 21)}).sql(
        """symbol, bar, coalesce(f > s AND lag(f) OVER w <= lag(s) OVER w, false) AS up,
        coalesce(f < s AND lag(f) OVER w >= lag(s) OVER w, false) AS down FROM TOP WINDOW w AS (PARTITION BY symbol ORDER BY bar)"""
    ),
)
def crossings(spark, d):
    h = I.seeded_rma(_hourly(spark, d), {"f": ("close", 8), "s": ("close", 21)})
    return h.select("symbol", "bar", I.crossover("f", "s").alias("up"), I.crossunder("f", "s").alias("down"))
