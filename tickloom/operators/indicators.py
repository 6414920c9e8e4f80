"""Moving averages and oscillators as window columns.

Input: one row per (symbol, bar). The bar builders guarantee that, so a window over
one symbol holds as many rows as the calendar has bars, however many deals the
symbol had. All columns of a chain share one partitioning and one sort order.
"""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import constants as K
from tickloom.functions.recurrence import decayed, decayed_mean, growing


# The same windows as SQL text: a long chain is built faster from a few parsed
# expressions than from many small column objects.
BARS = "PARTITION BY symbol ORDER BY bar"
SO_FAR = f"OVER ({BARS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def series():
    return Window.partitionBy("symbol").orderBy("bar")


def so_far():
    return growing("symbol", order="bar")


def trailing(n: int):
    return series().rowsBetween(-(n - 1), 0)


def prev_sql(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER ({BARS})"


def prev(col: str | Column, n: int = 1) -> Column:
    return F.expr(prev_sql(col, n)) if isinstance(col, str) else F.lag(col, n).over(series())


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _full_sql(fn: str, c: str, n: int) -> str:
    """NULL unless the last ``n`` bars all have a value."""
    frame = f"OVER ({BARS} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {frame} = {n} THEN {fn}({c}) {frame} END"


# --- averages seeded by the first value ----------------------------------------


def sma(c: str | Column, n: int) -> Column:
    """Zero until ``n`` bars exist."""
    full = F.row_number().over(series()) >= n
    return F.when(full, F.avg(_col(c)).over(trailing(n))).otherwise(0.0)


def exp_ma(c: str | Column, alpha: float) -> Column:
    return decayed(_col(c), alpha, so_far())


def ema(c: str | Column, n: int) -> Column:
    return exp_ma(c, 2.0 / (n + 1))


def rma(c: str | Column, n: int) -> Column:
    return exp_ma(c, 1.0 / n)


def ewma(c: str | Column, lam: float = 0.94) -> Column:
    return exp_ma(c, 1.0 - lam)


def running_sma(c: str | Column, n: int) -> Column:
    return F.avg(_col(c)).over(trailing(n))


def moving_average(kind: str, c: str | Column, n: int) -> Column:
    return {"sma": sma, "ema": ema}.get(kind.lower(), rma)(c, n)


def ma_report(df: DataFrame, c: str, n: int) -> DataFrame:
    return df.withColumns({"sma": running_sma(c, n), "ema": ema(c, n)})


def indicator_series(
    bars: DataFrame, symbol: str, source: str = "volume", kind: str | None = None, n: int = 0
) -> DataFrame:
    """Raw series of one symbol, or a moving average of it. The filter reaches the scan."""
    one = bars.filter(F.col("symbol") == symbol)
    value = moving_average(kind, source, n) if kind else F.col(source)
    return one.select("symbol", "bar", value.alias("value"))


# --- averages seeded by a simple average ----------------------------------------


def seeded_rma(df: DataFrame, jobs: dict[str, tuple[str, int]]) -> DataFrame:
    """Add ``out: (source, n)`` averages that start with the mean of ``n`` values.

    A NULL input ends a series; the next ``n`` values seed it afresh. One unbroken
    decayed sum runs over the whole symbol; the part that precedes the current seed
    is subtracted again. So all averages of a call share two window passes, on the
    partitioning and order the bars already have. ``bar`` must count rows without holes.
    """
    sources = {c: f"_{i}" for i, c in enumerate(sorted({c for c, _ in jobs.values()}))}
    first_pass, second_pass, result = {}, {}, {}
    for c, t in sources.items():
        broken = f"last(CASE WHEN {c} IS NULL THEN bar END, true) {SO_FAR}"
        first_pass[f"_k{t}"] = F.expr(f"count({c}) {SO_FAR}")
        first_pass[f"_run{t}"] = F.expr(f"bar - coalesce({broken}, first(bar) {SO_FAR} - 1)")
        first_pass[f"_sum{t}"] = F.expr(f"coalesce(sum({c}) {SO_FAR}, 0D)")
        second_pass[f"_cut{t}"] = F.expr(
            f"coalesce(last(CASE WHEN {c} IS NULL THEN _sum{t} END, true) {SO_FAR}, 0D)"
        )
    window = so_far()
    for o, (c, n) in jobs.items():
        t = sources[c]
        keep = f"{1 - 1.0 / n!r}D"
        first_pass[f"_e_{o}"] = decayed_mean(F.col(c), 1.0 / n, window)
        decayed_sum = f"_e_{o} * (1 - pow({keep}, _k{t}))"
        for part, value in (("k", f"_k{t}"), ("sum", f"_sum{t}"), ("e", decayed_sum)):
            second_pass[f"_s{part}_{o}"] = F.expr(
                f"last(CASE WHEN _run{t} = {n} THEN {value} END, true) {SO_FAR}"
            )
        fade = f"pow({keep}, _k{t} - _sk_{o})"
        seed = f"(_ssum_{o} - _cut{t}) / {n}"
        result[o] = F.expr(
            f"CASE WHEN {c} IS NOT NULL AND _run{t} >= {n} "
            f"THEN {seed} * {fade} + ({decayed_sum} - {fade} * _se_{o}) END"
        )
    return (
        df.withColumns(first_pass).withColumns(second_pass).withColumns(result).drop(*first_pass, *second_pass)
    )


# A chain is a list of levels (columns to add, averages to take afterwards); a level may
# read what earlier levels made. Chains run side by side: what stands on one level of
# several chains shares its window passes.
Level = tuple[dict[str, Column], dict[str, tuple[str, int]]]


def run_levels(df: DataFrame, *chains: list[Level]) -> DataFrame:
    """Run chains level by level and drop their helper columns (leading underscore)."""
    mine = set(df.columns)
    for level in zip_longest(*chains, fillvalue=({}, {})):
        cols = {k: v for c, _ in level for k, v in c.items()}
        jobs = {k: v for _, j in level for k, v in j.items()}
        df = df.withColumns(cols) if cols else df
        df = seeded_rma(df, jobs) if jobs else df
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in mine])


def ma_bundle(df: DataFrame, c: str = "close", lengths=K.MA_BUNDLE) -> DataFrame:
    return run_levels(df, ma_bundle_levels(c, lengths))


# --- window statistics -------------------------------------------------------------


def highest(c: str, n: int) -> Column:
    return F.expr(_full_sql("max", c, n))


def lowest(c: str, n: int) -> Column:
    return F.expr(_full_sql("min", c, n))


def rolling_std(c: str, n: int) -> Column:
    return F.expr(_full_sql("stddev_pop", c, n))


def roc(c: str, n: int) -> Column:
    old = prev_sql(c, n)
    return F.expr(f"CASE WHEN {old} <> 0 THEN 100D * ({c} - {old}) / {old} END")


def _linreg3_sql(c: str) -> str:
    return f"((-{prev_sql(c, 2)} + 2D * {prev_sql(c)} + 5D * {c}) / 6D)"


def linreg3(c: str) -> Column:
    return F.expr(_linreg3_sql(c))


def change(c: str | Column) -> Column:
    return _col(c) - prev(c, 1)


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def crossover(a: str, b: str) -> Column:
    return F.expr(f"coalesce({a} > {b} AND {prev_sql(a)} <= {prev_sql(b)}, false)")


def crossunder(a: str, b: str) -> Column:
    return F.expr(f"coalesce({a} < {b} AND {prev_sql(a)} >= {prev_sql(b)}, false)")


def true_range() -> Column:
    last = prev("close")
    reach = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last)
    )
    return F.when(last.isNull(), F.col("high") - F.col("low")).otherwise(reach)


def atr(df: DataFrame, n: int, out: str = "atr") -> DataFrame:
    return seeded_rma(df.withColumn("_tr", true_range()), {out: ("_tr", n)}).drop("_tr")


def cum_mean_tr(df: DataFrame, out: str = "mean_tr") -> DataFrame:
    """Running sum of true range over the 0-based bar number; the first bar has no range."""
    df = df.withColumn("_tr", F.when(prev("close").isNotNull(), true_range()))
    at = F.row_number().over(series()) - 1
    return df.withColumn(out, F.when(at > 0, F.sum("_tr").over(so_far()) / at)).drop("_tr")


def choppiness(df: DataFrame, n: int = 21, out: str = "chop") -> DataFrame:
    df = df.withColumn("_tr", true_range())
    total = F.expr(_full_sql("sum", "_tr", n))
    span = highest("high", n) - lowest("low", n)
    value = F.when((span > 0) & (total > 0), 100 * F.log10(total / span) / F.log10(F.lit(float(n))))
    return df.withColumn(out, value).drop("_tr")


# --- oscillators --------------------------------------------------------------------


def rsi_levels(c: str, n: int, out: str, tag: str) -> list[Level]:
    """Wilder: averages of gains and losses; 100 without losses, 0 without gains."""
    up, dn, rup, rdn = (f"_{x}{tag}" for x in ("up", "dn", "rup", "rdn"))
    step = f"({c} - {prev_sql(c)})"
    moves = {up: F.expr(f"greatest({step}, 0 * {step})"), dn: F.expr(f"greatest(-{step}, 0 * {step})")}
    value = (
        f"CASE WHEN {rup} IS NULL THEN NULL WHEN {rdn} = 0 THEN 100D WHEN {rup} = 0 THEN 0D "
        f"ELSE 100D - 100D / (1D + {rup} / {rdn}) END"
    )
    return [(moves, {rup: (up, n), rdn: (dn, n)}), ({out: F.expr(value)}, {})]


def rsi(df: DataFrame, c: str = "close", n: int = K.RSI_LEN, out: str = "rsi") -> DataFrame:
    return run_levels(df, rsi_levels(c, n, out, ""))


def angle_column(c: str, n: int = K.TREND_RANGE) -> Column:
    span = f"({_full_sql('max', c, n)} - {_full_sql('min', c, n)})"
    rise = f"({c} - coalesce({prev_sql(c)}, 0D))"
    return F.expr(f"CASE WHEN {span} <> 0 THEN {K.RAD_TO_DEG!r}D * atan({rise} / {span}) END")


def angle(df: DataFrame, c: str, out: str = "angle", n: int = K.TREND_RANGE) -> DataFrame:
    """Slope of the last step in degrees, scaled by the range of the last ``n`` bars."""
    return df.withColumn(out, angle_column(c, n))


def trend_levels(
    c: str, out: str, tag: str, threshold: float = K.TREND_THRESHOLD
) -> list[Level]:
    n = K.TREND_RANGE
    a, hi, lo = (f"_{x}{tag}" for x in ("angle", "hi", "lo"))
    slope = _linreg3_sql(a)
    turn = (
        f"CASE WHEN coalesce({slope} >= {threshold!r}D, false) OR coalesce({c} >= {hi}, false) THEN {K.UP} "
        f"WHEN coalesce({slope} <= -{threshold!r}D, false) OR coalesce({c} <= {lo}, false) THEN {K.DOWN} ELSE {K.FLAT} END"
    )
    ranges = {a: angle_column(c, n), hi: highest(c, n), lo: lowest(c, n)}
    return [(ranges, {}), ({out: F.expr(turn)}, {})]


def osc_trend(df: DataFrame, c: str, out: str = "trend", threshold: float = K.TREND_THRESHOLD) -> DataFrame:
    return run_levels(df, trend_levels(c, out, "", threshold))


def rsi_osc_levels(c: str, fast: str, sig: str) -> list[Level]:
    raw, once = f"_rsi_{fast}", f"_once_{fast}"
    first, (cols, _) = rsi_levels(c, K.RSI_LEN, raw, f"_{fast}")
    return [
        first,
        (cols, {once: (raw, K.RSI_MA_LEN)}),
        ({}, {fast: (once, K.SMOOTH_LEN)}),
        ({}, {sig: (fast, K.SIGNAL_LEN)}),
    ]


def rsi_osc(df: DataFrame, c: str = "close", fast: str = "rsi_fast", sig: str = "rsi_sig") -> DataFrame:
    return run_levels(df, rsi_osc_levels(c, fast, sig))


def _scaled(raw: str, value: Column, fast: str, sig: str) -> list[Level]:
    """Smooth, express in percent of three deviations, add the signal line."""
    smooth, sd = f"_smooth_{fast}", _full_sql("stddev_pop", raw, K.STDEV_LEN)
    percent = F.expr(f"CASE WHEN {sd} <> 0 THEN 100D * {smooth} / (3D * ({sd})) END")
    return [
        ({raw: value}, {smooth: (raw, K.SMOOTH_LEN)}),
        ({fast: percent}, {sig: (fast, K.SIGNAL_LEN)}),
    ]


def roc_osc_levels(c: str, fast: str, sig: str) -> list[Level]:
    f, s = f"_f_{fast}", f"_s_{fast}"
    raw = F.expr(f"CASE WHEN {s} <> 0 THEN 100D * ({f} - {s}) / {s} END")
    return [({}, {f: (c, K.FAST_LEN), s: (c, K.SLOW_LEN)})] + _scaled(f"_raw_{fast}", raw, fast, sig)


def roc_osc(df: DataFrame, c: str = "close", fast: str = "roc_fast", sig: str = "roc_sig") -> DataFrame:
    return run_levels(df, roc_osc_levels(c, fast, sig))


def _kst_parts(c: str, tag: str) -> tuple[Level, Column]:
    """Smoothed rates of change and their weighted sum 1..4."""
    rocs = {f"_roc{i}_{tag}": roc(c, n) for i, n in enumerate(K.KST_ROC, 1)}
    jobs = {f"_kst{i}_{tag}": (f"_roc{i}_{tag}", n) for i, n in enumerate(K.KST_MA, 1)}
    total = " + ".join(f"{i} * _kst{i}_{tag}" for i in range(1, 5))
    return (rocs, jobs), F.expr(total)


def kst_raw(df: DataFrame, c: str = "close", out: str = "kst_raw") -> DataFrame:
    level, total = _kst_parts(c, "raw")
    return run_levels(df, [level, ({out: total}, {})])


def kst_levels(c: str, fast: str, sig: str) -> list[Level]:
    level, total = _kst_parts(c, fast)
    return [level] + _scaled(f"_raw_{fast}", total, fast, sig)


def kst(df: DataFrame, c: str = "close", fast: str = "kst_fast", sig: str = "kst_sig") -> DataFrame:
    return run_levels(df, kst_levels(c, fast, sig))


def vol_rsi(df: DataFrame, n: int = K.RSI_LEN, smooth: int = 21, out: str = "vol_rsi") -> DataFrame:
    first, (cols, _) = rsi_levels("volume", n, "_vrsi", "_v")
    return run_levels(df, [first, (cols, {out: ("_vrsi", smooth)})])


def ma_bundle_levels(c: str = "close", lengths=K.MA_BUNDLE) -> list[Level]:
    return [({}, {f"ma{i}": (c, n) for i, n in enumerate(lengths, 1)})]


def lineup_status(a: Column, b: Column, c: Column, d: Column) -> Column:
    l4 = ((a <= b) & (b <= c) & (c <= d)) | ((a >= b) & (b >= c) & (c >= d))
    l3 = ((a <= b) & (b <= c)) | ((a >= b) & (b >= c))
    l2 = (a <= b) | (a >= b)
    return (
        F.when(_false_if_null(l4), 4).when(_false_if_null(l3), 3).when(_false_if_null(l2), 2).otherwise(0)
    )
