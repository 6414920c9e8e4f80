"""Market structure over hourly bars (swing 20, internal 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.statescan import scan_states, step_map
from tickloom.operators import structure as M
from tickloom.plans import adapters as A
from tickloom.plans.registry import query
from tickloom.plans.signal_sql import TR_STEP, Chain
from tickloom.session import materialise

SIZES = {"swing": 20, "internal": 5}


def _h(spark, d):
    return A.hourly(spark, d)


def _pivots(c: Chain, n: int, p: str) -> Chain:
    c.step(
        f"CASE WHEN lag(high, {n}) OVER w > max(high) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) THEN 0 "
        f"WHEN lag(low, {n}) OVER w < min(low) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) THEN 1 END AS {p}_l"
    )
    c.step(f"coalesce(last_value({p}_l IGNORE NULLS) OVER g, 0) AS {p}_leg")
    c.step(
        f"CASE WHEN {p}_leg - lag({p}_leg) OVER w = -1 THEN lag(high, {n}) OVER w END AS {p}_nh, "
        f"CASE WHEN {p}_leg - lag({p}_leg) OVER w = 1 THEN lag(low, {n}) OVER w END AS {p}_nl"
    )
    return c.step(
        f"last_value({p}_nh IGNORE NULLS) OVER g AS {p}_h, last_value({p}_nl IGNORE NULLS) OVER g AS {p}_lo, "
        f"count({p}_nh) OVER g AS {p}_hid, count({p}_nl) OVER g AS {p}_lid"
    )


def _struct_chain(confluence: bool = False) -> Chain:
    c = Chain().step(TR_STEP).rma({"atr": ("tr", 200)})
    c.step(
        "CASE WHEN coalesce(high - low >= 2 * atr, false) THEN low ELSE high END AS p_high, "
        "CASE WHEN coalesce(high - low >= 2 * atr, false) THEN high ELSE low END AS p_low"
    )
    _pivots(_pivots(c, 20, "s"), 5, "i")
    for p in "si":
        extra_h = "true" if p == "s" else "coalesce(i_h <> s_h, false)"
        extra_l = "true" if p == "s" else "coalesce(i_lo <> s_lo, false)"
        if p == "i" and confluence:
            extra_h += " AND high - greatest(close, open) > least(close, open - low)"
            extra_l += " AND high - greatest(close, open) < least(close, open - low)"
        c.step(
            f"coalesce(close > {p}_h AND lag(close) OVER w <= lag({p}_h) OVER w, false) AND {extra_h} AS {p}_cu, "
            f"coalesce(close < {p}_lo AND lag(close) OVER w >= lag({p}_lo) OVER w, false) AND {extra_l} AS {p}_cd"
        )
    for p, n in (("s", 20), ("i", 5)):
        c.parts.append(
            f"""br0_{p} AS (
  SELECT symbol, {p}_hid AS id, 1 AS bias, min(bar) AS bar, arg_min({p}_h, bar) AS level FROM {c.top} WHERE {p}_cu GROUP BY 1, 2
  UNION ALL SELECT symbol, {p}_lid, -1, min(bar), arg_min({p}_lo, bar) FROM {c.top} WHERE {p}_cd GROUP BY 1, 2),
br_{p} AS MATERIALIZED (SELECT *, CASE WHEN lag(bias) OVER (PARTITION BY symbol ORDER BY bar, bias DESC) = -bias THEN 'CHoCH' ELSE 'BOS' END AS tag FROM br0_{p}),
st_{p} AS (SELECT symbol, {p}_hid AS id, 1 AS bias, min(bar) - {n} AS pb FROM {c.top} WHERE {p}_nh IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT symbol, {p}_lid, -1, min(bar) - {n} FROM {c.top} WHERE {p}_nl IS NOT NULL GROUP BY 1, 2),
ob_{p} AS MATERIALIZED (SELECT b.symbol, b.bar, b.bias,
    CASE WHEN b.bias = 1 THEN arg_min(x.bar, (x.p_low, x.bar)) ELSE arg_max(x.bar, (x.p_high, -x.bar)) END AS block_bar,
    CASE WHEN b.bias = 1 THEN arg_min(x.p_high, (x.p_low, x.bar)) ELSE arg_max(x.p_high, (x.p_high, -x.bar)) END AS top,
    CASE WHEN b.bias = 1 THEN arg_min(x.p_low, (x.p_low, x.bar)) ELSE arg_max(x.p_low, (x.p_high, -x.bar)) END AS bottom
  FROM br_{p} b JOIN st_{p} s USING (symbol, id, bias) JOIN {c.top} x ON x.symbol = b.symbol AND x.bar >= s.pb AND x.bar < b.bar
  GROUP BY b.symbol, b.bar, b.bias)"""
        )
    return c


GAPS = """gaps AS MATERIALIZED (SELECT symbol, bar, CASE WHEN bull THEN 1 ELSE -1 END AS bias, CASE WHEN bull THEN low ELSE high END AS top,
    CASE WHEN bull THEN h2 ELSE l2 END AS bottom FROM (
  SELECT *, low > h2 AND c1 > h2 AND d > t AS bull, high < l2 AND c1 < l2 AND -d > t AS bear FROM (
    SELECT *, sum(abs(d)) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) / (bar - 1) * 2 AS t FROM (
      SELECT symbol, bar, high, low, lag(close) OVER w AS c1, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2,
        (lag(close) OVER w - lag(open) OVER w) / nullif(lag(open) OVER w * 100, 0) AS d
      FROM hourly WINDOW w AS (PARTITION BY symbol ORDER BY bar)))) WHERE bull OR bear)"""


def _pv(n: int) -> str:
    return (
        "x.* FROM (SELECT symbol, bar, bar - {n} AS pivot_bar, 'high' AS side, p_nh AS level FROM TOP WHERE p_nh IS NOT NULL "
        "UNION ALL SELECT symbol, bar, bar - {n}, 'low', p_nl FROM TOP WHERE p_nl IS NOT NULL) x"
    ).format(n=n)


@query("legs", _pivots(Chain(), 5, "p").sql("symbol, bar, p_leg AS leg FROM TOP"))
def legs(spark, d):
    return M.legs(_h(spark, d), 5).select("symbol", "bar", "leg")


for _n, _name in ((20, "swing"), (5, "internal")):
    query(f"pivots_{_name}", _pivots(Chain(), _n, "p").sql(_pv(_n)))(lambda spark, d, n=_n: M.pivots(_h(spark, d), n))


@query(
    "pivot_labels",
    _pivots(Chain(), 5, "p").sql(
        """symbol, bar, side, CASE WHEN side = 'high' THEN CASE WHEN coalesce(level > was, false) THEN 'HH' ELSE 'LH' END
        ELSE CASE WHEN coalesce(level < was, false) THEN 'LL' ELSE 'HL' END END AS label
        FROM (SELECT *, lag(level) OVER (PARTITION BY symbol, side ORDER BY bar) AS was FROM (SELECT """
        + _pv(5)
        + "))"
    ),
)
def pivot_labels(spark, d):
    return M.label_pivots(M.pivots(_h(spark, d), 5)).select("symbol", "bar", "side", "label")


EQUAL = """symbol, bar, CASE WHEN side = 'high' THEN 'EQH' ELSE 'EQL' END AS label, level FROM (SELECT e.*, t.atr,
    lag(e.level) OVER (PARTITION BY e.symbol, side ORDER BY e.bar) AS was FROM (SELECT """ + _pv(5) + """) e JOIN TOP t USING (symbol, bar))
    WHERE abs(was - level) < 0.2::DOUBLE * atr"""


@query("equal_levels", A.desk_sql(_pivots(Chain().step(TR_STEP).rma({"atr": ("tr", 200)}), 5, "p").sql(EQUAL)))
def equal_levels(spark, d):
    return M.equal_levels(A.desk_hourly(spark, d))


for _p, _kind in (("s", "swing"), ("i", "internal")):
    query(f"structure_breaks_{_kind}", _struct_chain().sql(f"symbol, bar, bias, tag, level FROM br_{_p}"))(
        lambda spark, d, k=_kind: M.structure_breaks(_h(spark, d), k, **SIZES)
    )
    query(f"order_blocks_{_kind}", _struct_chain().sql(f"* FROM ob_{_p}"), r="top bottom")(
        lambda spark, d, k=_kind: M.order_blocks(_h(spark, d), k, **SIZES)
    )


@query("structure_breaks_confluence", A.desk_sql(_struct_chain(True).sql("symbol, bar, bias, tag, level FROM br_i")))
def structure_breaks_confluence(spark, d):
    return M.structure_breaks(A.desk_hourly(spark, d), "internal", use_confluence=True, **SIZES)


def _blocks(spark, d):
    bars = materialise(_h(spark, d), "hourly")
    return M.order_blocks(bars, "internal", **SIZES), bars


LATER = """WHERE {neg} EXISTS (SELECT 1 FROM hourly h WHERE h.symbol = z.symbol AND h.bar {op} z.bar AND
  CASE WHEN z.bias = 1 THEN h.low < z.bottom ELSE h.high > z.top END)"""


@query(
    "open_order_blocks",
    _struct_chain().sql(
        "symbol, bar, bias, block_bar, top, bottom FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar DESC, bias, block_bar) AS n FROM ob_i z "
        + LATER.format(neg="NOT", op=">=")
        + ") WHERE n <= 5"
    ),
    r="top bottom",
)
def open_order_blocks(spark, d):
    blocks, bars = _blocks(spark, d)
    return M.open_order_blocks(blocks, bars, top=5)


MITIGATED = """(SELECT z.symbol, z.bar, z.bias, z.top, z.bottom, min(h.bar) AS mitigated_bar FROM {z} z JOIN hourly h
  ON h.symbol = z.symbol AND h.bar {op} z.bar AND CASE WHEN z.bias = 1 THEN h.low < z.bottom ELSE h.high > z.top END
  GROUP BY 1, 2, 3, 4, 5)"""


@query(
    "order_block_mitigation",
    _struct_chain().sql("* FROM " + MITIGATED.format(z="ob_i", op=">=")),
    r="top bottom",
)
def order_block_mitigation(spark, d):
    return M.mitigation_bars(*_blocks(spark, d))


@query("fair_value_gaps", f"WITH {A.HOURLY_SQL}, {GAPS} SELECT * FROM gaps", r="top bottom")
def fair_value_gaps(spark, d):
    return M.fair_value_gaps(_h(spark, d))


@query(
    "open_gaps",
    f"WITH {A.HOURLY_SQL}, {GAPS} SELECT * FROM gaps z " + LATER.format(neg="NOT", op=">"),
    r="top bottom",
)
def open_gaps(spark, d):
    bars = materialise(_h(spark, d), "hourly")
    return M.open_gaps(M.fair_value_gaps(bars), bars)


@query(
    "gap_mitigation",
    f"WITH {A.HOURLY_SQL}, {GAPS} SELECT * FROM " + MITIGATED.format(z="gaps", op=">"),
    r="top bottom",
)
def gap_mitigation(spark, d):
    bars = materialise(_h(spark, d), "hourly")
    return M.mitigation_bars(M.fair_value_gaps(bars), bars, from_next=True)


# Extremes: per bar, the last pivot confirmed before it and the bars since.
EXTREMES = """, e1 AS (SELECT symbol, bar, high, low, lag(s_h) OVER w AS lh, lag(s_lo) OVER w AS ll,
    max(CASE WHEN s_nh IS NOT NULL THEN bar END) OVER p AS ch, max(CASE WHEN s_nl IS NOT NULL THEN bar END) OVER p AS cl
  FROM TOP WINDOW w AS (PARTITION BY symbol ORDER BY bar), p AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ext AS MATERIALIZED (SELECT a.symbol, a.bar, CASE WHEN a.lh IS NOT NULL THEN greatest(a.lh, max(b.high)) END AS top
  FROM e1 a LEFT JOIN e1 b ON a.symbol = b.symbol AND b.bar > coalesce(a.ch, 0) AND b.bar <= a.bar GROUP BY a.symbol, a.bar, a.lh),
exl AS MATERIALIZED (SELECT a.symbol, a.bar, CASE WHEN a.ll IS NOT NULL THEN least(a.ll, min(b.low)) END AS bottom
  FROM e1 a LEFT JOIN e1 b ON a.symbol = b.symbol AND b.bar > coalesce(a.cl, 0) AND b.bar <= a.bar GROUP BY a.symbol, a.bar, a.ll),
bb AS (SELECT a.symbol, a.bar, arg_max(b.bias, (b.bar, -b.bias)) AS bias FROM e1 a JOIN br_s b ON a.symbol = b.symbol AND b.bar < a.bar GROUP BY 1, 2),
extremes AS MATERIALIZED (SELECT symbol, bar, top, bottom, CASE WHEN bias = -1 THEN 'Strong High' ELSE 'Weak High' END AS top_label,
  CASE WHEN bias = 1 THEN 'Strong Low' ELSE 'Weak Low' END AS bottom_label FROM ext JOIN exl USING (symbol, bar) LEFT JOIN bb USING (symbol, bar))"""


def _ext_sql(select: str) -> str:
    c = _struct_chain()
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in c.parts) + EXTREMES.replace("TOP", c.top) + f" SELECT {select}"


@query("trailing_extremes", _ext_sql("* FROM extremes"), r="top bottom")
def trailing_extremes(spark, d):
    return M.trailing_extremes(_h(spark, d), **SIZES).drop("top_bar", "bottom_bar")


EXTREME_BARS = """, xb AS MATERIALIZED (SELECT e.symbol, e.bar, e.ch, e.cl, x.top, l.bottom, CASE WHEN x.top = e.high THEN e.bar END AS th, CASE WHEN l.bottom = e.low THEN e.bar END AS tl
  FROM e1 e JOIN ext x USING (symbol, bar) JOIN exl l USING (symbol, bar))
SELECT a.symbol, a.bar, coalesce(CASE WHEN a.top IS NOT NULL THEN coalesce(max(b.th) FILTER (b.bar > coalesce(a.ch, 0)), a.ch - 20) END, -1) AS top_bar,
  coalesce(CASE WHEN a.bottom IS NOT NULL THEN coalesce(max(b.tl) FILTER (b.bar > coalesce(a.cl, 0)), a.cl - 20) END, -1) AS bottom_bar
FROM xb a JOIN xb b ON a.symbol = b.symbol AND b.bar <= a.bar GROUP BY a.symbol, a.bar, a.top, a.bottom, a.ch, a.cl"""


@query("trailing_extreme_bars", _ext_sql("1").removesuffix(" SELECT 1") + EXTREME_BARS)
def trailing_extreme_bars(spark, d):
    return M.trailing_extremes(_h(spark, d), **SIZES).select(
        "symbol",
        "bar",
        F.coalesce("top_bar", F.lit(-1)).alias("top_bar"),
        F.coalesce("bottom_bar", F.lit(-1)).alias("bottom_bar"),
    )


@query(
    "price_zones",
    _ext_sql(
        """symbol, bar, top AS premium_top, 0.95 * top + 0.05 * bottom AS premium_bottom, 0.525 * top + 0.475 * bottom AS equilibrium_top,
        (top + bottom) / 2 AS equilibrium, 0.525 * bottom + 0.475 * top AS equilibrium_bottom, 0.95 * bottom + 0.05 * top AS discount_top,
        bottom AS discount_bottom FROM extremes WHERE top IS NOT NULL AND bottom IS NOT NULL"""
    ),
    r="premium_top premium_bottom equilibrium_top equilibrium equilibrium_bottom discount_top discount_bottom",
)
def price_zones(spark, d):
    return M.price_zones(M.trailing_extremes(_h(spark, d), **SIZES))


@query(
    "internal_bias",
    _struct_chain().sql(
        "a.symbol, a.bar, coalesce(arg_max(b.bias, (b.bar, -b.bias)), 0) AS bias FROM TOP a LEFT JOIN br_i b ON a.symbol = b.symbol AND b.bar <= a.bar GROUP BY 1, 2"
    ),
)
def internal_bias(spark, d):
    return M.internal_bias(_h(spark, d), **SIZES)


def _flags_sql() -> str:
    c = _pivots(_struct_chain(), 5, "p")
    kinds = []
    for p, kind in (("i", "internal"), ("s", "swing")):
        kinds.append(f"SELECT symbol, bar, '{kind}_' || CASE WHEN bias = 1 THEN 'bullish_' ELSE 'bearish_' END || lower(tag) AS flag FROM br_{p}")
        kinds.append(
            f"SELECT symbol, mitigated_bar, '{kind}_' || CASE WHEN bias = 1 THEN 'bullish_block' ELSE 'bearish_block' END FROM "
            + MITIGATED.format(z=f"ob_{p}", op=">=")
        )
    kinds.append("SELECT symbol, bar, CASE WHEN bias = 1 THEN 'bullish_gap' ELSE 'bearish_gap' END FROM gaps")
    kinds.append("SELECT symbol, bar, CASE WHEN label = 'EQH' THEN 'equal_highs' ELSE 'equal_lows' END FROM (SELECT " + EQUAL.replace("TOP", c.top) + ")")
    flags = ", ".join(f"bool_or(flag = '{f}') AS {f}" for f in M.FLAGS)
    return (
        "WITH RECURSIVE " + ",\n".join(p.strip() for p in c.parts) + ", " + GAPS
        + f" SELECT symbol, bar, {flags} FROM (" + " UNION ALL ".join(kinds) + ") GROUP BY 1, 2"
    )


@query("structure_flags", _flags_sql())
def structure_flags(spark, d):
    return M.structure_flags(materialise(_h(spark, d), "hourly"), **SIZES)


# A position: entered flat on a strong bar, left on any bar of the other side.
RAW_SQL = "CASE WHEN close > open * 1.5 THEN 3 WHEN close < open / 1.5 THEN 4 WHEN close > open THEN 1 WHEN close < open THEN 2 ELSE 0 END"
NEXT_SQL = "CASE {s} WHEN 0 THEN CASE raw WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END WHEN 1 THEN CASE WHEN raw IN (2, 4) THEN 0 ELSE 1 END ELSE CASE WHEN raw IN (1, 3) THEN 0 ELSE 2 END END"


@query(
    "positions_in_blocks",
    A.desk_sql(
        f"""WITH RECURSIVE {A.HOURLY_SQL}, raw AS MATERIALIZED (SELECT symbol, bar, {RAW_SQL} AS raw FROM hourly),
    held AS (SELECT symbol, bar, {NEXT_SQL.format(s="0")} AS pos FROM raw WHERE bar = 1
      UNION ALL SELECT r.symbol, r.bar, {NEXT_SQL.format(s="h.pos")} FROM held h JOIN raw r ON r.symbol = h.symbol AND r.bar = h.bar + 1)
    SELECT symbol, bar, pos FROM held"""
    ),
)
def positions_in_blocks(spark, d):
    """Flat (0), long (1) or short (2) after each bar: blocks of 64 bars as maps of states, composed."""
    raw = F.col("raw")
    bars = A.desk_hourly(spark, d).withColumn("raw", F.expr(RAW_SQL))
    flat = F.when(raw == 3, 1).when(raw == 4, 2).otherwise(0)
    step = step_map(flat, F.when(raw.isin(2, 4), 0).otherwise(1), F.when(raw.isin(1, 3), 0).otherwise(2))
    return scan_states(bars, "symbol", "bar", step, 3, "pos", block=64).select("symbol", "bar", "pos")
