"""Signal machines, deals and alert tables over hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scalar as X
from tickloom.operators import bars as B
from tickloom.operators import indicators as I
from tickloom.operators import signals as G
from tickloom.plans import adapters as A
from tickloom.plans.registry import query
from tickloom.plans.signal_sql import LONG_OK, SHORT_OK, TR_STEP, Chain
from tickloom.session import materialise


def _codes(name, build, col, transform):
    query(name, build(Chain()).sql(f"symbol, bar, {col} AS code FROM TOP"))(
        lambda spark, d: transform(A.hourly(spark, d)).select("symbol", "bar", F.col(col).alias("code"))
    )


_codes("rsi_signal", lambda c: c.rsi_osc().osc("rsi_fast", "rsi_sig", "rsi_code", 50), "rsi_code", G.rsi_signal)
_codes("kst_signal", lambda c: c.kst().osc("kst_fast", "kst_sig", "kst_code"), "kst_code", G.kst_signal)
_codes(
    "volume_kst_signal",
    lambda c: c.kst("volume").osc("kst_fast", "kst_sig", "kst_code", 0, False),
    "kst_code",
    lambda h: G.kst_signal(h, "volume", False),
)
_codes("roc_signal", lambda c: c.roc().osc("roc_fast", "roc_sig", "roc_code"), "roc_code", G.roc_signal)
_codes(
    "rsi_band_signal",
    lambda c: c.rsi("volume", 8, "v8")
    .rma({"x": ("v8", 21)})
    .step("lag(x) OVER w AS x1, lag(x, 2) OVER w AS x2")
    .step(
        """(coalesce((x > 50 AND x1 <= 50), false) OR coalesce(x1 > 50 AND x2 <= 50, false)) AND coalesce(x >= 50, false) AS bull,
        (coalesce((x < 50 AND x1 >= 50), false) OR coalesce(x1 < 50 AND x2 >= 50, false)) AND coalesce(x < 50, false) AS bear,
        coalesce(x < 63 AND x1 >= 63, false) OR coalesce(x > 36 AND x1 <= 36, false)
          OR coalesce(x >= 50 AND x1 < 50, false) OR coalesce(x < 50 AND x1 >= 50, false) OR x IS NULL AS st,
        coalesce(x >= 50, false) AS b, coalesce(x < 50, false) AS s"""
    )
    .machine("bull", "bear", "st", "b", "s", "code"),
    "code",
    lambda h: G.rsi_band_signal(I.vol_rsi(h), short_ok=True),
)


@query(
    "signal_text",
    Chain().rsi_osc().osc("rsi_fast", "rsi_sig", "c", 50).sql(
        """symbol, bar, CASE c WHEN 5 THEN 'XU' WHEN 6 THEN 'XD' WHEN 3 THEN 'U' WHEN 4 THEN 'D' WHEN 1 THEN 'Up' WHEN 2 THEN 'Dn' ELSE 'Na' END AS txt,
        c >= 3 AS entry_exit, CASE WHEN c IN (3, 1, 6) THEN 1 WHEN c IN (4, 2, 5) THEN -1 ELSE 0 END AS num FROM TOP"""
    ),
)
def signal_text(spark, d):
    c = F.col("rsi_code")
    return G.rsi_signal(A.hourly(spark, d)).select(
        "symbol",
        "bar",
        X.decode_signal(c).alias("txt"),
        X.is_entry_exit(c).alias("entry_exit"),
        X.trend_num(c).alias("num"),
    )


@query(
    "consensus",
    Chain().rsi_osc().osc("rsi_fast", "rsi_sig", "a", 50).kst().osc("kst_fast", "kst_sig", "b").sql(
        """symbol, bar, CASE n WHEN 2 THEN 3 WHEN 1 THEN 1 WHEN -2 THEN 4 WHEN -1 THEN 2 ELSE 0 END AS code FROM (SELECT *,
        CASE WHEN a IN (3, 1, 6) THEN 1 WHEN a IN (4, 2, 5) THEN -1 ELSE 0 END + CASE WHEN b IN (3, 1, 6) THEN 1 WHEN b IN (4, 2, 5) THEN -1 ELSE 0 END AS n FROM TOP)"""
    ),
)
def consensus(spark, d):
    h = I.run_levels(A.hourly(spark, d), G.rsi_signal_levels(), G.kst_signal_levels())
    return h.select("symbol", "bar", G.consensus(F.col("rsi_code"), F.col("kst_code")).alias("code"))


@query(
    "ma_filter",
    Chain().ma_bundle().sql(
        """symbol, bar, coalesce(ma1_trend = 1 AND close >= ma2 AND ma2_trend = 1 AND ma1 >= ma2 AND close >= ma3 AND ma2 >= ma3 AND close >= ma4 AND ma3 >= ma4, false) AS long_ok,
        coalesce(ma1_trend = 2 AND close <= ma2 AND ma2_trend = 2 AND ma1 <= ma2 AND close <= ma3 AND ma2 <= ma3 AND close <= ma4 AND ma3 <= ma4, false) AS short_ok,
        coalesce(ma1_trend = 1 AND close >= ma1 AND ma2_trend = 1 AND ma1 >= ma2, false) OR coalesce(close >= ma2, false) AS side_ok FROM TOP"""
    ),
)
def ma_filter(spark, d):
    h = G.with_ma_trends(A.hourly(spark, d))
    long_ok, short_ok = G.ma_filter(lineup=4, ma=2)
    side = G.ma_side_filter(lineup=2, ma=1, is_long=True, price_ok=True)
    return h.select("symbol", "bar", long_ok.alias("long_ok"), short_ok.alias("short_ok"), side.alias("side_ok"))


def _inputs(spark, d):
    """Hourly bars with all oscillator codes and MA trends."""
    return G.signal_inputs(A.hourly(spark, d))


def _final_chain(**kw):
    return Chain().ma_bundle().signals().final(LONG_OK, SHORT_OK, **kw)


@query("final_signal", _final_chain().sql("symbol, bar, code FROM TOP"))
def final_signal(spark, d):
    return G.final_signal(_inputs(spark, d), use_vol_kst=False).select("symbol", "bar", "code")


@query(
    "final_signal_with_volume",
    _final_chain(allowed="vol_kst_code IN (1, 3) AND bar_ts >= TIMESTAMP '2024-01-05'").sql("symbol, bar, code FROM TOP"),
)
def final_signal_with_volume(spark, d):
    inside = F.col("bar_ts") >= F.lit("2024-01-05").cast("timestamp_ntz")
    return G.final_signal(_inputs(spark, d), in_window=inside).select("symbol", "bar", "code")


@query(
    "final_signal_intraday",
    _final_chain(
        allowed="true",
        forced="(hour(bar_ts) * 60 + minute(bar_ts) <= 240 OR hour(bar_ts) * 60 + minute(bar_ts) > 1260 OR hour(bar_ts) * 60 + minute(bar_ts) >= 1200)",
    ).sql("symbol, bar, code FROM TOP"),
)
def final_signal_intraday(spark, d):
    allowed, closing = G.session_flags(F.col("bar_ts"), 240, 1260, 60)
    out = G.final_signal(_inputs(spark, d), use_vol_kst=False, in_window=allowed, force_exit=closing)
    return out.select("symbol", "bar", "code")


def _finals(spark, d):
    return G.final_signal(_inputs(spark, d), use_vol_kst=False)


CONFIRM = """, f AS MATERIALIZED (SELECT symbol, bar, close, high, low, atr, code,
    lag(code) OVER w AS c1, lag(high) OVER w AS h1, lag(high, 2) OVER w AS h2, lag(low) OVER w AS l1, lag(low, 2) OVER w AS l2
  FROM TOP WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
m AS (
  SELECT symbol, bar, CAST(NULL AS DOUBLE) AS l0, CAST(NULL AS DOUBLE) AS s0, CAST(NULL AS DOUBLE) AS lf, CAST(NULL AS DOUBLE) AS sf,
    false AS act, false AS lng, false AS sht, 0 AS cc FROM f WHERE bar = 1
  UNION ALL
  SELECT symbol, bar, l0, s0, lf, sf, CASE WHEN xl OR xs THEN false ELSE act END, lng, sht,
    CASE WHEN xl THEN 5 WHEN xs THEN 6 WHEN el THEN 3 WHEN es THEN 4 WHEN lng THEN 1 WHEN sht THEN 2 ELSE 0 END
  FROM (SELECT *, code = 5 AND act AS xl, code = 6 AND act AS xs FROM (
    SELECT *, act AND (el OR pl) AS lng, act AND (es OR ps) AS sht FROM (
      SELECT *, el OR es OR pa AS act FROM (
        SELECT *, NOT pa AND coalesce(close > lf, false) AS el, NOT pa AND coalesce(close < sf, false) AS es FROM (
          SELECT *, CASE WHEN code = 5 THEN NULL WHEN t1 AND plf IS NULL THEN high ELSE plf END AS lf,
                    CASE WHEN code = 6 THEN NULL WHEN t2 AND psf IS NULL THEN low ELSE psf END AS sf FROM (
            SELECT *, NOT pa AND coalesce(close > l0, false) AS t1, NOT pa AND coalesce(close < s0, false) AS t2 FROM (
              SELECT f.*, p.act AS pa, p.lng AS pl, p.sht AS ps, p.lf AS plf, p.sf AS psf,
                CASE WHEN f.code = 5 THEN NULL WHEN f.c1 = 3 THEN greatest(f.h1, f.h2, f.high) + f.atr ELSE p.l0 END AS l0,
                CASE WHEN f.code = 6 THEN NULL WHEN f.c1 = 4 THEN least(f.l1, f.l2, f.low) - f.atr ELSE p.s0 END AS s0
              FROM m p JOIN f ON f.symbol = p.symbol AND f.bar = p.bar + 1))))))))
"""


def _confirm_sql(level: int) -> str:
    c = _final_chain().step(TR_STEP).rma({"atr": ("tr", 5)})
    body = CONFIRM.replace("TOP", c.top)
    if level == 1:
        body = body.replace("coalesce(close > lf, false) AS el", "t1 AS el").replace("coalesce(close < sf, false) AS es", "t2 AS es")
    if level == 3:
        hit = "SELECT *, NOT pa AND coalesce(close > lf, false) AS el, NOT pa AND coalesce(close < sf, false) AS es FROM ("
        body = body.replace(
            hit,
            hit.replace("lf", "lg").replace("sf", "sg")
            + """ SELECT *, CASE WHEN code = 5 THEN NULL WHEN NOT pa AND coalesce(close > lf, false) AND plg IS NULL THEN high ELSE plg END AS lg,
            CASE WHEN code = 6 THEN NULL WHEN NOT pa AND coalesce(close < sf, false) AND psg IS NULL THEN low ELSE psg END AS sg FROM (""",
        )
        body = body.replace("CAST(NULL AS DOUBLE) AS sf,", "CAST(NULL AS DOUBLE) AS sf, CAST(NULL AS DOUBLE) AS lg, CAST(NULL AS DOUBLE) AS sg,")
        body = body.replace("SELECT symbol, bar, l0, s0, lf, sf,", "SELECT symbol, bar, l0, s0, lf, sf, lg, sg,")
        body = body.replace("p.sf AS psf,", "p.sf AS psf, p.lg AS plg, p.sg AS psg,")
        body = body.replace("f.bar = p.bar + 1))", "f.bar = p.bar + 1)))")
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in c.parts) + body + " SELECT symbol, bar, cc AS code FROM m"


for _level in (1, 2, 3):
    query(f"confirm_signal_{_level}", _confirm_sql(_level))(
        lambda spark, d, n=_level: G.confirm_signal(_finals(spark, d), n).select(
            "symbol", "bar", F.col("confirmed").alias("code")
        )
    )


# --- deals -------------------------------------------------------------------------

# Deals of the RSI machine: one deal per entry, up to its exit.
DEALS = """, t0 AS (SELECT *, sum(CASE WHEN code IN (3, 4) THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS deal FROM TOP),
e AS (SELECT symbol, deal, min(bar) AS entry_bar, arg_min(close, bar) AS p, min(bar) FILTER (code IN (5, 6)) AS exit_bar FROM t0 WHERE deal > 0 GROUP BY 1, 2),
marks AS MATERIALIZED (SELECT t0.*, e.p, e.entry_bar, CASE WHEN code IN (1, 3, 5) THEN (close - p) * 100 / nullif(p, 0) ELSE (p - close) * 100 / nullif(close, 0) END AS profit
  FROM t0 JOIN e USING (symbol, deal) WHERE code <> 0 AND bar <= coalesce(exit_bar, bar)),
ledger AS MATERIALIZED (SELECT symbol, CAST(deal AS BIGINT) AS deal, min(bar) AS entry_bar, max(bar) AS last_bar, any_value(p) AS entry, arg_max(profit, bar) AS profit,
  greatest(max(profit), 0) AS max_profit, bool_or(code IN (5, 6)) AS closed FROM marks GROUP BY 1, 2),
stats AS MATERIALIZED (SELECT s.symbol, count(deal) AS deals, count(*) FILTER (profit >= 0) AS wins, coalesce(sum(max_profit), 0) AS total_max_profit
  FROM (SELECT DISTINCT symbol FROM hourly) s LEFT JOIN ledger USING (symbol) GROUP BY 1)"""


def _rsi_deals_sql(select: str) -> str:
    c = Chain().rsi_osc().osc("rsi_fast", "rsi_sig", "code", 50)
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in c.parts) + DEALS.replace("TOP", c.top) + f" SELECT {select}"


def _rsi_bars(spark, d):
    return G.rsi_signal(A.hourly(spark, d), out="code")


@query("deal_marks", _rsi_deals_sql(
    "symbol, bar, p AS entry, profit, greatest(max(profit) OVER (PARTITION BY symbol, deal ORDER BY bar ROWS UNBOUNDED PRECEDING), 0) AS max_profit FROM marks"
), r="entry profit max_profit")
def deal_marks(spark, d):
    m = G.deal_marks(_rsi_bars(spark, d)).filter("in_deal")
    return m.select("symbol", "bar", "entry", "profit", "max_profit")


@query("deal_ledger", _rsi_deals_sql("* FROM ledger"), r="entry profit max_profit")
def deal_ledger(spark, d):
    return G.deal_ledger(_rsi_bars(spark, d))


@query("deal_stats", _rsi_deals_sql("* FROM stats"), r="total_max_profit")
def deal_stats(spark, d):
    bars = _rsi_bars(spark, d)
    symbols = A.ticks(spark, d).select("symbol").distinct()
    return G.deal_stats(G.deal_ledger(bars), symbols)


STATS_TABLE = """symbol, CAST(g AS INT) AS is_total, CAST(deals AS BIGINT) AS deals, round(mp, 2) AS total_max_profit,
  round(CASE WHEN deals = 0 THEN 0 ELSE mp / deals END, 2) AS avg_max_profit, round(CASE WHEN deals = 0 THEN 0 ELSE wins / deals END, 2) AS win_rate
  FROM (SELECT symbol, 0 AS g, deals, wins, total_max_profit AS mp FROM stats
        UNION ALL SELECT 'Total', 1, sum(deals), sum(wins), sum(total_max_profit) FROM stats)"""


@query("stats_table", _rsi_deals_sql(STATS_TABLE), r="total_max_profit avg_max_profit win_rate")
def stats_table(spark, d):
    bars = _rsi_bars(spark, d)
    symbols = A.ticks(spark, d).select("symbol").distinct()
    out = G.stats_table(G.deal_stats(G.deal_ledger(bars), symbols))
    return out.withColumn("is_total", F.col("is_total").cast("int"))


@query("last_signal_time", Chain().rsi_osc().osc("rsi_fast", "rsi_sig", "code", 50).sql(
    "symbol, bar, last_value(CASE WHEN code >= 3 THEN bar_ts END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS signal_ts FROM TOP"
))
def last_signal_time(spark, d):
    return B.last_signal_time(_rsi_bars(spark, d)).select("symbol", "bar", "signal_ts")


SCAN = """, last AS (SELECT * FROM (SELECT *, max(bar) OVER (PARTITION BY symbol) AS mb,
    last_value(CASE WHEN code >= 3 THEN bar_ts END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS signal_ts FROM TOP) WHERE bar = mb),
lm AS (SELECT symbol, bar, p, profit, greatest(max(profit) OVER (PARTITION BY symbol, deal ORDER BY bar ROWS UNBOUNDED PRECEDING), 0) AS mp FROM marks),
scan AS MATERIALIZED (SELECT l.symbol, l.bar, l.code, CASE WHEN l.code IN (5, 6) THEN 0 ELSE coalesce(m.p, 0) END AS entry, l.close AS ltp,
  round(CASE WHEN l.code IN (5, 6) THEN 0 ELSE coalesce(m.profit, 0) END, 2) AS profit,
  round(CASE WHEN l.code IN (5, 6) THEN 0 ELSE coalesce(m.mp, 0) END, 2) AS max_profit, l.signal_ts,
  CASE WHEN coalesce((ma1<=ma2 AND ma2<=ma3 AND ma3<=ma4) OR (ma1>=ma2 AND ma2>=ma3 AND ma3>=ma4), false) THEN 4
        WHEN coalesce((ma1<=ma2 AND ma2<=ma3) OR (ma1>=ma2 AND ma2>=ma3), false) THEN 3
        WHEN coalesce(ma1<=ma2 OR ma1>=ma2, false) THEN 2 ELSE 0 END AS lineup
  FROM last l LEFT JOIN lm m USING (symbol, bar))"""


def _scan_sql(select: str) -> str:
    c = Chain().ma_bundle().rsi_osc().osc("rsi_fast", "rsi_sig", "code", 50)
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in c.parts) + (DEALS + SCAN).replace("TOP", c.top) + f" SELECT {select}"


def _scan(spark, d):
    h = I.run_levels(A.hourly(spark, d), I.ma_bundle_levels(), G.rsi_signal_levels(out="code"))
    return G.scan_signals(h)


@query("scan_signals", _scan_sql("* FROM scan"), r="entry ltp profit max_profit")
def scan_signals(spark, d):
    return _scan(spark, d)


STRENGTH = "CAST(CASE WHEN max_profit = 0 THEN 100 ELSE greatest(floor((1 - (max_profit - profit) / max_profit) * 100 + 0.5::DOUBLE), 0) END AS INT)"


@query(
    "alert_table",
    _scan_sql(f"* FROM (SELECT *, {STRENGTH} AS strength FROM scan WHERE code <> 0) WHERE profit > -0.1 AND strength > 10 ORDER BY signal_ts DESC NULLS LAST, symbol LIMIT 40"),
    r="entry ltp profit max_profit",
)
def alert_table(spark, d):
    return G.alert_table(_scan(spark, d), 40, exclude_losses=True, exclude_weak=True)


@query(
    "gate_alerts",
    _scan_sql(
        "symbol, code, signal_ts FROM scan, (SELECT max(bar_ts) AS now FROM hourly) "
        "WHERE code >= 3 AND symbol NOT IN ('T1', 'T2') AND coalesce(signal_ts, now) = now"
    ),
)
def gate_alerts(spark, d):
    """Fresh means on the newest bar that any symbol has."""
    now = A.hourly(spark, d).agg(F.max("bar_ts")).scalar()
    alerts = G.gate_alerts(_scan(spark, d), "60", ["60", "240"], now, ["T1", "T2"], show_commodity=False)
    return alerts.select("symbol", "code", "signal_ts")


@query(
    "vol_osc_scan",
    A.desk_sql(Chain().roc("volume", "v").osc("v_fast", "v_sig", "vosc_code", 0, False).roc("close", "p").osc("p_fast", "p_sig", "posc_code").sql(
        """symbol, v_fast AS vosc, p_fast AS posc, posc_code, vosc_code <> 0 AS vosc_active, signal_ts FROM (SELECT *, max(bar) OVER (PARTITION BY symbol) AS mb,
        last_value(CASE WHEN posc_code >= 3 THEN bar_ts END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS signal_ts
        FROM TOP) WHERE bar = mb AND posc_code <> 0"""
    )),
    r="vosc posc",
)
def vol_osc_scan(spark, d):
    return G.vol_osc_scan(A.desk_hourly(spark, d), sort="posc")


@query(
    "trend_panel",
    Chain().signals().sql(
        """symbol, floor(rsi_fast + 0.5::DOUBLE) AS rsi, {d_rsi} AS rsi_state, floor(kst_fast * 10 + 0.5::DOUBLE) / 10 AS kst, {d_kst} AS kst_state,
        floor(vol_kst_fast * 10 + 0.5::DOUBLE) / 10 AS vol_kst, CASE WHEN vol_kst_code IN (1, 3) THEN {d_kst} END AS vol_kst_state
        FROM (SELECT *, max(bar) OVER (PARTITION BY symbol) AS mb FROM TOP) WHERE bar = mb""".format(
            **{
                f"d_{k}": f"CASE {k}_code WHEN 5 THEN 'XU' WHEN 6 THEN 'XD' WHEN 3 THEN 'U' WHEN 4 THEN 'D' WHEN 1 THEN 'Up' WHEN 2 THEN 'Dn' ELSE 'Na' END"
                for k in ("rsi", "kst")
            }
        )
    ),
    r="rsi kst vol_kst",
)
def trend_panel(spark, d):
    return G.trend_panel(A.hourly(spark, d))


@query(
    "clean_symbol_list",
    """SELECT symbol, min(p_partkey) AS pos FROM (SELECT trim(upper(p_type) || CASE WHEN p_size > 25 THEN ' ' ELSE '' END) AS symbol, p_partkey FROM part)
    WHERE symbol <> '' GROUP BY 1""",
)
def clean_symbol_list(spark, d):
    p = A.table(spark, d, "part").select(
        F.concat(F.upper("p_type"), F.when(F.col("p_size") > 25, " ").otherwise("")).alias("symbol"),
        F.col("p_partkey").alias("pos"),
    )
    return G.clean_symbol_list(p)


@query(
    "alert_payload",
    Chain().rsi_osc().osc("rsi_fast", "rsi_sig", "c", 50).sql(
        """symbol, bar, CASE c WHEN 5 THEN 'XU' WHEN 6 THEN 'XD' WHEN 3 THEN 'U' WHEN 4 THEN 'D' END AS text,
        '{"basket_id":"' || CASE c WHEN 3 THEN 'L' WHEN 5 THEN 'XL' WHEN 4 THEN 'S' ELSE 'XS' END || n_nationkey || '"}' AS payload
        FROM TOP JOIN nation ON symbol = 'T' || n_nationkey WHERE c >= 3"""
    ),
)
def alert_payload(spark, d):
    n = A.table(spark, d, "nation")
    key = F.col("n_nationkey").cast("string")
    routes = n.select(
        F.concat(F.lit("T"), key).alias("symbol"),
        *[
            F.concat(F.lit(p), key).alias(c)
            for p, c in (("L", "long_id"), ("XL", "exit_long_id"), ("S", "short_id"), ("XS", "exit_short_id"))
        ],
    )
    return G.alert_payload(_rsi_bars(spark, d), routes)
