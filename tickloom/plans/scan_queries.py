"""Surge scan, ranking and sector queries over the intraday bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.ranking import placed
from tickloom.operators import bars as B
from tickloom.operators import scan as S
from tickloom.plans import adapters as A
from tickloom.plans.registry import query
from tickloom.session import materialise


def _final(c: str, kind: str, n: int) -> str:
    if kind == "sma":
        return f"CASE WHEN max(last_bar) >= {n} THEN sum(CASE WHEN last_bar - bar < {n} THEN {c} ELSE 0 END) / {n} ELSE 0 END"
    a = f"(2.0::DOUBLE / {n + 1})" if kind == "ema" else f"(1.0::DOUBLE / {n})"
    return f"sum({c} * (CASE WHEN bar = 1 THEN 1.0::DOUBLE ELSE {a} END) * pow(1 - {a}, last_bar - bar))"


def surge_sql(kind: str = "rma", bars: str = "bars") -> str:
    return f"""ma AS (SELECT symbol, {_final('volume', kind, 8)} AS vf, {_final('volume', kind, 21)} AS vs,
  {_final('volume', kind, 89)} AS vb, {_final('price', kind, 8)} AS pf, {_final('price', kind, 21)} AS ps,
  sum(CASE WHEN bar = last_bar THEN price END) AS px FROM {bars} GROUP BY symbol),
scan AS MATERIALIZED (SELECT symbol,
  round_even(vf * 100 / (CASE WHEN vb = 0 THEN 1 ELSE vb END), 2) AS volume_fast,
  round_even(vs * 100 / (CASE WHEN vb = 0 THEN 1 ELSE vb END), 2) AS volume_slow,
  round_even(1000 * (vf - vs) / (CASE WHEN vs = 0 THEN 1 ELSE vs END), 2) AS vol_surge,
  round_even(px, 2) AS ltp,
  round_even(1000 * (pf - ps) / (CASE WHEN ps = 0 THEN 1 ELSE ps END), 2) AS price_surge,
  CAST(sign(pf - ps) AS INT) AS price_ma_action, CAST(sign(vf - vs) AS INT) AS vol_ma_action FROM ma)"""


SCAN = f"WITH {A.BARS_SQL}, {surge_sql()}"
COLS = "symbol, volume_fast, volume_slow, vol_surge, ltp, price_surge, price_ma_action, vol_ma_action"


def _scan(spark, d, kind="rma"):
    return S.surge_scan(A.base_bars(spark, d), kind)


for _kind in ("rma", "ema", "sma"):
    query(f"surge_scan_{_kind}", f"WITH {A.BARS_SQL}, {surge_sql(_kind)} SELECT {COLS} FROM scan", 2)(
        lambda spark, d, k=_kind: _scan(spark, d, k)
    )


@query(
    "surge_scan_subset",
    f"WITH {A.BARS_SQL}, {surge_sql()} SELECT {COLS} FROM scan WHERE symbol IN (SELECT 'T' || user_id FROM events WHERE value > 150)",
    2,
)
def surge_scan_subset(spark, d):
    wanted = A.ticks(spark, d).filter("price > 150").select("symbol")
    return S.surge_scan(A.base_bars(spark, d), symbols=wanted)


@query("surge_scan_15m", f"""WITH {A.BARS_SQL}, coarse0 AS (
  SELECT symbol, day, day_idx, CAST(ceil(slot / 5.0) AS INT) AS slot, max(last_bar) AS lb,
         arg_max(vol_cum, slot) AS vol_cum, arg_max(price, slot) AS price FROM bars GROUP BY 1, 2, 3, 4),
coarse AS (SELECT *, CAST((day_idx - 1) * 25 + slot AS INT) AS bar, CAST(ceil(lb / 5.0) AS INT) AS last_bar,
  CASE WHEN slot = 1 THEN vol_cum ELSE greatest(vol_cum - lag(vol_cum) OVER
    (PARTITION BY symbol, day_idx ORDER BY slot), 0) END AS volume FROM coarse0),
{surge_sql('rma', 'coarse')} SELECT {COLS} FROM scan""", 2)
def surge_scan_15m(spark, d):
    return S.surge_scan(B.rollup(A.base_bars(spark, d), 5, 125))


RANKED_SQL = f"""{SCAN},
f AS (SELECT * FROM scan WHERE ltp BETWEEN 1 AND 450),
tops AS (SELECT symbol FROM (SELECT symbol, row_number() OVER (ORDER BY volume_fast DESC, symbol) r FROM f) WHERE r <= 12
   UNION SELECT symbol FROM (SELECT symbol, row_number() OVER (ORDER BY vol_surge DESC, symbol) r FROM f) WHERE r <= 12),
r AS (SELECT f.*, row_number() OVER (ORDER BY volume_fast DESC, symbol)
        + row_number() OVER (ORDER BY vol_surge DESC, symbol) AS rank_sum FROM f WHERE symbol IN (SELECT symbol FROM tops))
"""


@query(
    "surge_ranked",
    RANKED_SQL + f"SELECT {COLS}, rank_sum, row_number() OVER (ORDER BY rank_sum, symbol) AS pos FROM r",
    2,
)
def surge_ranked(spark, d):
    rows, _ = S.filter_scan(materialise(_scan(spark, d), "scan"), "1-450")
    return S.rank_sum(S.topk_union(rows, ["volume_fast", "vol_surge"], 12), "volume_fast", "vol_surge")


@query(
    "forced_watch_list",
    RANKED_SQL
    + """, n AS (SELECT symbol, row_number() OVER (ORDER BY rank_sum, symbol) AS pos FROM r)
SELECT 0 AS part, 0 AS pos, symbol FROM (SELECT DISTINCT 'T' || user_id AS symbol FROM events WHERE value > 480)
UNION ALL SELECT 1, pos, symbol FROM n""",
)
def forced_watch_list(spark, d):
    forced = A.ticks(spark, d).filter("price > 480").select("symbol")
    return S.with_forced(surge_ranked(spark, d), forced)


@query(
    "scan_counts",
    SCAN
    + """ SELECT count(*) FILTER (price_ma_action = 1) AS positive, count(*) FILTER (price_ma_action = -1) AS negative,
    count(*) FILTER (price_ma_action = 0) AS neutral FROM scan WHERE vol_ma_action > 0""",
)
def scan_counts(spark, d):
    return S.filter_scan(_scan(spark, d), "not-a-range", volume="up")[1]


@query(
    "price_buckets",
    SCAN + " SELECT CAST((floor(ltp / 100) + 1) * 100 AS BIGINT) AS below, symbol, ltp FROM scan",
)
def price_buckets(spark, d):
    return S.price_buckets(_scan(spark, d), 100)


# Sectors of the tick symbols: users are dealt to nations, and belong to their region too.
TICK_SECTORS_SQL = """tick_sectors AS (SELECT n_name AS sector, symbol FROM dealt JOIN nation ON n_nationkey = k
  UNION SELECT r_name, symbol FROM dealt JOIN nation ON n_nationkey = k JOIN region ON n_regionkey = r_regionkey)"""
TICK_SECTORS_SQL = "dealt AS (SELECT DISTINCT 'T' || user_id AS symbol, user_id % 25 AS k FROM events), " + TICK_SECTORS_SQL


def tick_sectors(spark, d):
    user = A.table(spark, d, "events").select("user_id").distinct()
    users = user.select(F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("symbol"), (F.col("user_id") % 25).alias("n_nationkey"))
    n = users.join(A.table(spark, d, "nation"), "n_nationkey")
    r = A.table(spark, d, "region")
    narrow = n.select(F.col("n_name").alias("sector"), "symbol")
    broad = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("sector"), "symbol")
    return narrow.union(broad).distinct()


@query(
    "sector_heat",
    f"""{SCAN}, {TICK_SECTORS_SQL}
SELECT sector, avg(volume_fast) AS avg_fast, avg(volume_slow) AS avg_slow, count(*) AS n_symbols,
  arg_max(symbol, (volume_fast, symbol)) AS top_symbol, least(avg(volume_fast) / 200, 1.0) AS heat,
  row_number() OVER (ORDER BY avg(volume_fast) DESC NULLS LAST, sector) AS place
FROM tick_sectors JOIN scan USING (symbol) GROUP BY sector""", r="avg_fast avg_slow heat")
def sector_heat(spark, d):
    return placed(S.sector_heat(_scan(spark, d), tick_sectors(spark, d)))


@query(
    "sector_members",
    f"{SCAN}, {TICK_SECTORS_SQL} SELECT sector, symbol, volume_fast, volume_slow FROM tick_sectors JOIN scan USING (symbol)",
    2,
)
def sector_members(spark, d):
    return S.sector_members(_scan(spark, d), tick_sectors(spark, d))


@query(
    "sector_detail",
    f"{SCAN}, {TICK_SECTORS_SQL} SELECT {COLS} FROM scan WHERE symbol IN (SELECT symbol FROM tick_sectors WHERE sector = 'ASIA')",
    2,
)
def sector_detail(spark, d):
    sectors = tick_sectors(spark, d)
    S.require_sector(sectors, "ASIA")
    return S.sector_detail(A.base_bars(spark, d), sectors, "ASIA")


@query(
    "symbol_series",
    f"""WITH {A.BARS_SQL} SELECT bar, CAST(bar AS VARCHAR) || ': ' || strftime(t, '%d/%m_%H%M') AS label, volume, price
    FROM (SELECT *, CAST(day AS TIMESTAMP) + to_minutes(CAST(slot * 3 + 555 AS INT)) AS t FROM bars WHERE symbol = (SELECT min(symbol) FROM bars))""", r="volume price")
def symbol_series(spark, d):
    bars = materialise(A.base_bars(spark, d), "bars")
    return S.symbol_series(bars, bars.agg(F.min("symbol")).first()[0])
