"""Daily panel scores, categories, list arithmetic and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import categories as C
from tickloom.operators import compare as D
from tickloom.operators import scoring as S
from tickloom.plans import adapters as A
from tickloom.plans.registry import query

P = f"WITH {A.PANEL_SQL}"
PCT = """pct AS MATERIALIZED (SELECT *, 100.0::DOUBLE * (1.0::DOUBLE - (row_number() OVER (PARTITION BY day_idx ORDER BY value DESC, symbol) - 1)
  / count(*) OVER (PARTITION BY day_idx)) AS percentile FROM {src})"""


def _ewma_sql(src: str, span: str, out: str = "score_t", tag: str = "") -> str:
    a = f"(2.0::DOUBLE / ({span} + 1))"
    return f"""{PCT.replace('pct AS', f'pct{tag} AS').format(src=src)},
{out} AS MATERIALIZED (SELECT symbol, sum(percentile * CASE WHEN nth = 1 THEN 1.0::DOUBLE ELSE {a} END * pow(1 - {a}, n - nth)) AS score
  FROM (SELECT symbol, percentile, row_number() OVER (PARTITION BY symbol ORDER BY day_idx) AS nth,
          count(*) OVER (PARTITION BY symbol) AS n FROM pct{tag}) GROUP BY symbol)"""


@query("daily_panel", P + " SELECT symbol, day, day_idx, value, ltp FROM panel", r="value ltp", day="day")
def daily_panel(spark, d):
    return A.panel(spark, d).select("symbol", "day", "day_idx", "value", "ltp")


@query("latest_ltp", P + " SELECT symbol, arg_max(ltp, day_idx) AS last_ltp FROM panel GROUP BY 1", r="last_ltp")
def latest_ltp(spark, d):
    return S.last_ltp(A.panel(spark, d))


@query(
    "ltp_latest_filter",
    P + """ SELECT symbol, count(*) AS n FROM panel WHERE symbol IN
    (SELECT symbol FROM panel GROUP BY 1 HAVING arg_max(ltp, day_idx) BETWEEN 800 AND 2000) GROUP BY 1""",
)
def ltp_latest_filter(spark, d):
    kept = S.ltp_latest_filter(A.panel(spark, d), 800, 2000)
    return kept.groupBy("symbol").agg(F.count("*").alias("n"))


@query(
    "daily_percentile",
    P + f", {PCT.format(src='panel')} SELECT symbol, day_idx, percentile FROM pct",
    r="percentile",
)
def daily_percentile(spark, d):
    return S.daily_percentile(A.panel(spark, d)).select("symbol", "day_idx", "percentile")


@query("percentile_ewma", P + f", {_ewma_sql('panel', '10')} SELECT * FROM score_t", r="score")
def percentile_ewma(spark, d):
    return S.percentile_ewma(A.panel(spark, d), 10)


@query(
    "percentile_ewma_range",
    P + f", part AS (SELECT * FROM panel WHERE day_idx BETWEEN 101 AND 300), {_ewma_sql('part', '200')} SELECT * FROM score_t",
    r="score",
)
def percentile_ewma_range(spark, d):
    return S.percentile_ewma(A.panel(spark, d), 200, 101, 300)


@query(
    "combined_score",
    P + " SELECT symbol, 0.4 * max(value) + 0.6 * (sum(value) / (SELECT max(day_idx) FROM panel)) AS score FROM panel GROUP BY 1",
    r="score",
)
def combined_score(spark, d):
    panel = A.panel(spark, d)
    return S.combined_score(panel, 0.4, 0.6, _n_days(spark, d))


def _n_days(spark, d):
    days = A.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return days.agg(F.count_distinct("day")).scalar()


@query(
    "top_candidates",
    P + f""", {_ewma_sql('panel', '10')}
    SELECT symbol, CAST(trunc(score) AS BIGINT) AS score FROM (SELECT * FROM score_t WHERE symbol IN
      (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0) ORDER BY score DESC, symbol LIMIT 20)""",
)
def top_candidates(spark, d):
    allow = A.table(spark, d, "supplier").filter("s_acctbal > 0").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol")
    )
    return S.top_candidates(S.percentile_ewma(A.panel(spark, d), 10), 20, allow)


@query(
    "recent_overlay",
    P + f""", {_ewma_sql('panel', '(SELECT max(day_idx) FROM panel)', 'full_t', '1')},
    late AS (SELECT * FROM panel WHERE day_idx > (SELECT max(day_idx) FROM panel) - 20),
    {_ewma_sql('late', '20', 'late_t', '2')},
    best AS (SELECT symbol, score + 100 AS boosted FROM late_t ORDER BY score DESC, symbol LIMIT 15)
    SELECT symbol, coalesce(boosted, score) AS score FROM full_t FULL JOIN best USING (symbol)""",
    r="score",
)
def recent_overlay(spark, d):
    return S.recent_overlay(A.panel(spark, d), _n_days(spark, d), 20, 15)


@query(
    "topk_frequency",
    P + """ SELECT symbol, count(*) AS days_in_top FROM (SELECT symbol, row_number() OVER
    (PARTITION BY day_idx ORDER BY value DESC, symbol) AS rn FROM panel) WHERE rn <= 5 GROUP BY 1""",
)
def topk_frequency(spark, d):
    return S.topk_frequency(A.panel(spark, d), 5)


CONSISTENCY = """m AS (SELECT symbol, avg(value) AS m FROM panel GROUP BY 1),
stats AS MATERIALIZED (SELECT symbol, m AS avg_value, stddev_samp(value) AS std_value, stddev_samp(value) / m * 100 AS cv,
  count(*) FILTER (value >= 0.7::DOUBLE * m) / count(*) * 100 AS consistency,
  count(*) FILTER (value >= m * (1 - 0.3::DOUBLE) AND value <= m * (1 + 0.3::DOUBLE)) / count(*) * 100 AS stability,
  min(value) AS min_value, max(value) AS max_value, median(value) AS median_value, count(*) AS days
  FROM panel JOIN m USING (symbol) GROUP BY symbol, m HAVING count(*) >= 5)"""
STATS = "avg_value std_value cv consistency stability min_value max_value median_value"


@query("volume_consistency", f"{P}, {CONSISTENCY} SELECT * FROM stats", r=STATS)
def volume_consistency(spark, d):
    return S.volume_consistency(A.panel(spark, d))


@query(
    "consistent_symbols",
    f"{P}, {CONSISTENCY} SELECT * FROM stats WHERE cv < 65 AND consistency > 60 AND stability > 25",
    r=STATS,
)
def consistent_symbols(spark, d):
    return S.consistent_symbols(S.volume_consistency(A.panel(spark, d)), 65, 60, 25)


@query(
    "consistency_averages",
    f"{P}, {CONSISTENCY} SELECT avg(cv) AS cv, avg(consistency) AS consistency, avg(stability) AS stability FROM stats",
    r="cv consistency stability",
)
def consistency_averages(spark, d):
    return S.consistency_averages(S.volume_consistency(A.panel(spark, d)))


@query("most_consistent", f"{P}, {CONSISTENCY} SELECT * FROM stats ORDER BY cv, symbol LIMIT 10", r=STATS)
def most_consistent(spark, d):
    return S.most_consistent(S.volume_consistency(A.panel(spark, d)), 10)


@query(
    "percentile_report",
    P + f", {_ewma_sql('panel', '10')} SELECT symbol, score, avg_value FROM score_t JOIN (SELECT symbol, avg(value) AS avg_value FROM panel GROUP BY 1) USING (symbol)",
    r="score avg_value",
)
def percentile_report(spark, d):
    return S.percentile_report(A.panel(spark, d))


@query(
    "threshold_list",
    P + " SELECT symbol, day_idx, value FROM panel WHERE ltp >= 1200 AND value >= 60",
    r="value",
)
def threshold_list(spark, d):
    return S.threshold_list(A.panel(spark, d), 1200, 60).select("symbol", "day_idx", "value")


@query(
    "dedup_max",
    P + " SELECT symbol, max(value) AS score FROM panel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    r="score",
)
def dedup_max(spark, d):
    return S.dedup_max(A.panel(spark, d).select("symbol", F.col("value").alias("score")), 25)


# --- categories -------------------------------------------------------------------

M = f"WITH {A.MEMBERS_SQL}, syms AS (SELECT DISTINCT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem UNION SELECT 'T' || CAST(user_id AS VARCHAR) FROM events)"
ASSIGN_MULTI = """assigned AS (SELECT symbol, coalesce(index_name, 'OTHERS') AS category
  FROM syms LEFT JOIN (SELECT DISTINCT index_name, symbol FROM members) USING (symbol))"""
ASSIGN_EXCL = """sizes AS (SELECT index_name, count(DISTINCT symbol) AS n, min(list_pos) AS pos FROM members GROUP BY 1),
best AS (SELECT symbol, index_name FROM (SELECT symbol, index_name, row_number() OVER (PARTITION BY symbol ORDER BY n, pos) AS rn
  FROM members JOIN sizes USING (index_name)) WHERE rn = 1),
assigned AS (SELECT symbol, coalesce(index_name, 'OTHERS') AS category FROM syms LEFT JOIN best USING (symbol))"""


def _universe(spark, d):
    s = A.table(spark, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"))
    t = A.table(spark, d, "events").select(F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("symbol"))
    return s.union(t).distinct()


@query("categories_multi", f"{M}, {ASSIGN_MULTI} SELECT * FROM assigned")
def categories_multi(spark, d):
    return C.assign_categories(_universe(spark, d), A.index_members(spark, d), False)


@query("categories_exclusive", f"{M}, {ASSIGN_EXCL} SELECT * FROM assigned")
def categories_exclusive(spark, d):
    return C.assign_categories(_universe(spark, d), A.index_members(spark, d), True)


@query(
    "categories_priority",
    f"""{M}, best AS (SELECT symbol, arg_min(index_name, -list_pos) AS index_name FROM members GROUP BY 1)
    SELECT symbol, coalesce(index_name, 'OTHERS') AS category FROM syms LEFT JOIN best USING (symbol)""",
)
def categories_priority(spark, d):
    members = A.index_members(spark, d)
    rank = members.groupBy("index_name").agg((-F.min("list_pos")).alias("rank"))
    return C.assign_categories(_universe(spark, d), members, True, rank)


@query(
    "category_counts",
    f"""{M}, {ASSIGN_EXCL} SELECT category, count(*) AS n FROM assigned GROUP BY 1
    UNION ALL SELECT 'TOTAL', count(*) FROM assigned""",
)
def category_counts(spark, d):
    return C.category_counts(C.assign_categories(_universe(spark, d), A.index_members(spark, d), True))


# The names of all lists in the given tables.
NAMES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", *(f"NATION_{i}" for i in range(25)), "OTHERS"]


@query(
    "category_matrix",
    f"""{M}, {ASSIGN_MULTI}, placed AS (SELECT category, symbol, row_number() OVER (PARTITION BY category ORDER BY symbol) AS row FROM assigned)
    SELECT row, """
    + ", ".join(f"""coalesce(max(symbol) FILTER (category = '{c}'), '') AS "{c}\"""" for c in NAMES)
    + " FROM placed GROUP BY row",
)
def category_matrix(spark, d):
    members = A.index_members(spark, d)
    # The names of the lists are the columns, so there are as many as someone reads.
    names = [r["index_name"] for r in members.select("index_name").distinct().orderBy("index_name").collect()]
    return C.category_matrix(C.assign_categories(_universe(spark, d), members, False), [*names, "OTHERS"])


@query(
    "constituent_universe",
    f"{M} SELECT symbol FROM (SELECT 'T' || CAST(user_id AS VARCHAR) AS symbol FROM events) UNION SELECT symbol FROM members",
)
def constituent_universe(spark, d):
    t = A.table(spark, d, "events").select(F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("symbol"))
    return C.with_all_constituents(t, A.index_members(spark, d))


@query(
    "constituent_summary",
    f"{M} SELECT index_name, count(*) AS n FROM members GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*) FROM members",
)
def constituent_summary(spark, d):
    return C.constituent_summary(A.index_members(spark, d))


def _buyers(spark, d, status):
    o = A.table(spark, d, "orders").filter(F.col("o_orderstatus") == status)
    return o.select(F.col("o_custkey").cast("string").alias("symbol"))


@query(
    "intersect_lists",
    "SELECT CAST(o_custkey AS VARCHAR) AS symbol FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F'",
)
def intersect_lists(spark, d):
    return C.intersect_lists(_buyers(spark, d, "O"), _buyers(spark, d, "F"))


@query(
    "union_lists",
    "SELECT CAST(o_custkey AS VARCHAR) AS symbol FROM orders WHERE o_orderstatus = 'O' UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F'",
)
def union_lists(spark, d):
    return C.union_lists(_buyers(spark, d, "O"), _buyers(spark, d, "F"))


@query(
    "tag_exchange",
    """SELECT c_custkey, symbol, coalesce(exch, '') AS exch FROM (SELECT c_custkey, c_mktsegment AS symbol FROM customer)
    LEFT JOIN (SELECT symbol, arg_min(exch, list_pos) AS exch FROM (
      SELECT c_mktsegment AS symbol, 'R' || n_regionkey AS exch, min(c_custkey) AS list_pos
      FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 GROUP BY 1, 2) GROUP BY 1) USING (symbol)""",
)
def tag_exchange(spark, d):
    c = A.table(spark, d, "customer")
    n = A.table(spark, d, "nation")
    lists = (
        c.filter("c_acctbal < 0")
        .join(n, c.c_nationkey == n.n_nationkey)
        .groupBy(F.col("c_mktsegment").alias("symbol"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("exch"))
        .agg(F.min("c_custkey").alias("list_pos"))
    )
    tagged = C.tag_exchange(c.select("c_custkey", F.col("c_mktsegment").alias("symbol")), lists)
    return tagged.select("c_custkey", "symbol", F.coalesce("exch", F.lit("")).alias("exch"))


# --- comparisons --------------------------------------------------------------------


@query(
    "table_diff",
    """WITH a AS (SELECT o_orderkey, o_totalprice AS price, o_orderstatus AS status FROM orders),
    b AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) AS price, max(l_linestatus) AS status FROM lineitem GROUP BY 1),
    j AS (SELECT o_orderkey, a.price AS ap, b.price AS bp, a.status AS ast, b.status AS bst FROM a FULL JOIN b USING (o_orderkey))
    SELECT o_orderkey, '*' AS "column", 'missing_left' AS kind, NULL::DOUBLE AS left_number, NULL::DOUBLE AS right_number,
      NULL::VARCHAR AS left_text, NULL::VARCHAR AS right_text FROM j WHERE ast IS NULL
    UNION ALL SELECT o_orderkey, '*', 'missing_right', NULL, NULL, NULL, NULL FROM j WHERE bst IS NULL
    UNION ALL SELECT o_orderkey, 'price', 'mismatch', ap, bp, NULL, NULL FROM j WHERE abs(ap - bp) >= 50000
    UNION ALL SELECT o_orderkey, 'status', 'mismatch', NULL, NULL, ast, bst FROM j WHERE ast <> bst""",
    r="left_number right_number",
)
def table_diff(spark, d):
    """Order headers against totals of their lines."""
    a = A.table(spark, d, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")
    )
    b = (
        A.table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sum("l_extendedprice").alias("price"), F.max("l_linestatus").alias("status"))
    )
    text = F.col("column") == "status"
    sides = [
        column
        for side in ("left", "right")
        for column in (
            F.when(~text, F.col(f"{side}_value").cast("double")).alias(f"{side}_number"),
            F.when(text, F.col(f"{side}_value")).alias(f"{side}_text"),
        )
    ]
    return D.table_diff(a, b, ["o_orderkey"], 50000).select("o_orderkey", "column", "kind", *sides)


@query(
    "drop_repeat_snapshots",
    """WITH s AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS snap, user_id % 2 AS k FROM events),
    f AS (SELECT event_type, day, snap, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS content FROM s GROUP BY ALL),
    l AS (SELECT *, lag(content) OVER (PARTITION BY event_type, day ORDER BY snap) AS before FROM f)
    SELECT s.event_type, CAST(s.day AS VARCHAR) AS day, s.snap, s.k FROM s JOIN l ON s.event_type = l.event_type AND s.day = l.day AND s.snap = l.snap
    WHERE l.before IS DISTINCT FROM l.content""",
)
def drop_repeat_snapshots(spark, d):
    e = A.table(spark, d, "events")
    s = e.select(
        "event_type",
        F.to_date("ts").cast("string").alias("day"),
        (F.hour("ts") * 60 + F.minute("ts")).alias("snap"),
        (F.col("user_id") % 2).alias("k"),
    ).distinct()
    keyed = s.withColumn("feed", F.concat_ws("/", "event_type", "day"))
    return D.drop_repeat_snapshots(keyed, "feed", "snap", ["k"]).drop("feed")
