"""Matching, search, instruments, tickets, positions and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scalar as X
from tickloom.functions.ranking import placed
from tickloom.operators import instruments as N
from tickloom.operators import match as M
from tickloom.operators import portfolio as P
from tickloom.operators import tickets as T
from tickloom.plans import adapters as A
from tickloom.plans.registry import query
from tickloom.session import scratch_path
from tickloom.sources import files as R

# --- texts ------------------------------------------------------------------------


@query(
    "clean_symbol_text",
    r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(upper(p_name || '1!'), '1!$', ''), '!$', ''), '[^A-Z0-9&]', '', 'g') AS cleaned,
    regexp_replace(replace(replace(replace(upper(p_brand || 'oh-eo' || 'T1!'), 'T1!', '1!'), 'OH', 'O1!'), 'EO', 'CO'), '1!$', '') AS raw_repair,
    regexp_extract('px ' || p_retailprice || ' usd', '(\d+(\.\d+)?)', 1) AS number FROM part""",
)
def clean_symbol_text(spark, d):
    p = A.table(spark, d, "part")
    text = F.concat(F.col("p_brand"), F.lit("oh-eoT1!"))
    repaired = F.upper(text)
    for a, b in (("T1!", "1!"), ("OH", "O1!"), ("EO", "CO")):
        repaired = F.replace(repaired, F.lit(a), F.lit(b))
    return p.select(
        "p_partkey",
        X.clean_symbol(F.concat("p_name", F.lit("1!"))).alias("cleaned"),
        F.regexp_replace(repaired, r"1!$", "").alias("raw_repair"),
        X.first_number(F.concat(F.lit("px "), F.col("p_retailprice").cast("string"), F.lit(" usd"))).alias("number"),
    )


@query(
    "repair_symbol",
    r"""SELECT p_partkey, regexp_replace(regexp_replace(replace(replace(replace(upper(p_brand || 'oh-eo' || 'T1!'), 'T1!', '1!'), 'OH', 'O1!'), 'EO', 'CO'), '1!$', ''), '[^A-Z0-9&]', '', 'g') AS repaired FROM part""",
)
def repair_symbol(spark, d):
    p = A.table(spark, d, "part")
    return p.select("p_partkey", X.repair_symbol(F.concat("p_brand", F.lit("oh-eoT1!"))).alias("repaired"))


@query(
    "rename_symbols",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'MACH' WHEN 'BUILDING' THEN 'BLDG' ELSE c_mktsegment END AS symbol FROM customer",
)
def rename_symbols(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("symbol"))
    return X.rename_symbols(c, {"MACHINERY": "MACH", "BUILDING": "BLDG"})


@query(
    "index_slug",
    r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(p_name || ' & ' || p_type || '/' || p_brand), '&', ''), '[/\-\s]+', '_', 'g'),
    '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_') || '.csv' AS slug FROM part""",
)
def index_slug(spark, d):
    p = A.table(spark, d, "part")
    name = F.concat("p_name", F.lit(" & "), "p_type", F.lit("/"), "p_brand")
    return p.select("p_partkey", X.index_slug(name).alias("slug"))


# Queries: part names with one character dropped, some with a letter added.
TYPO_SQL = """WITH q AS (SELECT DISTINCT CASE WHEN p_size > 25 THEN substr(p_name, 1, p_size % 5 + 1) || substr(p_name, p_size % 5 + 3)
    ELSE substr(p_name, 1, p_size % 4 + 1) || 'x' || substr(p_name, p_size % 4 + 3) || CASE WHEN p_size > 12 THEN 'e' ELSE '' END END AS query FROM part),
c AS (SELECT DISTINCT regexp_replace(upper(p_name), '[^A-Z0-9&]', '', 'g') AS c FROM part UNION SELECT DISTINCT regexp_replace(upper(n_name), '[^A-Z0-9&]', '', 'g') FROM nation),
w AS (SELECT query, regexp_replace(upper(query), '[^A-Z0-9&]', '', 'g') AS q FROM q),
t AS (SELECT *, list_transform(range(1, length(q) + 1), lambda i: substr('$' || q || '^', i, 3)) AS qt FROM (SELECT DISTINCT q FROM w)),
k AS (SELECT *, list_transform(range(1, length(c) + 1), lambda i: substr('$' || c || '^', i, 3)) AS ct FROM c),
s AS (SELECT q, c, len(list_filter(qt, lambda x: list_contains(ct, x))) AS ov, len(qt) + len(ct) AS n, levenshtein(q, c) AS e FROM t, k),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN e = 0 THEN 0 WHEN 2.0 * ov / n >= 0.7 THEN 1 ELSE 2 END,
    CASE WHEN 2.0 * ov / n >= 0.7 THEN -2.0::DOUBLE * ov / n ELSE e END, CASE WHEN 2.0 * ov / n >= 0.7 THEN 0 ELSE -ov END, c) AS rn
  FROM s WHERE e = 0 OR 2.0 * ov / n >= 0.7 OR (ov > 0 AND e <= 2))
SELECT query, c AS symbol FROM w LEFT JOIN (SELECT q, c FROM r WHERE rn = 1) USING (q)"""


@query("fuzzy_match", TYPO_SQL)
def fuzzy_match(spark, d):
    p = A.table(spark, d, "part")
    name, size = F.col("p_name"), F.col("p_size")

    def cut(n):
        return F.substr(name, F.lit(1), size % n + 1), F.substr(name, size % n + 3)

    a, b = cut(5)
    a2, b2 = cut(4)
    extra = F.when(size > 12, "e").otherwise("")
    typo = F.when(size > 25, F.concat(a, b)).otherwise(F.concat(a2, F.lit("x"), b2, extra))
    known = p.select(X.clean_symbol(F.col("p_name")).alias("symbol")).union(
        A.table(spark, d, "nation").select(X.clean_symbol(F.col("n_name")))
    )
    return M.fuzzy_match(p.select(typo.alias("query")).distinct(), known)


# --- instruments -----------------------------------------------------------------

MASTER_SQL = """master AS MATERIALIZED (SELECT p_partkey AS load_pos, CASE WHEN p_size > 40 THEN 'MCX' ELSE 'NSE' END AS exch,
    CASE p_type WHEN 'ECONOMY' THEN 'EQUITY' WHEN 'STANDARD' THEN 'INDEX' WHEN 'PROMO' THEN 'FUTSTK' ELSE 'OPTSTK' END AS inst,
    upper(replace(p_brand, '#', '')) AS symbol, p_name AS display_raw, CAST(p_partkey // 2 AS VARCHAR) AS security_id, p_size AS lot,
    CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN '' ELSE strftime(DATE '2024-01-01' + p_size * 7, '%Y-%m-%d') END AS expiry,
    CASE WHEN p_type IN ('LARGE', 'MEDIUM', 'SMALL') THEN floor(p_retailprice / 20) * 20 ELSE 0.0 END AS strike,
    CASE WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'CE' WHEN p_type = 'SMALL' THEN 'PE' ELSE '' END AS opt_type FROM part)"""


def _master(spark, d):
    t = F.col("p_type")
    cash, option = t.isin("ECONOMY", "STANDARD"), t.isin("LARGE", "MEDIUM", "SMALL")
    expiry = F.date_add(F.to_date(F.lit("2024-01-01")), F.col("p_size") * 7)
    return A.table(spark, d, "part").select(
        F.col("p_partkey").alias("load_pos"),
        F.when(F.col("p_size") > 40, "MCX").otherwise("NSE").alias("exch"),
        F.when(t == "ECONOMY", "EQUITY").when(t == "STANDARD", "INDEX").when(t == "PROMO", "FUTSTK").otherwise("OPTSTK").alias("inst"),
        F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("symbol"),
        F.col("p_name").alias("display_raw"),
        F.floor(F.col("p_partkey") / 2).cast("string").alias("security_id"),
        F.col("p_size").alias("lot"),
        F.when(cash, "").otherwise(F.date_format(expiry, "yyyy-MM-dd")).alias("expiry"),
        F.when(option, (F.floor(F.col("p_retailprice") / 20) * 20).cast("double")).otherwise(0.0).alias("strike"),
        F.when(t.isin("LARGE", "MEDIUM"), "CE").when(t == "SMALL", "PE").otherwise("").alias("opt_type"),
    )


DISPLAY = """CASE WHEN inst LIKE 'OPT%' THEN CASE WHEN starts_with(upper(display_raw), symbol) THEN display_raw ELSE symbol || ' ' || display_raw END
  WHEN inst LIKE 'FUT%' THEN CASE WHEN starts_with(upper(display_raw), symbol) THEN display_raw ELSE symbol || ' FUT ' || display_raw END
  WHEN upper(display_raw) = symbol THEN symbol || ' - EQ'
  WHEN starts_with(upper(display_raw), symbol) THEN symbol || ' - EQ' ELSE symbol || ' - EQ (' || display_raw || ')' END"""


@query(
    "instrument_names",
    f"""WITH {MASTER_SQL} SELECT load_pos, {DISPLAY} AS display, CASE WHEN inst LIKE 'OPT%' THEN 'OPT' WHEN inst LIKE 'FUT%' THEN 'FUT' ELSE 'EQ' END AS inst_type,
    CASE WHEN expiry = '' THEN '' ELSE upper(strftime(CAST(expiry AS DATE), '%b')) END AS month_tag, opt_type FROM master""",
)
def instrument_names(spark, d):
    return _named(_master(spark, d)).select("load_pos", "display", "inst_type", "month_tag", "opt_type")


def _named(m):
    return m.withColumns(
        {
            "display": N.display_name(F.col("inst"), F.col("symbol"), F.col("display_raw")),
            "inst_type": N.family(F.col("inst")),
            "month_tag": N.month_tag(F.col("expiry")),
            "opt_type": N.option_side(F.col("opt_type")),
        }
    )


@query(
    "live_instruments",
    f"WITH {MASTER_SQL} SELECT load_pos FROM master WHERE inst IN ('EQUITY', 'INDEX') OR expiry >= '2024-06-01'",
)
def live_instruments(spark, d):
    return N.live_instruments(_master(spark, d), "2024-06-01").select("load_pos")


INDEX_SQL = f"""{MASTER_SQL},
kept AS (SELECT * FROM master m WHERE inst = 'EQUITY' OR (inst = 'INDEX' AND load_pos = (SELECT min(load_pos) FROM master x WHERE x.security_id = m.security_id))),
cash AS MATERIALIZED (SELECT exch, symbol, arg_max(security_id, load_pos) AS security_id, arg_max(lot, load_pos) AS lot FROM kept GROUP BY 1, 2),
contracts AS MATERIALIZED (SELECT exch, inst, symbol, expiry, strike, opt_type, arg_min(security_id, load_pos) AS security_id, arg_min(lot, load_pos) AS lot
  FROM (SELECT * REPLACE (CASE WHEN inst LIKE 'OPT%' THEN strike ELSE -1.0 END AS strike) FROM master WHERE inst NOT IN ('EQUITY', 'INDEX')) GROUP BY 1, 2, 3, 4, 5, 6)"""


@query("cash_index", f"WITH {INDEX_SQL} SELECT * FROM cash")
def cash_index(spark, d):
    return N.instrument_index(_master(spark, d))[0]


@query("contract_index", f"WITH {INDEX_SQL} SELECT * FROM contracts", r="strike")
def contract_index(spark, d):
    return N.instrument_index(_master(spark, d))[1]


# Tickets from orders: symbol and side from the customer, price from the total.
WANT_SQL = """want AS MATERIALIZED (SELECT o_orderkey AS ticket_id, CASE WHEN c_nationkey > 20 THEN 'MCX' ELSE 'NSE' END AS exch,
  CASE o_orderstatus WHEN 'O' THEN 'EQUITY' WHEN 'F' THEN 'FUTSTK' ELSE 'OPTSTK' END AS seg,
  'BRAND' || (c_nationkey + 1) AS symbol, strftime(DATE '2024-01-01' + CAST(o_orderkey % 60 AS INT) * 7, '%Y-%m-%d') AS expiry,
  CASE WHEN o_orderstatus = 'P' THEN 890.0 + (o_orderkey % 8) * 15 END AS strike,
  CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_totalprice > 250000 THEN 'CE' ELSE 'PE' END END AS opt_type
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
FOUND_SQL = f"""{INDEX_SQL}, {WANT_SQL},
near AS (SELECT exch, inst AS seg, symbol, min(expiry) AS nearest FROM contracts GROUP BY 1, 2, 3),
used AS (SELECT w.*, CASE WHEN seg = 'EQUITY' THEN NULL WHEN EXISTS (SELECT 1 FROM contracts c WHERE c.exch = w.exch AND c.inst = w.seg AND c.symbol = w.symbol AND c.expiry = w.expiry)
  THEN w.expiry ELSE nearest END AS used_expiry FROM want w LEFT JOIN near USING (exch, seg, symbol)),
found AS MATERIALIZED (SELECT u.*, coalesce(k.security_id, c.security_id) AS security_id, coalesce(k.lot, c.lot) AS lot FROM used u
  LEFT JOIN cash k ON u.seg = 'EQUITY' AND k.exch = u.exch AND k.symbol = u.symbol
  LEFT JOIN contracts c ON u.seg <> 'EQUITY' AND c.exch = u.exch AND c.inst = u.seg AND c.symbol = u.symbol AND c.expiry = u.used_expiry
    AND c.strike = coalesce(u.strike, -1.0) AND c.opt_type = coalesce(u.opt_type, ''))"""


def _want(spark, d):
    o, c = A.table(spark, d, "orders"), A.table(spark, d, "customer")
    st = F.col("o_orderstatus")
    expiry = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("o_orderkey") % 60).cast("int") * 7)
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("ticket_id"),
        F.when(F.col("c_nationkey") > 20, "MCX").otherwise("NSE").alias("exch"),
        F.when(st == "O", "EQUITY").when(st == "F", "FUTSTK").otherwise("OPTSTK").alias("seg"),
        F.concat(F.lit("BRAND"), (F.col("c_nationkey") + 1).cast("string")).alias("symbol"),
        F.date_format(expiry, "yyyy-MM-dd").alias("expiry"),
        F.when(st == "P", 890.0 + (F.col("o_orderkey") % 8) * 15).alias("strike"),
        F.when(st == "P", F.when(F.col("o_totalprice") > 250000, "CE").otherwise("PE")).alias("opt_type"),
    )


@query("lookup_instruments", f"WITH {FOUND_SQL} SELECT ticket_id, coalesce(used_expiry, '') AS used_expiry, coalesce(security_id, '') AS security_id, coalesce(lot, 0) AS lot FROM found")
def lookup_instruments(spark, d):
    out = N.lookup_instruments(_want(spark, d), *N.instrument_index(_master(spark, d)))
    none = F.lit("")
    return out.select(
        "ticket_id",
        F.coalesce("used_expiry", none).alias("used_expiry"),
        F.coalesce("security_id", none).alias("security_id"),
        F.coalesce("lot", F.lit(0)).alias("lot"),
    )


@query(
    "lookup_with_fallback",
    f"""WITH {FOUND_SQL},
    m AS (SELECT *, CASE WHEN seg = 'OPTSTK' AND security_id IS NULL THEN CASE WHEN opt_type = 'CE' THEN floor(strike / s) * s ELSE ceil(strike / s) * s END END AS moved
      FROM (SELECT *, CASE WHEN strike <= 100 THEN 2 WHEN strike <= 500 THEN 10 WHEN strike <= 1000 THEN 20 ELSE 25 END AS s FROM found)),
    b AS (SELECT m.*, c.security_id AS id2, c.lot AS lot2 FROM m LEFT JOIN contracts c ON m.moved <> m.strike AND c.exch = m.exch AND c.inst = m.seg AND c.symbol = m.symbol
      AND c.expiry = m.used_expiry AND c.strike = m.moved AND c.opt_type = m.opt_type)
    SELECT ticket_id, coalesce(CASE WHEN id2 IS NOT NULL THEN moved ELSE strike END, 0) AS strike, id2 IS NOT NULL AS fell_back,
      coalesce(security_id, id2, '') AS security_id, coalesce(lot, lot2, 0) AS lot FROM b""",
    r="strike",
)
def lookup_with_fallback(spark, d):
    out = N.lookup_with_fallback(_want(spark, d), *N.instrument_index(_master(spark, d)))
    return out.select("ticket_id", F.coalesce("strike", F.lit(0.0)).alias("strike"), "fell_back", F.coalesce("security_id", F.lit("")).alias("security_id"), "lot")


@query(
    "by_display_name",
    f"""WITH {MASTER_SQL}, n AS (SELECT upper({DISPLAY}) AS k, min(load_pos) AS load_pos FROM master GROUP BY 1)
    SELECT c_custkey, coalesce(m.symbol, text) AS symbol, coalesce(m.exch, 'X') AS exch, coalesce(m.expiry, '') AS expiry, coalesce(m.strike, 0) AS strike
    FROM (SELECT c_custkey, '  brand' || (c_nationkey % 5 + 1) || '  fut  ' || CASE WHEN c_acctbal > 0 THEN 'red bolt' ELSE 'hot gear' END AS text,
      'BRAND' || (c_nationkey % 5 + 1) || ' FUT ' || CASE WHEN c_acctbal > 0 THEN 'RED BOLT' ELSE 'HOT GEAR' END AS k FROM customer)
    LEFT JOIN n USING (k) LEFT JOIN master m USING (load_pos)""",
    r="strike",
)
def by_display_name(spark, d):
    text = F.concat(
        F.lit("  brand"), (F.col("c_nationkey") % 5 + 1).cast("string"), F.lit("  fut  "),
        F.when(F.col("c_acctbal") > 0, "red bolt").otherwise("hot gear"),
    )
    none = F.lit("")
    rows = A.table(spark, d, "customer").select(
        "c_custkey", text.alias("symbol"), F.lit("X").alias("exch"), none.alias("inst_type"), none.alias("opt_type"), none.alias("expiry"), F.lit(0.0).alias("strike")
    )
    out = N.by_display_name(rows, _named(_master(spark, d)))
    return out.select("c_custkey", "symbol", "exch", F.coalesce("expiry", none).alias("expiry"), "strike")


@query(
    "enrich_ids",
    f"""WITH {MASTER_SQL} SELECT l_orderkey, l_linenumber, coalesce(m.display_raw, 'id-' || l_partkey) AS display_name, coalesce(m.symbol, 'id-' || l_partkey) AS base_symbol
    FROM lineitem LEFT JOIN (SELECT CAST(load_pos AS VARCHAR) AS security_id, display_raw, symbol FROM master WHERE lot > 10) m ON m.security_id = CAST(l_partkey AS VARCHAR)""",
)
def enrich_ids(spark, d):
    master = _master(spark, d).filter("lot > 10").select(
        F.col("load_pos").cast("string").alias("security_id"), F.col("display_raw").alias("display"), "symbol"
    )
    li = A.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").cast("string").alias("security_id"),
        F.concat(F.lit("id-"), F.col("l_partkey").cast("string")).alias("fallback"),
    )
    return N.enrich_ids(li, master, "fallback").select("l_orderkey", "l_linenumber", "display_name", "base_symbol")


# --- search ------------------------------------------------------------------------

SEARCH_TEXT = "CASE WHEN p_size > 45 THEN CASE WHEN p_type = 'SMALL' THEN 'pe' ELSE 'jun' END ELSE split_part(p_name, ' ', 1 + p_size % 2) || CASE WHEN p_size % 3 = 0 THEN ' brand' || (p_size % 7) ELSE '' END || CASE p_type WHEN 'LARGE' THEN ' call' WHEN 'PROMO' THEN ' fut' WHEN 'SMALL' THEN ' ' || CAST(floor(p_retailprice / 20) * 20 AS INT) WHEN 'MEDIUM' THEN ' march' WHEN 'STANDARD' THEN ' gdt' ELSE '' END END"
SEARCH_SQL = f"""WITH {MASTER_SQL},
ents AS MATERIALIZED (SELECT load_pos AS entry_id, symbol, {DISPLAY} AS display, CASE WHEN inst LIKE 'OPT%' THEN 'OPT' WHEN inst LIKE 'FUT%' THEN 'FUT' ELSE 'EQ' END AS inst_type,
  expiry, strike, opt_type, CASE WHEN expiry = '' THEN '' ELSE upper(strftime(CAST(expiry AS DATE), '%b')) END AS month_tag FROM master),
own AS (SELECT *, list_sort(list_distinct(list_filter(string_split_regex(upper(symbol || ' ' || display), '[\\s-]+'), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]+$')
  AND w NOT IN ('OF','THE','&','LTD','LIMITED','CORP','CORPORATION','CO','CE','PE','CALL','PUT','FUT','OPT','EQ')))) AS own FROM ents),
eq AS (SELECT symbol, arg_max(own, entry_id) AS eqt FROM own WHERE inst_type = 'EQ' GROUP BY 1),
e AS MATERIALIZED (SELECT own.* EXCLUDE (own), CASE WHEN inst_type = 'EQ' THEN own ELSE coalesce(eqt, own) END AS toks FROM own LEFT JOIN eq USING (symbol)),
vocab AS MATERIALIZED (SELECT word, ln((SELECT count(*) FROM e) / count(*)) + 1 AS idf FROM (SELECT unnest(toks) AS word FROM e) GROUP BY 1),
q AS (SELECT DISTINCT {SEARCH_TEXT} AS query FROM part),
parts AS (SELECT query, string_split(upper(query), ' ') AS p FROM q),
ctx AS MATERIALIZED (SELECT query, list_filter(p, lambda w: w NOT IN ('CALL','FUT','MARCH','JUN','PE') AND try_cast(w AS DOUBLE) IS NULL) AS names,
  CASE WHEN list_contains(p, 'MARCH') THEN 'MAR' WHEN list_contains(p, 'JUN') THEN 'JUN' END AS mon, CASE WHEN list_contains(p, 'CALL') THEN 'CE' WHEN list_contains(p, 'PE') THEN 'PE' END AS opt,
  list_contains(p, 'FUT') AS fut, list_filter(list_transform(p, lambda w: try_cast(w AS INT)), lambda v: v > 0)[1] AS strk FROM parts),
tok AS MATERIALIZED (SELECT DISTINCT unnest(names) AS t FROM ctx),
pre AS MATERIALIZED (SELECT t, word FROM tok, vocab WHERE starts_with(word, t)),
m AS MATERIALIZED (SELECT * FROM pre UNION ALL SELECT t, word FROM tok, vocab WHERE t NOT IN (SELECT t FROM pre) AND regexp_matches(word, array_to_string(string_split(t, ''), '.*'))),
sets AS MATERIALIZED (SELECT DISTINCT m.t, e.entry_id FROM m JOIN (SELECT entry_id, unnest(toks) AS word FROM e) e USING (word)),
hit AS MATERIALIZED (SELECT c.query, s.entry_id, count(*) AS n, any_value(len(names)) AS need FROM (SELECT query, names, unnest(names) AS t FROM ctx) c JOIN sets s USING (t) GROUP BY 1, 2),
strict AS (SELECT DISTINCT query FROM hit WHERE n = need),
cand AS MATERIALIZED (SELECT query, entry_id, true AS used FROM hit WHERE n = need UNION ALL SELECT query, entry_id, false FROM hit WHERE query NOT IN (SELECT query FROM strict)
  UNION ALL SELECT query, entry_id, false FROM ctx, e WHERE len(names) = 0),
fil AS MATERIALIZED (SELECT c.*, x.used, e.* FROM cand x JOIN ctx c USING (query) JOIN e USING (entry_id)
  WHERE (CASE WHEN c.opt IS NOT NULL THEN e.opt_type = c.opt WHEN c.fut THEN e.inst_type = 'FUT' ELSE true END)
    AND (c.mon IS NULL OR e.month_tag = c.mon) AND (c.strk IS NULL OR (e.strike > 0 AND e.strike = c.strk))),
pts AS (SELECT f.query, f.entry_id, t.tk, coalesce(v.idf, 1) AS idf, CASE WHEN symbol = tk THEN 1000 + coalesce(v.idf, 1) * 100
    WHEN starts_with(symbol, tk) OR starts_with(tk, symbol) THEN 400 + coalesce(v.idf, 1) * 100
    WHEN regexp_matches(symbol, array_to_string(string_split(tk, ''), '.*')) THEN 200 + coalesce(v.idf, 1) * 50
    WHEN list_contains(toks, tk) THEN coalesce(v.idf, 1) * 100
    WHEN len(list_filter(toks, lambda w: starts_with(w, tk))) > 0 THEN coalesce(v.idf, 1) * 80
    WHEN len(list_filter(toks, lambda w: regexp_matches(w, array_to_string(string_split(tk, ''), '.*')))) > 0 THEN coalesce(v.idf, 1) * 40 END AS pt
  FROM fil f, unnest(f.names) t(tk) LEFT JOIN vocab v ON v.word = tk),
sc AS (SELECT query, entry_id, sum(coalesce(pt, 0)) AS s, count(pt) AS matched FROM pts GROUP BY 1, 2),
fin AS (SELECT f.query, f.entry_id, f.expiry, f.strike, coalesce(s, 0) + CASE WHEN f.used AND matched >= len(f.names) AND len(f.names) > 0 THEN 200 ELSE 0 END
    + CASE WHEN f.expiry = '' AND f.mon IS NULL AND coalesce(f.strk, 0) = 0 AND f.opt IS NULL AND NOT f.fut THEN 50 ELSE 0 END AS score
  FROM fil f LEFT JOIN sc USING (query, entry_id))
SELECT query, CAST(rank AS INT) AS rank, score, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, expiry, strike, entry_id) AS rank FROM fin) WHERE rank <= 30"""


@query("search_instruments", SEARCH_SQL, r="score")
def search_instruments(spark, d):
    p = A.table(spark, d, "part")
    t, size = F.col("p_type"), F.col("p_size")
    word = F.split_part("p_name", F.lit(" "), 1 + size % 2)
    brand = F.when(size % 3 == 0, F.concat(F.lit(" brand"), (size % 7).cast("string"))).otherwise("")
    strike = F.concat(F.lit(" "), (F.floor(F.col("p_retailprice") / 20) * 20).cast("int").cast("string"))
    tail = (
        F.when(t == "LARGE", " call").when(t == "PROMO", " fut").when(t == "SMALL", strike)
        .when(t == "MEDIUM", " march").when(t == "STANDARD", " gdt").otherwise("")
    )
    text = F.when(size > 45, F.when(t == "SMALL", "pe").otherwise("jun")).otherwise(F.concat(word, brand, tail))
    inst = _named(_master(spark, d)).select(
        F.col("load_pos").alias("entry_id"), "symbol", "display", "inst_type", "expiry", "strike", "opt_type", "month_tag",
        F.lit("").alias("company"),
    )
    return M.search_instruments(p.select(text.alias("query")), inst, 30).select("query", "rank", "score", "entry_id")


# --- strikes and ladders --------------------------------------------------------------

ORDERS_SQL = """ord AS MATERIALIZED (SELECT o_orderkey AS ticket_id, c_mktsegment AS symbol, o_totalprice / 100 AS price, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS signal,
  o_orderpriority AS prio, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey)"""
STEP = "CASE symbol WHEN 'MACHINERY' THEN 100 WHEN 'BUILDING' THEN 1000 ELSE CASE WHEN {p} <= 100 THEN 1 WHEN {p} <= 500 THEN 5 WHEN {p} <= 1000 THEN 10 WHEN {p} <= 2500 THEN 20 WHEN {p} <= 5000 THEN 50 ELSE 100 END END"
TABLES = {"index": {"MACHINERY": 100}, "commodity": {"BUILDING": 1000}}


def _orders(spark, d):
    o, c = A.table(spark, d, "orders"), A.table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("ticket_id"),
        F.col("c_mktsegment").alias("symbol"),
        (F.col("o_totalprice") / 100).alias("price"),
        F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("signal"),
        F.col("o_orderpriority").alias("prio"),
        F.col("o_orderstatus").alias("st"),
    )


@query(
    "strike_price",
    f"""WITH {ORDERS_SQL} SELECT ticket_id, CAST(i AS INT) AS interval, CASE WHEN signal = 'BUY' THEN floor(price / i) * i ELSE ceil(price / i) * i END AS strike,
    CASE WHEN signal = 'BUY' THEN 'CALL' ELSE 'PUT' END AS option_type FROM (SELECT *, {STEP.format(p='price')} AS i FROM ord)""",
    r="strike",
)
def strike_price(spark, d):
    return N.strike_price(_orders(spark, d), **TABLES).select("ticket_id", "interval", "strike", "option_type")


@query(
    "price_levels",
    f"""WITH {ORDERS_SQL}, a AS (SELECT *, CASE WHEN st = 'P' THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS k, signal = 'BUY' AS b FROM ord),
    e AS (SELECT *, CASE WHEN b THEN ceil(price * (1 + k * 0.13::DOUBLE / 100)) ELSE floor(price * (1 - k * 0.13::DOUBLE / 100)) END AS entry FROM a),
    s AS (SELECT *, CASE WHEN b THEN ceil(entry * (1 + k * 0.5::DOUBLE / 100)) ELSE floor(entry * (1 - k * 0.5::DOUBLE / 100)) END AS "limit",
      CASE WHEN NOT b THEN ceil(entry * (1 + k * 0.7::DOUBLE / 100)) ELSE floor(entry * (1 - k * 0.7::DOUBLE / 100)) END AS stop,
      CASE WHEN b THEN ceil(entry * (1 + k * 4.0::DOUBLE / 100)) ELSE floor(entry * (1 - k * 4.0::DOUBLE / 100)) END AS target FROM e)
    SELECT ticket_id, entry, "limit", stop, target, CASE WHEN NOT b THEN ceil(stop * (1 + k * 0.5::DOUBLE / 100)) ELSE floor(stop * (1 - k * 0.5::DOUBLE / 100)) END AS stop_limit,
      ceil(entry * (0.35::DOUBLE * k) / 100) AS trail FROM s""",
)
def price_levels(spark, d):
    out = T.price_levels(_orders(spark, d), bump=F.col("st") == "P")
    return out.select("ticket_id", "entry", "limit", "stop", "target", "stop_limit", "trail")


@query(
    "order_quantity",
    f"""WITH {ORDERS_SQL} SELECT ticket_id, CAST(CASE WHEN st = 'O' THEN 2 * 25 ELSE ceil(50000 / (price * 25)) * 25 END AS BIGINT) AS quantity FROM ord""",
)
def order_quantity(spark, d):
    amount = F.when(F.col("st") == "O", 0.0).otherwise(50000.0)
    q = T.order_quantity(amount, F.col("price"), F.lit(25), F.lit(2))
    return _orders(spark, d).select("ticket_id", q.alias("quantity"))


@query(
    "classify_order",
    f"""WITH {ORDERS_SQL}, s AS (SELECT *, CASE WHEN ex = 'NSE' THEN CASE WHEN ix THEN CASE mode WHEN 'OPT' THEN 'OPTIDX' WHEN 'FUT' THEN 'FUTIDX' ELSE '' END
        ELSE CASE mode WHEN 'EQ' THEN 'EQUITY' WHEN 'OPT' THEN 'OPTSTK' ELSE 'FUTSTK' END END ELSE CASE mode WHEN 'OPT' THEN 'OPTFUT' WHEN 'FUT' THEN 'FUTCOM' ELSE '' END END AS seg
      FROM (SELECT *, CASE WHEN price > 2500 THEN 'NSE' ELSE 'MCX' END AS ex, CASE st WHEN 'O' THEN 'EQ' WHEN 'F' THEN 'FUT' ELSE 'OPT' END AS mode, symbol = 'BUILDING' AS ix FROM ord))
    SELECT ticket_id, seg, ex || '_' || CASE WHEN seg = '' THEN '' WHEN seg = 'EQUITY' THEN 'EQ' WHEN seg IN ('OPTFUT', 'FUTCOM') THEN 'COMM' ELSE 'FNO' END AS exchange_seg,
      CASE WHEN seg LIKE 'OPT%' THEN symbol || ' 100.0 CE 2024-05-01' WHEN seg LIKE 'FUT%' THEN symbol || ' Fut 2024-05-01' ELSE symbol || ' ' || seg END AS contract,
      CASE WHEN price > 4000 AND price < 4500 THEN 'STOP_LOSS' WHEN price > 4000 THEN 'STOP_LOSS_MARKET' WHEN price < 4500 AND price > 3000 THEN 'LIMIT' ELSE 'MARKET' END AS order_type,
      CASE WHEN seg IN ('OPTSTK', 'OPTIDX', 'OPTFUT') THEN 'SIMPLE' WHEN seg LIKE 'FUT%' THEN 'FOREVER' ELSE 'SUPER' END AS route_forever,
      CASE WHEN seg LIKE 'OPT%' AND ex = 'MCX' THEN 'SIMPLE' WHEN (seg LIKE 'OPT%' OR seg LIKE 'FUT%') AND ex <> 'MCX' THEN 'UNDERLYING_ALERT' ELSE 'ALERT' END AS route_alert FROM s""",
)
def classify_order(spark, d):
    p, st = F.col("price"), F.col("st")
    rows = _orders(spark, d).withColumns(
        {
            "exch": F.when(p > 2500, "NSE").otherwise("MCX"),
            "mode": F.when(st == "O", "EQ").when(st == "F", "FUT").otherwise("OPT"),
            "is_index": F.col("symbol") == "BUILDING",
            "strike": F.lit(100.0),
            "opt_type": F.lit("CE"),
            "expiry": F.lit("2024-05-01"),
            "trigger_price": F.when(p > 4000, p).otherwise(0.0),
            "limit_price": F.when((p > 3000) & (p < 4500), p).otherwise(0.0),
        }
    )
    out = T.classify_order(rows)
    return out.select(
        "ticket_id", "seg", "exchange_seg", "contract", "order_type",
        T.route_order("FOREVER", F.col("exch"), F.col("seg")).alias("route_forever"),
        T.route_order("ALERT", F.col("exch"), F.col("seg")).alias("route_alert"),
    )


@query(
    "option_params",
    f"""WITH {ORDERS_SQL} SELECT ticket_id, coalesce(CASE WHEN st <> 'O' THEN CASE WHEN prio = '1-URGENT' THEN 'PE' WHEN signal = 'BUY' THEN 'CE' ELSE 'PE' END END, '') AS opt_type,
    CASE WHEN st <> 'O' AND prio <> '1-URGENT' THEN 'BUY' ELSE signal END AS final_signal,
    coalesce(CASE WHEN st <> 'O' THEN CASE WHEN prio = '2-HIGH' THEN 77 WHEN prio = '5-LOW' AND signal = 'BUY' THEN 88 WHEN prio = '3-MEDIUM' THEN 99
      ELSE CASE WHEN signal = 'BUY' THEN floor(price / i) * i ELSE ceil(price / i) * i END END END, 0) AS strike
    FROM (SELECT *, {STEP.format(p='price')} AS i FROM ord)""",
    r="strike",
)
def option_params(spark, d):
    prio = F.col("prio")
    rows = _orders(spark, d).withColumns(
        {
            "entry": F.col("price"),
            "mode": F.when(F.col("st") == "O", "EQ").otherwise("OPT"),
            "o_opt_type": F.when(prio == "1-URGENT", "PE"),
            "o_strike": F.when(prio == "2-HIGH", 77.0).otherwise(0.0),
            "call_strike": F.when(prio == "5-LOW", 88.0),
            "put_strike": F.lit(None).cast("double"),
            "any_strike": F.when(prio == "3-MEDIUM", 99.0),
        }
    )
    out = T.option_params(rows, **TABLES)
    return out.select("ticket_id", F.coalesce("opt_type", F.lit("")).alias("opt_type"), "final_signal", F.coalesce("strike", F.lit(0.0)).alias("strike"))


# Settings: market segments of customers who owe form the group "stocks", nations the symbols.
def _settings(spark, d):
    n = A.table(spark, d, "nation")
    sym = n.select(
        F.lit("NSE").alias("exch"),
        F.concat(F.lit("BRAND"), (F.col("n_nationkey") + 1).cast("string")).alias("symbol"),
        F.when(F.col("n_regionkey") == 0, "indices").when(F.col("n_regionkey") < 4, "stocks").alias("grp"),
        F.when(F.col("n_regionkey") == 1, "OPT").alias("order_mode"),
        F.when(F.col("n_regionkey") == 2, "2024-07-01").alias("expiry"),
        F.when(F.col("n_regionkey") == 3, 3).alias("quantity"),
        *[F.lit(None).cast("double").alias(c) for c in ("deal_amount", "call_strike", "put_strike", "any_strike")],
    ).filter("grp IS NOT NULL")
    r = A.table(spark, d, "region").filter("r_regionkey < 2")
    first = F.col("r_regionkey") == 0
    grp = r.select(
        F.lit("NSE").alias("exch"),
        F.when(first, "indices").otherwise("stocks").alias("grp"),
        (~first).alias("is_fallback"),
        first.alias("is_index"),
        F.when(first, "FUT").otherwise("EQ").alias("order_mode"),
        F.lit(None).cast("string").alias("expiry"),
        F.lit(None).cast("int").alias("quantity"),
        F.when(~first, 60000.0).alias("deal_amount"),
        *[F.lit(None).cast("double").alias(c) for c in ("call_strike", "put_strike", "any_strike")],
    )
    defaults = {
        "order_mode": "NA", "expiry": "2024-03-04", "quantity": 1, "deal_amount": 50000.0,
        "call_strike": None, "put_strike": None, "any_strike": None,
    }
    return sym, grp, defaults


SETTINGS_SQL = """sig AS (SELECT o_orderkey AS ticket_id, CASE WHEN c_nationkey > 20 THEN 'MCX' ELSE 'NSE' END AS exch, 'BRAND' || (c_nationkey + 1) AS symbol, c_nationkey % 5 AS rk,
  CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS signal, CASE WHEN o_orderstatus = 'O' THEN 4 ELSE 1 END AS quant, o_totalprice / 500 AS price FROM orders JOIN customer ON o_custkey = c_custkey),
cfg AS MATERIALIZED (SELECT *, exch = 'NSE' AND rk = 0 AS is_index, CASE WHEN exch = 'MCX' THEN 'NA' WHEN rk = 0 THEN 'FUT' WHEN rk = 1 THEN 'OPT' ELSE 'EQ' END AS order_mode,
  CASE WHEN exch = 'NSE' AND rk = 2 THEN '2024-07-01' ELSE '2024-03-04' END AS expiry, CASE WHEN exch = 'NSE' AND rk = 3 THEN 3 ELSE 1 END AS quantity,
  CASE WHEN exch = 'NSE' AND rk > 0 THEN 60000.0 ELSE 50000.0 END AS deal_amount FROM sig)"""


def _signals(spark, d):
    o, c = A.table(spark, d, "orders"), A.table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("ticket_id"),
        F.when(F.col("c_nationkey") > 20, "MCX").otherwise("NSE").alias("exch"),
        F.concat(F.lit("BRAND"), (F.col("c_nationkey") + 1).cast("string")).alias("symbol"),
        F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("signal"),
        F.when(F.col("o_orderstatus") == "O", 4).otherwise(1).alias("quant"),
        (F.col("o_totalprice") / 500).alias("entry"),
    )


@query(
    "resolve_settings",
    f"WITH {SETTINGS_SQL} SELECT ticket_id, order_mode, expiry, quantity, deal_amount, is_index FROM cfg",
    r="deal_amount",
)
def resolve_settings(spark, d):
    out = N.resolve_settings(_signals(spark, d), *_settings(spark, d))
    return out.select("ticket_id", "order_mode", "expiry", "quantity", "deal_amount", "is_index")


TICKETS_SQL = f"""WITH {INDEX_SQL}, {SETTINGS_SQL},
s1 AS (SELECT *, CASE WHEN is_index THEN 'FUTIDX' WHEN order_mode = 'EQ' THEN 'EQUITY' WHEN order_mode = 'OPT' THEN 'OPTSTK' ELSE 'FUTSTK' END AS seg,
  CASE WHEN quant > 1 THEN quant ELSE quantity END AS q FROM cfg WHERE exch = 'NSE'),
s2 AS (SELECT *, CASE WHEN seg = 'OPTSTK' THEN 'BUY' ELSE signal END AS side, CASE WHEN seg = 'OPTSTK' THEN CASE WHEN signal = 'BUY' THEN 'CE' ELSE 'PE' END END AS ot,
  CASE WHEN seg = 'OPTSTK' THEN CASE WHEN signal = 'BUY' THEN floor(price / i) * i ELSE ceil(price / i) * i END END AS k FROM (SELECT *, {STEP.format(p='price')} AS i FROM s1)),
near AS (SELECT exch, inst AS seg, symbol, min(expiry) AS nearest FROM contracts GROUP BY 1, 2, 3),
s3 AS (SELECT w.*, CASE WHEN EXISTS (SELECT 1 FROM contracts c WHERE c.exch = w.exch AND c.inst = w.seg AND c.symbol = w.symbol AND c.expiry = w.expiry)
  THEN w.expiry ELSE nearest END AS ue FROM s2 w LEFT JOIN near USING (exch, seg, symbol)),
s4 AS (SELECT *, CASE WHEN ot = 'CE' THEN floor(k / st) * st ELSE ceil(k / st) * st END AS mk FROM
  (SELECT *, CASE WHEN k <= 100 THEN 2 WHEN k <= 500 THEN 10 WHEN k <= 1000 THEN 20 WHEN k <= 2500 THEN 25 WHEN k <= 5000 THEN 100 ELSE 200 END AS st FROM s3)),
s5 AS (SELECT t.*, coalesce(a.security_id, b.security_id, b2.security_id) AS id, coalesce(a.lot, b.lot, b2.lot) AS lot, b.security_id IS NULL AND b2.security_id IS NOT NULL AS fell FROM s4 t
  LEFT JOIN cash a ON t.seg = 'EQUITY' AND a.exch = t.exch AND a.symbol = t.symbol
  LEFT JOIN contracts b ON t.seg <> 'EQUITY' AND b.exch = t.exch AND b.inst = t.seg AND b.symbol = t.symbol AND b.expiry = t.ue AND b.strike = coalesce(t.k, -1.0) AND b.opt_type = coalesce(t.ot, '')
  LEFT JOIN contracts b2 ON b.security_id IS NULL AND t.seg = 'OPTSTK' AND b2.exch = t.exch AND b2.inst = t.seg AND b2.symbol = t.symbol AND b2.expiry = t.ue AND b2.strike = t.mk AND t.mk <> t.k AND b2.opt_type = t.ot),
s6 AS (SELECT *, CASE WHEN side = 'BUY' THEN ceil(price * (1 + 0.13::DOUBLE / 100)) ELSE floor(price * (1 - 0.13::DOUBLE / 100)) END AS entry FROM s5 WHERE id IS NOT NULL)
SELECT ticket_id, id AS security_id, side, fell AS fell_back, CASE WHEN seg = 'OPTSTK' THEN 'SIMPLE' ELSE 'SUPER' END AS route, entry,
  CAST(CASE WHEN seg = 'OPTSTK' THEN q * lot ELSE ceil(deal_amount / (entry * lot)) * lot END AS BIGINT) AS quantity,
  CASE WHEN side = 'BUY' THEN ceil(entry * (1 + 4.0::DOUBLE / 100)) ELSE floor(entry * (1 - 4.0::DOUBLE / 100)) END AS target,
  'NSE_' || CASE WHEN seg = 'EQUITY' THEN 'EQ' ELSE 'FNO' END AS exchange_seg FROM s6"""


@query("order_tickets", TICKETS_SQL)
def order_tickets(spark, d):
    cash, contracts = N.instrument_index(_master(spark, d))
    out = T.order_tickets(_signals(spark, d), _settings(spark, d), cash, contracts, "SUPER", **TABLES)
    return out.select("ticket_id", "security_id", "side", "fell_back", "route", "entry", "quantity", "target", "exchange_seg")


# The same signals with prices and products that a user gave.
GIVEN_SQL = """given AS (SELECT o_orderkey AS ticket_id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 510 ELSE 0 END AS gl, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 600 ELSE 0 END AS gs,
  CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice / 400 ELSE 0 END AS gt, CASE WHEN o_orderkey % 7 < 3 THEN o_totalprice / 505 ELSE 0 END AS gg,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'CNC' WHEN '2-HIGH' THEN 'MARGIN' ELSE 'INTRADAY' END AS gp FROM orders)"""
ROUTE_SQL = {
    "SUPER": "CASE WHEN seg = 'OPTSTK' THEN 'SIMPLE' ELSE 'SUPER' END",
    "FOREVER": "CASE seg WHEN 'OPTSTK' THEN 'SIMPLE' WHEN 'FUTIDX' THEN 'FOREVER' WHEN 'FUTSTK' THEN 'FOREVER' ELSE 'SUPER' END",
    "ALERT": "CASE WHEN seg = 'EQUITY' THEN 'ALERT' ELSE 'UNDERLYING_ALERT' END",
    "SIMPLE": "'SIMPLE'",
}


def _ladder(base: str, percent: float, up: str) -> str:
    return f"CASE WHEN {up} THEN ceil({base} * (1 + {percent}::DOUBLE / 100)) ELSE floor({base} * (1 - {percent}::DOUBLE / 100)) END"


def _mode_sql(mode: str) -> str:
    head = TICKETS_SQL[: TICKETS_SQL.index("s6 AS (")]
    buy = "ls = 'BUY'"
    return head + f"""{GIVEN_SQL},
r6 AS (SELECT *, CASE WHEN route = 'UNDERLYING_ALERT' THEN signal ELSE side END AS ls, seg <> 'EQUITY' AS fno FROM (SELECT *, {ROUTE_SQL[mode]} AS route FROM s5 WHERE id IS NOT NULL) JOIN given USING (ticket_id)),
r7 AS (SELECT *, {_ladder("price", 0.13, buy)} AS en FROM r6),
r8 AS (SELECT *, {_ladder("en", 0.5, buy)} AS lim, {_ladder("en", 0.7, "ls <> 'BUY'")} AS sto, {_ladder("en", 4.0, buy)} AS tar FROM r7)
SELECT t.ticket_id, id AS security_id, side, route,
  CASE WHEN route IN ('SUPER', 'FOREVER') THEN 'LIMIT' WHEN route = 'SIMPLE' THEN CASE WHEN gg > 0 AND gl > 0 THEN 'STOP_LOSS' WHEN gg > 0 THEN 'STOP_LOSS_MARKET' WHEN gl > 0 THEN 'LIMIT' ELSE 'MARKET' END ELSE '' END AS order_type,
  CASE WHEN route = 'FOREVER' THEN CASE WHEN fno THEN 'MARGIN' ELSE 'CNC' END WHEN route = 'SIMPLE' AND fno AND gp = 'CNC' THEN 'MARGIN' ELSE gp END AS product,
  CASE WHEN route LIKE '%ALERT' THEN 0 WHEN gl > 0 THEN gl WHEN route = 'SIMPLE' THEN 0 ELSE lim END AS price,
  CASE WHEN route LIKE '%ALERT' THEN en WHEN route = 'SUPER' THEN 0 WHEN gg > 0 THEN gg WHEN route = 'FOREVER' THEN en ELSE 0 END AS trigger_price,
  CASE WHEN route <> 'SUPER' THEN 0 WHEN gs > 0 THEN gs ELSE sto END AS stop_price, CASE WHEN route <> 'SUPER' THEN 0 WHEN gt > 0 THEN gt ELSE tar END AS target_price,
  CASE WHEN route = 'SUPER' THEN ceil(en * 0.35::DOUBLE / 100) ELSE 0 END AS trail_jump,
  CAST(CASE WHEN route = 'SIMPLE' THEN q * t.lot ELSE ceil(deal_amount / (en * t.lot)) * t.lot END AS BIGINT) AS quantity,
  CASE WHEN route LIKE '%ALERT' THEN CASE WHEN {buy} THEN 'GREATER_THAN' ELSE 'LESS_THAN' END ELSE '' END AS trigger_operator,
  CASE route WHEN 'ALERT' THEN id WHEN 'UNDERLYING_ALERT' THEN u.security_id ELSE '' END AS watched_id,
  CASE route WHEN 'ALERT' THEN 'NSE_EQ' WHEN 'UNDERLYING_ALERT' THEN CASE WHEN seg LIKE '%IDX' THEN 'IDX_I' ELSE 'NSE_EQ' END ELSE '' END AS watched_seg
FROM r8 t LEFT JOIN cash u ON u.exch = t.exch AND u.symbol = t.symbol WHERE route <> 'UNDERLYING_ALERT' OR u.security_id IS NOT NULL"""


def _given_signals(spark, d):
    o = A.table(spark, d, "orders")
    k, price, prio = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderpriority")
    given = o.select(
        k.alias("ticket_id"),
        F.when(k % 3 == 0, price / 510).otherwise(0.0).alias("given_limit"),
        F.when(k % 4 == 0, price / 600).otherwise(0.0).alias("given_stop"),
        F.when(k % 5 == 0, price / 400).otherwise(0.0).alias("given_target"),
        F.when(k % 7 < 3, price / 505).otherwise(0.0).alias("given_trigger"),
        F.when(prio == "1-URGENT", "CNC").when(prio == "2-HIGH", "MARGIN").otherwise("INTRADAY").alias("given_product"),
    )
    return _signals(spark, d).join(given, "ticket_id")


def _mode_query(mode: str) -> None:
    @query(f"order_tickets_{mode.lower()}", _mode_sql(mode), r="price trigger_price stop_price target_price")
    def run(spark, d):
        cash, contracts = N.instrument_index(_master(spark, d))
        out = T.order_tickets(_given_signals(spark, d), _settings(spark, d), cash, contracts, mode, **TABLES)
        words = [F.coalesce(c, F.lit("")).alias(c) for c in ("order_type", "product", "trigger_operator", "watched_id", "watched_seg")]
        return out.select("ticket_id", "security_id", "side", "route", *words, *T.NUMBERS, "quantity")


for _mode in ROUTE_SQL:
    _mode_query(_mode)


# --- positions and orders ----------------------------------------------------------

POS_SQL = """pos AS MATERIALIZED (SELECT o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS security_id, CASE WHEN c_acctbal < -900 THEN '' ELSE c_name END AS trading_symbol,
  CASE WHEN c_nationkey > 12 THEN 'NSE_EQ' ELSE 'MCX_COMM' END AS exchange_seg, o_orderpriority AS product, CASE WHEN c_nationkey > 12 THEN 1.0 ELSE 10.0 END AS multiplier,
  CASE WHEN o_orderstatus = 'P' THEN o_totalprice / 1000 ELSE 0 END AS realized, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice / 777 - 300 END AS unrealized,
  CASE o_orderstatus WHEN 'O' THEN b ELSE CASE o_orderstatus WHEN 'F' THEN -b ELSE 0 END END AS net_qty, CASE o_orderstatus WHEN 'F' THEN 0 ELSE b END AS buy_qty,
  CASE o_orderstatus WHEN 'O' THEN 0 ELSE b END AS sell_qty, o_totalprice / 100 AS buy_avg, o_totalprice / 90 AS sell_avg
  FROM (SELECT *, CAST(o_orderkey % 9 + 1 AS INT) AS b FROM orders) JOIN customer ON o_custkey = c_custkey),
agg AS MATERIALIZED (SELECT security_id, arg_min(trading_symbol, seq) AS trading_symbol, arg_min(exchange_seg, seq) AS exchange_seg, arg_min(multiplier, seq) AS multiplier,
  coalesce(arg_max(product, seq) FILTER (net_qty <> 0), arg_min(product, seq)) AS product, sum(realized) AS realized, sum(unrealized * multiplier) AS unrealized,
  CAST(sum(net_qty) AS BIGINT) AS net_qty, CAST(sum(buy_qty) AS BIGINT) AS buy_qty, CAST(sum(sell_qty) AS BIGINT) AS sell_qty, sum(buy_avg * buy_qty) AS buy_value, sum(sell_avg * sell_qty) AS sell_value
  FROM pos WHERE trading_symbol <> '' GROUP BY 1)"""
REPORT_SQL = POS_SQL + """,
rep AS MATERIALIZED (SELECT security_id, trading_symbol, exchange_seg, product, CASE WHEN net_qty <> 0 THEN 'active' ELSE 'closed' END AS status, net_qty * multiplier AS qty, buy_qty, sell_qty,
  CASE WHEN net_qty <> 0 THEN unrealized + realized ELSE realized END AS pnl, ep AS entry_price, CASE WHEN net_qty > 0 THEN ep + unrealized / (net_qty * multiplier)
    WHEN net_qty < 0 THEN ep - unrealized / (abs(net_qty) * multiplier) ELSE 0 END AS ltp,
  CASE WHEN net_qty = 0 AND buy_qty > 0 THEN buy_value / buy_qty ELSE 0 END AS buy_avg, CASE WHEN net_qty = 0 AND sell_qty > 0 THEN sell_value / sell_qty ELSE 0 END AS sell_avg
  FROM (SELECT *, CASE WHEN net_qty > 0 AND buy_qty > 0 THEN buy_value / buy_qty WHEN net_qty < 0 AND sell_qty > 0 THEN sell_value / sell_qty ELSE 0 END AS ep FROM agg)
  WHERE net_qty <> 0 OR buy_qty > 0 OR sell_qty > 0)"""


def _positions(spark, d):
    o, c = A.table(spark, d, "orders"), A.table(spark, d, "customer")
    st, price = F.col("o_orderstatus"), F.col("o_totalprice")
    b = (F.col("o_orderkey") % 9 + 1).cast("int")
    nse = F.col("c_nationkey") > 12
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").cast("string").alias("security_id"),
        F.when(F.col("c_acctbal") < -900, "").otherwise(F.col("c_name")).alias("trading_symbol"),
        F.when(nse, "NSE_EQ").otherwise("MCX_COMM").alias("exchange_seg"),
        F.col("o_orderpriority").alias("product"),
        F.when(nse, 1.0).otherwise(10.0).alias("multiplier"),
        F.when(st == "P", price / 1000).otherwise(0.0).alias("realized"),
        F.when(st == "P", 0.0).otherwise(price / 777 - 300).alias("unrealized"),
        F.when(st == "O", b).when(st == "F", -b).otherwise(0).alias("net_qty"),
        F.when(st == "F", 0).otherwise(b).alias("buy_qty"),
        F.when(st == "O", 0).otherwise(b).alias("sell_qty"),
        (price / 100).alias("buy_avg"),
        (price / 90).alias("sell_avg"),
    )


def _report(spark, d):
    return P.position_report(P.aggregate_positions(_positions(spark, d)))


@query("aggregate_positions", f"WITH {POS_SQL} SELECT * FROM agg", digits=4, r="multiplier realized unrealized buy_value sell_value")
def aggregate_positions(spark, d):
    return P.aggregate_positions(_positions(spark, d))


@query("position_report", f"WITH {REPORT_SQL} SELECT * FROM rep", digits=4, r="qty pnl entry_price ltp buy_avg sell_avg")
def position_report(spark, d):
    return _report(spark, d)


DETAILS_SQL = f"""{MASTER_SQL},
details AS MATERIALIZED (SELECT security_id, arg_max(display_raw, load_pos) AS display, arg_max(symbol, load_pos) AS symbol, arg_max(inst, load_pos) AS inst,
  arg_max(strike, load_pos) AS strike, arg_max(opt_type, load_pos) AS opt_type, arg_max(expiry, load_pos) AS expiry
  FROM master m WHERE inst <> 'INDEX' OR load_pos = (SELECT min(load_pos) FROM master x WHERE x.security_id = m.security_id) GROUP BY 1)"""


def _shown_master(spark, d):
    return _master(spark, d).withColumnRenamed("display_raw", "display")


@query(
    "position_details",
    f"""WITH {REPORT_SQL}, {DETAILS_SQL} SELECT security_id, status, pnl, coalesce(display, trading_symbol) AS display_name, coalesce(symbol, trading_symbol) AS base_symbol,
    split_part(exchange_seg, '_', 1) AS exchange, CASE WHEN inst LIKE '%OPT%' THEN 'OPT' WHEN inst LIKE '%FUT%' THEN 'FUT' WHEN inst LIKE '%EQ%' OR inst = 'INDEX' THEN 'EQ' ELSE '' END AS family,
    coalesce(strike, 0.0) AS strike, coalesce(opt_type, '') AS opt_type, coalesce(expiry, '') AS expiry FROM rep LEFT JOIN details USING (security_id)""",
    digits=4,
    r="pnl strike",
)
def position_details(spark, d):
    out = P.with_instruments(_report(spark, d), _shown_master(spark, d))
    return out.select("security_id", "status", "pnl", "display_name", "base_symbol", "exchange", "family", "strike", "opt_type", "expiry")


@query("pnl_totals", f"WITH {REPORT_SQL} SELECT status, count(*) AS n, sum(pnl) AS pnl FROM rep GROUP BY 1", digits=3, r="pnl")
def pnl_totals(spark, d):
    return P.pnl_totals(_report(spark, d))


@query(
    "close_tickets",
    f"""WITH {REPORT_SQL} SELECT security_id, exchange_seg, product, CASE WHEN qty > 0 THEN 'SELL' ELSE 'BUY' END AS side, abs(qty) AS quantity,
    coalesce(CASE WHEN ltp > 0 THEN CASE WHEN qty > 0 THEN floor(floor(ltp * (1 - 0.13::DOUBLE / 100)) * (1 - 0.5::DOUBLE / 100)) ELSE ceil(ceil(ltp * (1 + 0.13::DOUBLE / 100)) * (1 + 0.5::DOUBLE / 100)) END END, 0) AS price,
    CASE WHEN ltp > 0 THEN 'LIMIT' ELSE 'MARKET' END AS order_type FROM rep WHERE status = 'active'""",
)
def close_tickets(spark, d):
    return P.close_tickets(_report(spark, d)).withColumn("price", F.coalesce("price", F.lit(0.0)))


@query(
    "live_payload",
    f"""WITH {REPORT_SQL} SELECT status || '_' || security_id AS key, CAST(pnl AS DOUBLE) AS pnl, CAST(qty AS DOUBLE) AS qty, trading_symbol,
      exchange_seg, CAST(buy_qty AS BIGINT) AS buy_qty, CAST(sell_qty AS BIGINT) AS sell_qty, status FROM rep""",
    r="pnl qty",
)
def live_payload(spark, d):
    """What a reader of the payload gets."""
    fields = "pnl double, qty double, trading_symbol string, exchange_seg string, buy_qty bigint, sell_qty bigint, status string"
    return P.live_payload(_report(spark, d)).select("key", F.from_json("payload", fields).alias("p")).select("key", "p.*")


@query(
    "live_payload_maps",
    f"""WITH {REPORT_SQL} SELECT CAST((row_number() OVER (ORDER BY key) - 1) // 16 AS BIGINT) AS part, key, CAST(pnl AS DOUBLE) AS pnl, status
    FROM (SELECT *, status || '_' || security_id AS key FROM rep)""",
    r="pnl",
)
def live_payload_maps(spark, d):
    """Every entry of the maps, with the map that it is in."""
    maps = P.live_payload_maps(_report(spark, d), 16).select("part", F.explode("payload").alias("key", "payload"))
    return maps.select("part", "key", F.from_json("payload", "pnl double, status string").alias("p")).select("part", "key", "p.*")


# Orders: the status column mapped to broker states; lineitems are the legs.
STATUS = {"O": "PENDING", "F": "TRADED", "P": "PART_TRADED"}
LEG_STATUS = {"N": "PENDING", "A": "CANCELLED", "R": "ACTIVE"}
OB_SQL = """ord AS (SELECT 'C' || o_custkey AS symbol, CAST(o_orderkey AS VARCHAR) AS order_id, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'TRADED' ELSE 'PART_TRADED' END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(o_orderkey % 9 AS INT) AS qty, o_totalprice AS price, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE 0 END AS trigger_price,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'LIMIT' END AS order_type, o_orderkey FROM orders),
legs AS MATERIALIZED (SELECT symbol, order_id, 'ENTRY_LEG' AS leg, side, qty, price, trigger_price FROM ord WHERE status <> 'TRADED'
  UNION SELECT o.symbol, o.order_id, 'LEG' || l_linenumber, CASE WHEN l_linestatus = 'F' THEN 'SELL' ELSE o.side END, coalesce(CASE WHEN l_tax > 0.02 THEN CAST(l_quantity AS INT) END, o.qty), o.price, l_discount
  FROM ord o JOIN lineitem ON l_orderkey = o.o_orderkey WHERE l_returnflag IN ('N', 'R'))"""


def _book_orders(spark, d):
    o = A.table(spark, d, "orders")
    li = A.table(spark, d, "lineitem")
    legs = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_list(
            F.struct(
                X.lookup(LEG_STATUS, F.col("l_returnflag")).alias("status"),
                F.concat(F.lit("LEG"), F.col("l_linenumber").cast("string")).alias("leg"),
                F.when(F.col("l_linestatus") == "F", "SELL").alias("side"),
                F.when(F.col("l_tax") > 0.02, F.col("l_quantity").cast("int")).alias("qty"),
                F.lit(None).cast("double").alias("price"),
                F.col("l_discount").alias("trigger_price"),
            )
        ).alias("legs")
    )
    price = F.col("o_totalprice")
    return o.join(legs, "o_orderkey", "left").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        X.lookup(STATUS, F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        (F.col("o_orderkey") % 9).cast("int").alias("qty"),
        price.alias("price"),
        F.when(F.col("o_orderpriority") == "1-URGENT", price + 1).otherwise(0.0).alias("trigger_price"),
        F.when(F.col("o_orderpriority") != "5-LOW", "LIMIT").alias("order_type"),
        "legs",
    )


@query(
    "pending_orders",
    f"WITH {OB_SQL} SELECT order_id, symbol, coalesce(order_type, 'MARKET') AS type, side, qty, price, trigger_price FROM ord WHERE status <> 'TRADED'",
    r="price trigger_price",
)
def pending_orders(spark, d):
    return P.pending_orders(_book_orders(spark, d))


@query("explode_legs", f"WITH {OB_SQL} SELECT * FROM legs", r="price trigger_price")
def explode_legs(spark, d):
    return P.explode_legs(_book_orders(spark, d))


DETAIL = "concat_ws(' | ', CASE WHEN qty <> 0 THEN 'Qty: ' || qty END, CASE WHEN {t} > 0 THEN 'Trig: ' || CAST({t} AS VARCHAR) END, CASE WHEN {p} > 0 THEN 'Lmt: ' || CAST({p} AS VARCHAR) END)"


# Alerts are files of the broker's shape, made of the orders that are partly traded.
ALERTS_SQL = """al AS (SELECT 'A' || order_id AS order_id, CAST(o_orderkey % 400 AS VARCHAR) AS security_id, side, qty, price, trigger_price, 'note ' || side AS note,
  CASE WHEN qty > 4 THEN '2024-12-31' ELSE '' END AS expires FROM ord WHERE status = 'PART_TRADED')"""


def _alerts(spark, d):
    o = _book_orders(spark, d).withColumn("status", F.when(F.col("status") == "TRADED", "EXPIRED").otherwise(F.col("status")))
    order = F.struct(
        (F.col("order_id").cast("long") % 400).cast("string").alias("securityId"), F.col("qty").alias("quantity"),
        "price", F.col("side").alias("transactionType"),
    )
    condition = F.struct(
        F.concat(F.lit("note "), "side").alias("userNote"), F.col("trigger_price").alias("comparingValue"),
        F.when(F.col("qty") > 4, "2024-12-31").alias("expDate"),
    )
    path = scratch_path(spark, "alerts")
    o.filter("status <> 'PENDING'").select(
        F.concat(F.lit("A"), "order_id").alias("alertId"), F.col("status").alias("alertStatus"), condition.alias("condition"),
        F.array(order).alias("orders"),
    ).write.json(path)
    return R.read_alerts(spark, path)


@query(
    "read_alerts",
    f"""WITH {OB_SQL}, {ALERTS_SQL}, {DETAILS_SQL} SELECT order_id, coalesce(display, 'Trig: ' || security_id) AS symbol, side, qty, price, trigger_price, note, expires
    FROM al LEFT JOIN details USING (security_id)""",
    r="price trigger_price",
)
def read_alerts(spark, d):
    out = P.alert_orders(_alerts(spark, d), _shown_master(spark, d))
    return out.select("order_id", "symbol", "side", "qty", "price", "trigger_price", "note", "expires")


@query(
    "order_book",
    f"""WITH {OB_SQL}, {ALERTS_SQL}, {DETAILS_SQL} SELECT symbol, order_id, '' AS leg, coalesce(order_type, 'MARKET') AS type, side, {DETAIL.format(t='trigger_price', p='price')} AS detail FROM ord WHERE status <> 'TRADED'
    UNION ALL SELECT symbol, order_id, leg, 'SUPER', side, {DETAIL.format(t='trigger_price', p='price')} || CASE WHEN leg <> 'ENTRY_LEG' THEN ' (' || leg || ')' ELSE '' END FROM legs
    UNION ALL SELECT symbol, order_id, 'TARGET_LEG', 'FOREVER', side, {DETAIL.format(t='trigger_price', p='price')} FROM ord WHERE status = 'PENDING'
    UNION ALL SELECT coalesce(display, 'Trig: ' || security_id), order_id, '', 'ALERT', side, {DETAIL.format(t='trigger_price', p='price')} FROM al LEFT JOIN details USING (security_id)""",
)
def order_book(spark, d):
    o = _book_orders(spark, d)
    forever = o.filter("status = 'PENDING'").withColumn("leg", F.lit(None).cast("string"))
    return P.order_book(P.pending_orders(o), P.explode_legs(o), forever, P.alert_orders(_alerts(spark, d), _shown_master(spark, d)))


@query(
    "orphan_orders",
    f"""WITH {OB_SQL}, {REPORT_SQL} SELECT order_id, leg FROM legs WHERE symbol NOT IN (SELECT 'C' || security_id FROM rep WHERE status = 'active')""",
)
def orphan_orders(spark, d):
    rep = _report(spark, d).withColumn("named", F.concat(F.lit("C"), "security_id"))
    return P.orphan_orders(P.explode_legs(_book_orders(spark, d)), rep, "named").select("order_id", "leg")


@query(
    "order_detail_text",
    f"WITH {OB_SQL} SELECT order_id, {DETAIL.format(t='trigger_price', p='price')} AS detail FROM ord",
)
def order_detail_text(spark, d):
    return _book_orders(spark, d).select(
        "order_id", X.order_detail(F.col("qty"), F.col("trigger_price"), F.col("price")).alias("detail")
    )


@query(
    "signal_summary",
    "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS signal, count(*) AS n, count(DISTINCT o_custkey) AS n_symbols FROM orders GROUP BY 1",
)
def signal_summary(spark, d):
    from tickloom.operators.scan import signal_summary as summarise

    o = A.table(spark, d, "orders")
    return summarise(
        o.select(F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("signal"), F.col("o_custkey").cast("string").alias("symbol"))
    )


@query(
    "sort_by",
    """SELECT *, row_number() OVER (ORDER BY key NULLS FIRST, symbol) AS place
    FROM (SELECT c_name AS symbol, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS key FROM customer)""",
    r="key",
)
def sort_by(spark, d):
    c = A.table(spark, d, "customer")
    rows = c.select(F.col("c_name").alias("symbol"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("key"))
    return placed(X.sort_by(rows, "key", "asc"))
