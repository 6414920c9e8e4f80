"""Fuzzy matching against comparing everything with everything; rules worked by hand."""

import math
import random

from pyspark.sql import functions as F

from tickloom.functions import scalar as X
from tickloom.operators import instruments as N
from tickloom.operators import match as M
from tickloom.operators import tickets as T


def grams(w):
    w = f"${w}^"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def edit(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def brute(q, names):
    if q in names:
        return q
    scored = []
    for c in names:
        cg = set(grams(c))
        ov = sum(g in cg for g in grams(q))
        if ov:
            scored.append((2 * ov / (len(grams(q)) + len(grams(c))), ov, c))
    good = [x for x in scored if x[0] >= 0.7]
    if good:
        return min(good, key=lambda x: (-x[0], x[2]))[2]
    near = [(edit(q, c), -ov, c) for _, ov, c in scored if edit(q, c) <= 2]
    return min(near)[2] if near else None


def test_fuzzy_equals_brute_force(spark):
    rng = random.Random(3)
    names = {"".join(rng.choice("ABCD") for _ in range(rng.randint(1, 12))) for _ in range(150)}
    queries = set()
    for n in sorted(names):
        for _ in range(2):
            w = list(n)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randint(0, 1)] = rng.choice(["", "A", "B", "E"])
            if w:
                queries.add("".join(w))
    queries |= {"RELIANCF", "HDFCBNAK", "INFI", "BANKNIFTYY"}
    names |= {"RELIANCE", "HDFCBANK", "INFY", "BANKNIFTY"}
    queries = {q for q in queries if q}
    q = spark.createDataFrame([(x,) for x in sorted(queries)], "query STRING")
    c = spark.createDataFrame([(x,) for x in sorted(names)], "symbol STRING")
    got = {r.query: r.symbol for r in M.fuzzy_match(q, c).collect()}
    assert got == {x: brute(x, names) for x in queries}
    assert got["RELIANCF"] == "RELIANCE" and got["HDFCBNAK"] == "HDFCBANK" and got["INFI"] == "INFY"


def test_strikes(spark):
    cases = [
        ("NIFTY", 22475.0, "BUY", 22400), ("NIFTY", 22515.0, "SELL", 22600), ("GOLD", 71540.0, "BUY", 71000),
        ("SILVER", 85350.0, "BUY", 85000), ("CRUDEOIL", 6525.0, "SELL", 6600), ("X", 1073.0, "BUY", 1060),
        ("X", 1028.0, "SELL", 1040), ("X", 2870.0, "BUY", 2850), ("X", 2910.0, "SELL", 2950), ("X", 1640.0, "BUY", 1640),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "symbol STRING, price DOUBLE, signal STRING")
    assert [r.strike for r in N.strike_price(df).collect()] == [c[3] for c in cases]
    bad = spark.createDataFrame([("X", 0.0, "BUY"), ("X", 5.0, "HOLD")], "symbol STRING, price DOUBLE, signal STRING")
    assert [(r.strike, r.reject is None) for r in N.strike_price(bad).collect()] == [(None, False)] * 2
    q = spark.range(1).select(T.order_quantity(F.lit(50000.0), F.lit(1075.0), F.lit(1), F.lit(1)).alias("q"))
    assert q.first().q == 47


def test_query_parsing(spark):
    df = spark.createDataFrame([("nifty 22500 ce may",), ("the bank fut",), ("x",)], "query STRING")
    got = {r.query: r for r in M.parse_queries(df).collect()}
    a, b = got["nifty 22500 ce may"], got["the bank fut"]
    assert (a.name_tokens, a.strike_int, a.opt, a.month, a.want_fut) == (["NIFTY"], 22500, "CE", "MAY", False)
    assert (b.name_tokens, b.strike_int, b.opt, b.month, b.want_fut) == (["BANK"], None, None, None, True)
    assert "x" not in got


def test_sorted_output_keeps_its_order(spark):
    rows = spark.createDataFrame([("B", 2.0), ("A", None), ("C", 3.0), ("D", 2.0)], "symbol STRING, key DOUBLE")
    for way, want in (("asc", "BDC"), ("desc", "CBD")):
        got = "".join(r.symbol for r in X.sort_by(rows, "key", way).collect())
        assert got.replace("A", "") == want, got


def test_interval_blocks_cover_exactly(spark):
    rng = random.Random(2)
    spans = [(f"t{k}", *sorted((rng.randrange(20000), rng.randrange(20000)))) for k in range(60)]
    spans += [("one", 63, 63), ("edge", 64, 127), ("all", 0, 4095), ("wide", 4095, 8192)]
    df = spark.createDataFrame(spans, "token STRING, lo LONG, hi LONG")
    got = {}
    for r in M.interval_blocks(df).collect():
        got.setdefault(r.token, []).extend(range(r.blk << 6 * r.level, (r.blk + 1) << 6 * r.level))
    assert all(sorted(got[t]) == list(range(lo, hi + 1)) for t, lo, hi in spans)
    assert M.interval_blocks(df.filter("token = 'all'")).count() == 1


def test_prefix_is_one_interval(spark):
    words = ["NIFTY", "NIFT", "BANK", "NI", "ZED", "BANKNIFTY", "N&M"]
    vocab = M.number_words(spark.createDataFrame([(w, k + 1) for k, w in enumerate(words)], "word STRING, df LONG"))
    tokens = spark.createDataFrame([("N",), ("NIF",), ("B",), ("X",)], "token STRING")
    order = sorted(words)
    got = {r.token: (order[r.lo : r.hi + 1], r.df) for r in M.prefix_intervals(tokens, vocab).collect()}
    assert got == {"N": (["N&M", "NI", "NIFT", "NIFTY"], 14), "NIF": (["NIFT", "NIFTY"], 3), "B": (["BANK", "BANKNIFTY"], 9)}


def score_all(query, entries, aliases=None):
    """The ranking worked out contract by contract."""
    import re as _re

    from tickloom.functions import constants as K

    months = {w: m for m, ws in K.MONTH_WORDS.items() for w in ws}
    parts = [w for w in query.strip().upper().replace("-", " ").split() if w not in K.STOP_WORDS]
    parts = [(aliases or {}).get(w, w) for w in parts]
    number = lambda w: float(w) if _re.fullmatch(r"[+]?([0-9]+\.?[0-9]*|\.[0-9]+)", w) else None
    special = set(months) | set(K.CALL_WORDS) | set(K.PUT_WORDS) | set(K.FUTURE_WORDS)
    names = [w for w in parts if w not in special and number(w) is None]
    sides = [w for w in parts if w in K.CALL_WORDS + K.PUT_WORDS]
    opt = ("CE" if sides[-1] in K.CALL_WORDS else "PE") if sides else None
    month = ([months[w] for w in parts if w in months] or [None])[-1]
    fut = any(w in K.FUTURE_WORDS for w in parts)
    strikes = [number(w) for w in parts if w not in special and (number(w) or 0) > 0]
    strike = round(strikes[-1]) if strikes else None
    seq = lambda t, w: _re.search(".*".join(map(_re.escape, t)), w)
    vocab = [w for e in entries for w in e["tokens"]]
    idf = lambda t: math.log(len(entries) / vocab.count(t)) + 1 if t in vocab else 1

    def hit(t, e):
        if any(w.startswith(t) for w in vocab):
            return any(w.startswith(t) for w in e["tokens"])
        return any(seq(t, w) for w in e["tokens"])

    def points(t, e):
        sym, w = e["symbol"], idf(t) * 100
        if sym == t:
            return 1000 + w
        if sym.startswith(t) or t.startswith(sym):
            return 400 + w
        if seq(t, sym):
            return 200 + w / 2
        if t in e["tokens"]:
            return w
        if any(x.startswith(t) for x in e["tokens"]):
            return w * 0.8
        return w * 0.4 if any(seq(t, x) for x in e["tokens"]) else None

    strict = [e for e in entries if names and all(hit(t, e) for t in names)]
    pool = strict or ([e for e in entries if any(hit(t, e) for t in names)] if names else entries)
    out = []
    for e in pool:
        if opt and e["opt_type"] != opt or not opt and fut and e["inst_type"] != "FUT":
            continue
        if month and e["month_tag"] != month or strike is not None and not (e["strike"] > 0 and e["strike"] == strike):
            continue
        got = [points(t, e) for t in names]
        score = sum(p or 0 for p in got) + (200 if strict and None not in got else 0)
        score += 50 if e["expiry"] == "" and not (month or strike or opt or fut) else 0
        out.append((-round(score, 6), e["expiry"], e["strike"], e["entry_id"]))
    return [(i, -s) for s, _, _, i in sorted(out)[:4]]


def test_search_equals_scoring_every_contract(spark):
    """Few documents are scored and few contracts meet them, yet the lists are those of scoring all of them."""
    rng, rows = random.Random(5), []
    symbols = ["NIFTY", "NIFTYIT", "BANKNIFTY", "NATION", "INFY", "N", "TCS", "TATA", "TATAPOWER", "ONGC", "NTPC", "BANK"]
    for k in range(400):
        s = rng.choice(symbols)
        kind = rng.choice(["EQ", "FUT", "OPT", "OPT"])
        day = "" if kind == "EQ" else rng.choice(["2024-03-28", "2024-06-27"])
        strike = float(rng.choice([100, 120, 150])) if kind == "OPT" else 0.0
        opt = rng.choice(["CE", "PE"]) if kind == "OPT" else ""
        tag = {"": "", "2024-03-28": "MAR", "2024-06-27": "JUN"}[day]
        name = {"TCS": "Tata Consultancy", "ONGC": "Oil Natural Gas"}.get(s, "")
        rows.append((k, s, f"{s} {tag} thing{rng.randrange(3)}", kind, day, strike, opt, tag, name))
    schema = "entry_id LONG, symbol STRING, display STRING, inst_type STRING, expiry STRING, strike DOUBLE, opt_type STRING, month_tag STRING, company STRING"
    inst = spark.createDataFrame(rows, schema)
    queries = ["n", "nifty", "t", "tata", "tata consult", "bank nifty", "nifty 120 ce", "fut", "june put", "tps", "ny zz", "gas oil march",
               "nif call", "150", "xqz", "thing1 t fut", "thing2", "nt thing0 mar", "bees", "o g"]
    got = M.search_instruments(spark.createDataFrame([(q,) for q in queries], "query STRING"), inst, 4, {"BEES": "BANKNIFTY"}).collect()
    entries = [r.asDict() for r in M.build_search_index(inst)[0].collect()]
    for q in queries:
        own = sorted((r.rank, r.entry_id, round(r.score, 6)) for r in got if r.query == q)
        want = score_all(q, entries, {"BEES": "BANKNIFTY"}) if len(q) >= 2 else []
        assert [x[1:] for x in own] == [(i, round(s, 6)) for i, s in want], q
    assert {r.query for r in got} >= {"bees", "tata consult", "nifty 120 ce"}
