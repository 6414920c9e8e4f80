"""Signal machines, deals, zones and extremes against bar-by-bar loops."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import signals as G
from tickloom.operators import structure as M


def walk(spark, n=400, symbols=3, seed=1):
    rng, rows = random.Random(seed), []
    for s in range(symbols):
        price = 100.0
        for b in range(1, n + 1):
            o = price
            price = max(5.0, price + rng.gauss(0, 2))
            hi, lo = max(o, price) + rng.random(), min(o, price) - rng.random()
            rows.append((f"S{s}", b, o, hi, lo, price, rng.choice([0] * 30 + [3, 4])))
    schema = "symbol STRING, bar INT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, raw INT"
    return spark.createDataFrame(rows, schema)


def by_symbol(df):
    out = {}
    for r in df.orderBy("symbol", "bar").collect():
        out.setdefault(r.symbol, []).append(r)
    return out


def flat_long_short(raw):
    """A position series: enter on 3 or 4 when flat, leave on the opposite side."""
    code, pos = [], 0
    for r in raw:
        if pos == 0 and r in (3, 4):
            pos = 1 if r == 3 else -1
            code.append(r)
        elif pos == 1 and r in (2, 4):
            pos = 0
            code.append(5)
        elif pos == -1 and r in (1, 3):
            pos = 0
            code.append(6)
        else:
            code.append({0: 0, 1: 1, -1: 2}[pos])
    return code


def confirm(rows, codes, level):
    """The trigger ladder as carried variables, one bar at a time."""
    tr, atr, out = [], [], []
    base = {"L": None, "S": None}
    steps = {"L": [None, None], "S": [None, None]}
    active = long = short = False
    for i, r in enumerate(rows):
        c = rows[i - 1].close if i else None
        tr.append(r.high - r.low if c is None else max(r.high - r.low, abs(r.high - c), abs(r.low - c)))
        atr.append(None if i < 4 else sum(tr[:5]) / 5 if i == 4 else atr[-1] + (tr[-1] - atr[-1]) / 5)
        now, was = codes[i], codes[i - 1] if i else 0
        last3 = rows[max(0, i - 2) : i + 1]
        if was == 3:
            base["L"] = None if atr[i] is None else max(x.high for x in last3) + atr[i]
        if was == 4:
            base["S"] = None if atr[i] is None else min(x.low for x in last3) - atr[i]
        if now == 5:
            base["L"], steps["L"] = None, [None, None]
        if now == 6:
            base["S"], steps["S"] = None, [None, None]
        hits = {}
        for side, ext in (("L", r.high), ("S", r.low)):
            marks = [base[side]] + steps[side]
            hits[side] = []
            for k in range(3):
                m = marks[k] if k == 0 else steps[side][k - 1]
                beyond = m is not None and (r.close > m if side == "L" else r.close < m)
                hit = not active and beyond
                hits[side].append(hit)
                if k < 2 and hit and steps[side][k] is None:
                    steps[side][k] = ext
        in_l, in_s = hits["L"][level - 1], hits["S"][level - 1]
        active = active or in_l or in_s
        long, short = active and (in_l or long), active and (in_s or short)
        out_l, out_s = now == 5 and active, now == 6 and active
        if out_l or out_s:
            active = False
        out.append(5 if out_l else 6 if out_s else 3 if in_l else 4 if in_s else 1 if long else 2 if short else 0)
    return out


@pytest.mark.parametrize("level", [1, 2, 3])
def test_confirmation_ladder(spark, level):
    df = walk(spark, 1500, 2, seed=level)
    rows = by_symbol(df)
    codes = {s: flat_long_short([r.raw for r in rs]) for s, rs in rows.items()}
    flat = [(s, r.bar, c) for s, rs in rows.items() for r, c in zip(rs, codes[s])]
    coded = df.join(spark.createDataFrame(flat, "symbol STRING, bar INT, code INT"), ["symbol", "bar"])
    got = by_symbol(G.confirm_signal(coded, level))
    for s, rs in rows.items():
        want = confirm(rs, codes[s], level)
        assert any(c in (3, 4) for c in want)
        assert [r.confirmed for r in got[s]] == want


def test_deals(spark):
    rows = [("A", b, c, k) for b, (c, k) in enumerate(
        [(10.0, 0), (10.0, 3), (12.0, 1), (11.0, 5), (11.0, 0), (20.0, 4), (16.0, 2), (25.0, 6), (25.0, 3), (30.0, 1)], 1)]
    df = spark.createDataFrame(rows, "symbol STRING, bar INT, close DOUBLE, code INT")
    led = G.deal_ledger(df).orderBy("deal").collect()
    assert [(r.entry, round(r.profit, 4), round(r.max_profit, 4), r.closed) for r in led] == [
        (10, 10, 20, True), (20, -20, 25, True), (25, 20, 20, False)
    ]
    closed = G.deal_stats(G.deal_ledger(df), count_open=False).first()
    assert (closed.deals, closed.wins, round(closed.total_max_profit, 4)) == (2, 1, 45)
    every = G.deal_stats(G.deal_ledger(df)).first()
    assert (every.deals, every.wins) == (3, 2)
    s = spark.createDataFrame([(4.0, 1.0), (0.0, 0.0)], "m DOUBLE, p DOUBLE")
    assert [r.x for r in s.select(G.profit_strength(F.col("m"), F.col("p")).alias("x")).collect()] == [25, 100]


def test_a_deal_keeps_the_profit_of_its_last_bar_that_has_one(spark):
    rows = [("A", 1, 20.0, 4), ("A", 2, 16.0, 2), ("A", 3, 0.0, 6), ("A", 4, 30.0, 4), ("A", 5, 40.0, 2), ("A", 6, 0.0, 2)]
    df = spark.createDataFrame(rows, "symbol STRING, bar INT, close DOUBLE, code INT")
    led = G.deal_ledger(df).orderBy("deal").collect()
    assert [(r.last_bar, r.profit, r.max_profit, r.closed) for r in led] == [(3, 25.0, 25.0, True), (6, -25.0, 0.0, False)]
    got = G.stats_table(G.deal_stats(G.deal_ledger(df))).first()
    assert (got.deals, got.total_max_profit, got.win_rate) == (2, 25.0, 0.5)


def test_trailing_extreme_bars(spark):
    df = walk(spark, 300, 2, seed=8)
    piv = {(r.symbol, r.bar, r.side): r.level for r in M.pivots(df, 10).collect()}
    got = by_symbol(M.trailing_extremes(df, swing=10))
    for s, rows in by_symbol(df).items():
        top = low = top_bar = low_bar = None
        for r, g in zip(rows, got[s]):
            if top is not None:
                top = max(top, r.high)
                top_bar = r.bar if top == r.high else top_bar
            if low is not None:
                low = min(low, r.low)
                low_bar = r.bar if low == r.low else low_bar
            assert (g.top, g.top_bar, g.bottom, g.bottom_bar) == (top, top_bar, low, low_bar)
            if (s, r.bar, "high") in piv:
                top, top_bar = piv[s, r.bar, "high"], r.bar - 10
            if (s, r.bar, "low") in piv:
                low, low_bar = piv[s, r.bar, "low"], r.bar - 10


def test_confluence_breaks_are_first_qualifying_crosses(spark):
    df = walk(spark, 300, 2, seed=4)
    cols = by_symbol(M.structure_columns(df, 20, 5, use_confluence=True))
    for rows in cols.values():
        crossed_up = True
        for i, r in enumerate(rows):
            if r.i_new_high is not None:
                crossed_up = False
            p = rows[i - 1] if i else None
            upper, lower = r.high - max(r.close, r.open), min(r.close, r.open - r.low)
            up = (
                p is not None and None not in (p.i_high, r.i_high, r.s_high)
                and r.close > r.i_high and p.close <= p.i_high and r.i_high != r.s_high and upper > lower
            )
            assert r.i_up == (up and not crossed_up)
            crossed_up = crossed_up or up


def test_an_open_of_zero_makes_no_gap_and_leaves_the_mean(spark):
    rng, rows, price = random.Random(6), [], 50.0
    for b in range(1, 200):
        o = 0.0 if b % 17 == 3 else price
        price += rng.choice([-9, -1, 1, 9]) * rng.random()
        rows.append(("A", b, o, max(o, price) + 0.1, min(o, price) - 0.1, price))
    df = spark.createDataFrame(rows, "symbol STRING, bar INT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE")
    want, total = [], 0.0
    for k in range(2, len(rows)):
        (_, _, o, _, _, c), (_, bar, _, high, low, _) = rows[k - 1], rows[k]
        bodies = [abs(r[5] - r[2]) / (r[2] * 100) for r in rows[:k] if r[2]]
        total = sum(bodies) / k * 2
        if o:
            body, (h2, l2) = (c - o) / (o * 100), rows[k - 2][3:5]
            want += [(bar, 1, low, h2)] if low > h2 and c > h2 and body > total else []
            want += [(bar, -1, high, l2)] if high < l2 and c < l2 and -body > total else []
    got = M.fair_value_gaps(df).orderBy("bar", "bias").collect()
    assert want and [tuple(r)[1:] for r in got] == want
    deals = df.withColumn("code", F.when(F.col("bar") == 3, 3).when(F.col("bar") == 9, 5).otherwise(F.when(F.col("bar").between(4, 8), 1).otherwise(0)))
    assert G.deal_ledger(deals, c="open").first().profit is None


@pytest.mark.parametrize("bits,from_next", [(1, False), (2, True), (6, False)])
def test_first_crossing_equals_a_scan(spark, bits, from_next):
    """Zones of both kinds against every later bar: gaps in bar numbers, ties with the level, missing prices, no crossing."""
    rng, bars, zones = random.Random(bits), [], []
    for s in ("A", "B"):
        price, at = 100.0, rng.randrange(5)
        for _ in range(300 if s == "A" else 40):
            at += rng.choice([1, 1, 1, 2, 9])
            price += rng.choice([-1, 0, 1])
            bars.append((s, at, None if rng.random() < 0.05 else price + 1, price - 1, price))
        own = [b for b in bars if b[0] == s]
        for _ in range(120):
            b = rng.choice(own)
            level = b[4] + rng.choice([-25, -9, -3, -1, 0, 1, 3, 9, 25])
            zones.append((s, b[1], rng.choice([1, -1]), level, level))
    zones.append(("C", 3, 1, 1.0, 1.0))
    b = spark.createDataFrame(bars, "symbol STRING, bar INT, high DOUBLE, low DOUBLE, close DOUBLE")
    z = spark.createDataFrame(zones, "symbol STRING, bar INT, bias INT, top DOUBLE, bottom DOUBLE")
    for source in ("highlow", "close"):
        want = []
        for s, at, bias, top, bottom in zones:
            for s2, bar, high, low, close in bars:
                h, lo = (close, close) if source == "close" else (high, low)
                later = s2 == s and (bar > at if from_next else bar >= at)
                if later and (lo < bottom if bias == 1 else h is not None and h > top):
                    want.append((s, at, bias, top, bottom, bar))
                    break
        got = M.mitigation_bars(z, b, source, from_next, bits).collect()
        assert sorted(map(tuple, got)) == sorted(want) and len(want) < len(zones)
    assert M.mitigation_bars(z, b.limit(0)).count() == 0
    assert M.mitigation_bars(z.limit(0), b).count() == 0
