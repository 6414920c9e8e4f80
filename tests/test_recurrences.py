"""Averages, the latch and the indicators against plain recurrences."""

import functools
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions.recurrence import decayed_in_blocks, latched
from tickloom.functions.statescan import scan_states, step_map
from tickloom.operators import indicators as I

# Twenty-eight closes whose averages were worked out by hand.
PRICES = [
    150.0, 152.5, 151.0, 153.0, 155.5, 157.0, 158.0,
]


def series(spark, values, symbol="A"):
    rows = [(symbol, i, v) for i, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, "symbol STRING, bar INT, x DOUBLE")


def values(df, col="y"):
    return [r[col] for r in df.orderBy("bar").collect()]


def fold(xs, alpha):
    out = []
    for x in xs:
        out.append(x if not out else alpha * x + (1 - alpha) * out[-1])
    return out


def restarting(xs, n):
    """Restart with the mean of n values after every missing value."""
    out, run, last = [], [], None
    for x in xs:
        if x is None:
            run, last = [], None
        else:
            run.append(x)
            last = (
                None if len(run) < n else sum(run) / n if len(run) == n else last + (x - last) / n
            )
        out.append(last)
    return out


@pytest.mark.parametrize("n", [1, 3, 8])
def test_first_value_seed(spark, n):
    rng = random.Random(n)
    xs = [rng.uniform(-5, 50) for _ in range(300)]
    df = series(spark, xs)
    assert values(df.withColumn("y", I.rma("x", n))) == pytest.approx(fold(xs, 1 / n), rel=1e-9)
    assert values(df.withColumn("y", I.ema("x", n))) == pytest.approx(fold(xs, 2 / (n + 1)), rel=1e-9)


def test_blocks_equal_one_pass(spark):
    rng = random.Random(5)
    xs = [rng.uniform(-1, 1) for _ in range(1000)]
    df = series(spark, xs).withColumn("pos", F.col("bar") - 1)
    for alpha, block in ((0.125, 64), (0.002, 7), (0.9, 400)):
        got = values(decayed_in_blocks(df, "symbol", "pos", "x", alpha, "y", block))
        assert got == pytest.approx(fold(xs, alpha), rel=1e-9, abs=1e-12)


def test_average_restarts_after_gaps(spark):
    rng = random.Random(9)
    xs = [None if rng.random() < 0.12 else rng.uniform(0, 9) for _ in range(400)]
    df = I.seeded_rma(series(spark, xs), {"y": ("x", 4), "z": ("x", 9)})
    for col, n in (("y", 4), ("z", 9)):
        got, want = values(df, col), restarting(xs, n)
        assert [v is None for v in got] == [v is None for v in want]
        assert [v for v in got if v is not None] == pytest.approx([v for v in want if v is not None], rel=1e-9)


def test_short_series_and_zero_warm_up(spark):
    df = series(spark, PRICES)
    assert values(df.withColumn("y", I.sma("x", 8))) == [0.0] * 7
    assert values(df.withColumn("y", I.sma("x", 7)))[-1] == pytest.approx(sum(PRICES) / 7)
    assert values(I.seeded_rma(df, {"y": ("x", 8)})) == [None] * 7
    assert values(df.withColumn("y", I.linreg3("x")))[2] == pytest.approx((-150 + 2 * 152.5 + 5 * 151) / 6)


def test_latch_equals_recurrence(spark):
    rows, want = [], {}
    for k, bits in enumerate(itertools.product([0, 1], repeat=10)):
        on = False
        for i in range(5):
            e, s = bool(bits[2 * i]), bool(bits[2 * i + 1])
            on = True if e and not on else (False if s else on)
            rows.append((f"k{k}", i, e, s))
            want[f"k{k}", i] = on
    df = spark.createDataFrame(rows, "symbol STRING, bar INT, e BOOLEAN, s BOOLEAN")
    got = {(r.symbol, r.bar): r.y for r in latched(df, "symbol", "bar", "e", "s", "y").collect()}
    assert got == want


def test_rsi_without_losses_is_100(spark):
    df = I.rsi(series(spark, [float(v) for v in range(1, 30)]), "x", 8, "y")
    assert values(df)[8:] == [100.0] * 21
    assert values(df)[:8] == [None] * 8


def test_state_scan_equals_a_loop(spark):
    """Blocks of 4 and 64 steps, several levels of them; gaps in the positions, one long and many short series."""
    rng, rows, want = random.Random(11), [], {}
    steps = [(0, 1, 2), (1, 1, 0), (2, 0, 2), (1, 2, 0), (0, 0, 0), (2, 1, 1)]
    for s, n in (("long", 700), ("gap", 90), ("one", 1), (None, 30)):
        at, state = rng.randrange(3), 1
        for _ in range(n):
            at += rng.choice([1, 1, 1, 5]) if s == "gap" else 1
            k = rng.randrange(len(steps))
            state = steps[k][state]
            rows.append((s, at, k))
            want[s, at] = state
    df = spark.createDataFrame(rows, "symbol STRING, bar INT, k INT")
    to = [functools.reduce(lambda c, k: c.when(F.col("k") == k, steps[k][j]), range(1, 6), F.when(F.col("k") == 0, steps[0][j])) for j in range(3)]
    for block in (4, 64):
        got = {(r.symbol, r.bar): r.y for r in scan_states(df, "symbol", "bar", step_map(*to), 3, "y", 1, block).collect()}
        assert got == want
    assert scan_states(df.limit(0), "symbol", "bar", step_map(*to), 3, "y").count() == 0


def test_latch_as_a_state_scan(spark):
    rng = random.Random(12)
    rows = [(s, b, rng.random() < 0.3, rng.random() < 0.3) for s in "AB" for b in range(500)]
    df = spark.createDataFrame(rows, "symbol STRING, bar INT, e BOOLEAN, s BOOLEAN")
    e, s = F.col("e"), F.col("s")
    step = step_map(F.when(e, 1).otherwise(0), F.when(s, 0).otherwise(1))
    got = {(r.symbol, r.bar): bool(r.y) for r in scan_states(df, "symbol", "bar", step, 2, "y", block=32).collect()}
    assert got == {(r.symbol, r.bar): r.y for r in latched(df, "symbol", "bar", "e", "s", "y").collect()}
