"""Market structure as event tables: pivots, breaks, order blocks, gaps, extremes.

Levels in force are last values carried along a symbol's bars, "first break of a
pivot" is a running count compared with its value when the pivot appeared, and "still
open" is a comparison with the extreme of all later bars. None of them pairs events
with bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import indicators as I
from tickloom.session import materialise

SWING, INTERNAL, EQUAL = 50, 5, 5


def legs(df: DataFrame, n: int, out: str = "leg") -> DataFrame:
    """0 after a high that tops the next ``n`` bars, 1 after a low below them, else kept."""
    hi = I.prev("high", n) > F.max("high").over(I.trailing(n))
    lo = I.prev("low", n) < F.min("low").over(I.trailing(n))
    df = df.withColumn("_leg", F.when(hi, 0).when(lo, 1))
    kept = F.last("_leg", ignorenulls=True).over(I.so_far())
    return df.withColumn(out, F.coalesce(kept, F.lit(0))).drop("_leg")


def pivot_columns(df: DataFrame, n: int, p: str) -> DataFrame:
    """Per bar: the pivot confirmed on it and the pivots in force, prefixed by ``p``.

    ``{p}_new_high`` / ``{p}_new_low`` are levels (NULL when none is confirmed),
    ``{p}_high`` / ``{p}_low`` the levels in force, ``.._id`` their running numbers.
    """
    df = legs(df, n, "_leg_now").withColumn("_step", F.col("_leg_now") - I.prev("_leg_now"))
    df = df.withColumns(
        {
            f"{p}_new_high": F.when(F.col("_step") == -1, I.prev("high", n)),
            f"{p}_new_low": F.when(F.col("_step") == 1, I.prev("low", n)),
        }
    )
    carried = {}
    for side in ("high", "low"):
        new = F.col(f"{p}_new_{side}")
        carried[f"{p}_{side}"] = F.last(new, ignorenulls=True).over(I.so_far())
        carried[f"{p}_{side}_id"] = F.count(new).over(I.so_far())
    return df.withColumns(carried).drop("_leg_now", "_step")


def pivots(df: DataFrame, n: int) -> DataFrame:
    """One row per confirmed pivot: bar of confirmation, bar of the pivot, side, level."""
    df = pivot_columns(df, n, "p")

    def event(side: str) -> Column:
        return F.when(
            F.col(f"p_new_{side}").isNotNull(),
            F.struct(F.lit(side).alias("side"), F.col(f"p_new_{side}").alias("level")),
        )

    found = F.array_compact(F.array(event("high"), event("low")))
    return df.select(
        "symbol", "bar", (F.col("bar") - n).alias("pivot_bar"), F.inline(found)
    )


def label_pivots(piv: DataFrame) -> DataFrame:
    """HH, LH, HL, LL against the previous pivot of the same side."""
    w = Window.partitionBy("symbol", "side").orderBy("bar")
    before = F.lag("level").over(w)
    high = F.when(F.coalesce(F.col("level") > before, F.lit(False)), "HH").otherwise("LH")
    low = F.when(F.coalesce(F.col("level") < before, F.lit(False)), "LL").otherwise("HL")
    return piv.withColumn("label", F.when(F.col("side") == "high", high).otherwise(low))


def equal_levels(df: DataFrame, threshold: float = 0.2, n: int = EQUAL, atr_len: int = 200) -> DataFrame:
    """Pivots within ``threshold`` average ranges of the previous one of their side."""
    df = pivot_columns(I.atr(df, atr_len, "_atr"), n, "p")
    found = []
    for side, label in (("high", "EQH"), ("low", "EQL")):
        # Level in force before this bar.
        df = df.withColumn(f"_was_{side}", I.prev(f"p_{side}"))
        new = F.col(f"p_new_{side}")
        near = F.abs(F.col(f"_was_{side}") - new) < threshold * F.col("_atr")
        found.append(F.when(near, F.struct(F.lit(label).alias("label"), new.alias("level"))))
    return df.select("symbol", "bar", F.inline(F.array_compact(F.array(*found))))


def _first_break(df: DataFrame, hit: Column, new: Column, out: str) -> DataFrame:
    """True on the first bar with ``hit`` since the pivot in force appeared."""
    df = df.withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("int"))
    df = df.withColumn("_hits", F.sum("_hit").over(I.so_far()))
    at_start = F.last(
        F.when(new.isNotNull(), F.col("_hits") - F.col("_hit")), ignorenulls=True
    ).over(I.so_far())
    nth = F.col("_hits") - F.coalesce(at_start, F.lit(0))
    return df.withColumn(out, (F.col("_hit") == 1) & (nth == 1)).drop("_hit", "_hits")


def break_columns(df: DataFrame, p: str, extra_up: Column | None = None, extra_down: Column | None = None) -> DataFrame:
    """Add {p}_up, {p}_down (first close across the pivot), {p}_bias and {p}_bias_before."""
    up = I.crossover("close", f"{p}_high")
    down = I.crossunder("close", f"{p}_low")
    df = df.withColumns({"_up": up, "_down": down})
    more_up = F.col("_up") if extra_up is None else F.col("_up") & F.coalesce(extra_up, F.lit(False))
    more_down = F.col("_down") if extra_down is None else F.col("_down") & F.coalesce(extra_down, F.lit(False))
    df = _first_break(df, more_up, F.col(f"{p}_new_high"), f"{p}_up")
    df = _first_break(df, more_down, F.col(f"{p}_new_low"), f"{p}_down")
    turn = F.when(F.col(f"{p}_down"), -1).when(F.col(f"{p}_up"), 1)
    df = df.withColumn(f"{p}_bias", F.last(turn, ignorenulls=True).over(I.so_far()))
    return df.withColumn(f"{p}_bias_before", I.prev(f"{p}_bias")).drop("_up", "_down")


def confluence() -> tuple[Column, Column]:
    """Candle shape conditions for internal breaks (bullish, bearish)."""
    upper = F.col("high") - F.greatest("close", "open")
    lower = F.least(F.col("close"), F.col("open") - F.col("low"))
    return upper > lower, upper < lower


def structure_columns(
    df: DataFrame, swing: int = SWING, internal: int = INTERNAL, use_confluence: bool = False
) -> DataFrame:
    """Swing ("s") and internal ("i") pivots, breaks and biases on every bar."""
    df = pivot_columns(pivot_columns(df, swing, "s"), internal, "i")
    bull, bear = confluence() if use_confluence else (F.lit(True), F.lit(True))
    df = break_columns(df, "s")
    return break_columns(
        df,
        "i",
        (F.col("i_high") != F.col("s_high")) & bull,
        (F.col("i_low") != F.col("s_low")) & bear,
    )


def _breaks(p: str) -> Column:
    """Array of the breaks on a bar; the upward one is judged first."""
    before_up = F.coalesce(F.col(f"{p}_bias_before"), F.lit(0))
    before_down = F.when(F.col(f"{p}_up"), 1).otherwise(before_up)

    def event(flag: str, bias: int, before: Column, level: str) -> Column:
        tag = F.when(before == -bias, "CHoCH").otherwise("BOS")
        return F.when(
            F.col(flag),
            F.struct(F.lit(bias).alias("bias"), tag.alias("tag"), F.col(level).alias("level")),
        )

    return F.array_compact(
        F.array(
            event(f"{p}_up", 1, before_up, f"{p}_high"),
            event(f"{p}_down", -1, before_down, f"{p}_low"),
        )
    )


def structure_breaks(df: DataFrame, kind: str = "swing", **sizes) -> DataFrame:
    """One row per break: symbol, bar, bias (1 up, -1 down), tag, level."""
    p = "i" if kind == "internal" else "s"
    return structure_columns(df, **sizes).select("symbol", "bar", F.inline(_breaks(p)))


def internal_bias(df: DataFrame, **sizes) -> DataFrame:
    cols = structure_columns(df, **sizes)
    return cols.select("symbol", "bar", F.coalesce("i_bias", F.lit(0)).alias("bias"))


def parsed_range(df: DataFrame, measure: str = "atr", atr_len: int = 200) -> DataFrame:
    """High and low, swapped on bars wider than twice the usual range."""
    if measure == "atr":
        df = I.atr(df, atr_len, "_vol")
    else:
        df = I.cum_mean_tr(df, "_vol")
    wide = F.coalesce(F.col("high") - F.col("low") >= 2 * F.col("_vol"), F.lit(False))
    return df.withColumns(
        {
            "p_high": F.when(wide, F.col("low")).otherwise(F.col("high")),
            "p_low": F.when(wide, F.col("high")).otherwise(F.col("low")),
        }
    ).drop("_vol")


def order_blocks(
    df: DataFrame, kind: str = "swing", measure: str = "atr", swing: int = SWING, internal: int = INTERNAL
) -> DataFrame:
    """For each break, the extreme bar from the broken pivot up to the bar before it.

    The span starts ``n`` bars before the pivot was confirmed; those bars are covered by
    one fixed frame on the confirming bar, the rest by a running extreme per pivot.
    """
    cols = structure_columns(parsed_range(df, measure), swing, internal)
    return _blocks(cols, "i", internal) if kind == "internal" else _blocks(cols, "s", swing)


def _blocks(df: DataFrame, p: str, n: int) -> DataFrame:
    low_first = F.struct(F.col("p_low").alias("a"), F.col("bar").alias("b"), F.col("p_high").alias("c"))
    high_first = F.struct(F.col("p_high").alias("a"), (-F.col("bar")).alias("b"), F.col("p_low").alias("c"))
    head = I.series().rowsBetween(-n, -1)
    df = df.withColumns(
        {
            "_lead_up": F.when(F.col(f"{p}_new_high").isNotNull(), F.min(low_first).over(head)),
            "_lead_down": F.when(F.col(f"{p}_new_low").isNotNull(), F.max(high_first).over(head)),
        }
    )

    def span(side: str, pick, row: Column, lead: str, out: str, choose) -> None:
        nonlocal df
        w = Window.partitionBy("symbol", f"{p}_{side}_id").orderBy("bar")
        body = pick(row).over(w.rowsBetween(Window.unboundedPreceding, -1))
        first = F.first(lead, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn(out, choose(body, first))

    span("high", F.min, low_first, "_lead_up", "_best_up", F.least)
    span("low", F.max, high_first, "_lead_down", "_best_down", F.greatest)
    up, down = F.col("_best_up"), F.col("_best_down")
    found = F.array_compact(
        F.array(
            F.when(
                F.col(f"{p}_up"),
                F.struct(F.lit(1).alias("bias"), up["b"].alias("block_bar"), up["c"].alias("top"), up["a"].alias("bottom")),
            ),
            F.when(
                F.col(f"{p}_down"),
                F.struct(F.lit(-1).alias("bias"), (-down["b"]).alias("block_bar"), down["a"].alias("top"), down["c"].alias("bottom")),
            ),
        )
    )
    return df.select("symbol", "bar", F.inline(found))


def _later_extremes(bars: DataFrame, source: str, from_next: bool) -> DataFrame:
    """Per bar the highest and lowest mitigation price from it (or the next bar) on."""
    hi, lo = ("close", "close") if source == "close" else ("high", "low")
    # Reverse order, so the frame grows instead of rescanning all later bars per row.
    later = Window.partitionBy("symbol").orderBy(F.desc("bar"))
    w = later.rowsBetween(Window.unboundedPreceding, -1 if from_next else 0)
    return bars.select(
        "symbol", "bar", F.max(hi).over(w).alias("later_high"), F.min(lo).over(w).alias("later_low")
    )


def _still_open(zones: DataFrame, bars: DataFrame, source: str, from_next: bool) -> DataFrame:
    z = zones.join(_later_extremes(bars, source, from_next), ["symbol", "bar"])
    passed = F.when(F.col("bias") == 1, F.col("later_low") < F.col("bottom")).otherwise(
        F.col("later_high") > F.col("top")
    )
    return z.filter(~F.coalesce(passed, F.lit(False))).drop("later_high", "later_low")


def open_order_blocks(
    blocks: DataFrame, bars: DataFrame, source: str = "highlow", top: int | None = None
) -> DataFrame:
    """Blocks no later price has passed (the bar of the break counts); newest ``top`` per symbol."""
    alive = _still_open(blocks, bars, source, from_next=False)
    if top is None:
        return alive
    w = Window.partitionBy("symbol").orderBy(F.desc("bar"), "bias", "block_bar")
    return alive.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top).drop("_n")


def fair_value_gaps(df: DataFrame, use_threshold: bool = True) -> DataFrame:
    """Three-bar gaps whose middle body is large against the bodies so far.

    A body with an open of 0 is unknown: it makes no gap, and the mean of the bodies leaves it out of the sum.
    """
    last_close, last_open = I.prev("close"), I.prev("open")
    df = df.withColumn("_d", F.try_divide(last_close - last_open, last_open * 100))
    df = df.withColumns(
        {
            "_h2": I.prev("high", 2),
            "_l2": I.prev("low", 2),
            "_c1": last_close,
            "_t": F.sum(F.abs("_d")).over(I.so_far()) / (F.row_number().over(I.series()) - 1) * 2
            if use_threshold
            else F.lit(0.0),
        }
    )
    d, t = F.col("_d"), F.col("_t")
    bull = (F.col("low") > F.col("_h2")) & (F.col("_c1") > F.col("_h2")) & (d > t)
    bear = (F.col("high") < F.col("_l2")) & (F.col("_c1") < F.col("_l2")) & (-d > t)

    def gap(bias: int, a: str, b: str) -> Column:
        return F.struct(F.lit(bias).alias("bias"), F.col(a).alias("top"), F.col(b).alias("bottom"))

    found = F.array_compact(
        F.array(F.when(bull, gap(1, "low", "_h2")), F.when(bear, gap(-1, "high", "_l2")))
    )
    return df.select("symbol", "bar", F.inline(found))


def open_gaps(gaps: DataFrame, bars: DataFrame) -> DataFrame:
    """Gaps no bar after their own has filled."""
    return _still_open(gaps, bars, "highlow", from_next=True)


#: Children of a block of the index of extremes: 2^6, so three levels hold 262,144 bars.
FAN_BITS = 6


def extremes_index(bars: DataFrame, source: str = "highlow", bits: int = FAN_BITS) -> tuple[int, list[DataFrame]]:
    """The first bar number, and per level the blocks (symbol, blk, kids) with the extremes of their children.

    Level 0 has 2^bits bars in a block, each further level as many blocks of the one below. Blocks are cut by
    bar number, so the bars of one symbol lie in many tasks.
    """
    hi, lo = ("close", "close") if source == "close" else ("high", "low")
    first, last = bars.agg(F.min("bar"), F.max("bar")).first()
    first, last = first or 0, last or 0
    rows = bars.select("symbol", (F.col("bar") - first).cast("long").alias("id"), F.col(hi).alias("hi"), F.col(lo).alias("lo"))
    levels: list[DataFrame] = []
    span = last - first
    while not levels or span:
        kids = F.array_sort(F.collect_list(F.struct("id", "hi", "lo"))).alias("kids")
        level = rows.groupBy("symbol", F.shiftright("id", bits).alias("blk")).agg(kids)
        levels.append(materialise(level, "extremes"))
        rows = levels[-1].select("symbol", F.col("blk").alias("id"), F.array_max("kids.hi").alias("hi"), F.array_min("kids.lo").alias("lo"))
        span >>= bits
    return first, levels


def mitigation_bars(
    zones: DataFrame, bars: DataFrame, source: str = "highlow", from_next: bool = False, bits: int = FAN_BITS
) -> DataFrame:
    """The bar on which each zone was first passed; open zones are left out.

    A zone looks at the bars of its own block from its own on, then at the later blocks beside it, then at those
    beside the block above, until a child passes its level; from there down to the bar. Each step is a join by
    equality with one block, so a zone is never paired with the bars between.
    """
    first, levels = extremes_index(bars, source, bits)
    start = F.col("bar") - first + int(from_next)
    z = zones.select("symbol", "bar", "bias", "top", "bottom", start.cast("long").alias("_from"))
    # The block looked at, the child that passes, and the level of that block.
    z = z.select("*", F.shiftright("_from", bits).alias("_blk"), F.lit(None).cast("long").alias("_kid"), F.lit(-1).alias("_at"))

    def looked(z: DataFrame, level: DataFrame) -> tuple[DataFrame, Column]:
        def passes(k: Column) -> Column:
            crossed = F.when(F.col("bias") == 1, k["lo"] < F.col("bottom")).otherwise(k["hi"] > F.col("top"))
            return (k["id"] >= F.col("_from")) & crossed

        side = level.withColumnsRenamed({"symbol": "_sym", "blk": "_of"})
        both = z.join(side, (F.col("symbol") == F.col("_sym")) & (F.col("_blk") == F.col("_of")), "left")
        return both, F.get(F.filter("kids", passes), F.lit(0))["id"]

    keep = ["symbol", "bar", "bias", "top", "bottom"]
    for k, level in enumerate(levels):
        both, kid = looked(z, level)
        z = both.select(*keep, "_from", "_blk", F.coalesce("_kid", kid).alias("_kid"), F.when(F.col("_kid").isNotNull(), F.col("_at")).when(kid.isNotNull(), k).otherwise(-1).alias("_at"))
        if k + 1 < len(levels):
            up = F.col("_kid").isNull()
            z = z.withColumns(
                {
                    "_from": F.when(up, F.col("_blk") + 1).otherwise(F.col("_from")),
                    "_blk": F.when(up, F.shiftright("_blk", bits)).otherwise(F.col("_blk")),
                }
            )
    z = z.filter("_kid IS NOT NULL")
    for k in range(len(levels) - 1, 0, -1):
        down = F.col("_at") == k
        z = z.withColumns({"_blk": F.when(down, F.col("_kid")).otherwise(F.col("_blk")), "_from": F.when(down, F.lit(0).cast("long")).otherwise(F.col("_from"))})
        both, kid = looked(z, levels[k - 1])
        z = both.select(*keep, "_from", "_blk", F.when(down, kid).otherwise(F.col("_kid")).alias("_kid"), F.when(down, k - 1).otherwise(F.col("_at")).alias("_at"))
    return z.select(*keep, (F.col("_kid") + first).cast("int").alias("mitigated_bar"))


def trailing_extremes(df: DataFrame, **sizes) -> DataFrame:
    """Running top and bottom since the last swing pivot, with strong/weak labels.

    A pivot confirmed on a bar resets its side from the next bar on.
    """
    df = structure_columns(df, **sizes)
    swing = sizes.get("swing", SWING)
    for side, pick, keep in (("high", F.max, F.greatest), ("low", F.min, F.least)):
        df = df.withColumns(
            {f"_level_{side}": I.prev(f"s_{side}"), f"_seg_{side}": F.coalesce(I.prev(f"s_{side}_id"), F.lit(0))}
        )
        at = F.when(F.col(f"s_new_{side}").isNotNull(), F.col("bar") - swing)
        df = df.withColumn(f"_at_{side}", F.last(at, ignorenulls=True).over(I.series().rowsBetween(Window.unboundedPreceding, -1)))
        w = Window.partitionBy("symbol", f"_seg_{side}").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(f"_run_{side}", pick(side).over(w))
        level = F.col(f"_level_{side}")
        df = df.withColumn(f"trail_{side}", F.when(level.isNotNull(), keep(level, F.col(f"_run_{side}"))))
        touched = F.when(F.col(f"trail_{side}") == F.col(side), F.col("bar"))
        df = df.withColumn(
            f"{side}_bar", F.coalesce(F.last(touched, ignorenulls=True).over(w), F.col(f"_at_{side}"))
        )
    bias = F.coalesce("s_bias_before", F.lit(0))
    return df.select(
        "symbol",
        "bar",
        F.col("trail_high").alias("top"),
        F.when(F.col("trail_high").isNotNull(), F.col("high_bar")).alias("top_bar"),
        F.col("trail_low").alias("bottom"),
        F.when(F.col("trail_low").isNotNull(), F.col("low_bar")).alias("bottom_bar"),
        F.when(bias == -1, "Strong High").otherwise("Weak High").alias("top_label"),
        F.when(bias == 1, "Strong Low").otherwise("Weak Low").alias("bottom_label"),
    )


def price_zones(ext: DataFrame) -> DataFrame:
    t, b = F.col("top"), F.col("bottom")
    return ext.filter(t.isNotNull() & b.isNotNull()).select(
        "symbol",
        "bar",
        t.alias("premium_top"),
        (0.95 * t + 0.05 * b).alias("premium_bottom"),
        (0.525 * t + 0.475 * b).alias("equilibrium_top"),
        ((t + b) / 2).alias("equilibrium"),
        (0.525 * b + 0.475 * t).alias("equilibrium_bottom"),
        (0.95 * b + 0.05 * t).alias("discount_top"),
        b.alias("discount_bottom"),
    )


FLAGS = [
    f"{kind}_{side}_{what}"
    for what in ("bos", "choch", "block")
    for kind in ("internal", "swing")
    for side in ("bullish", "bearish")
] + ["equal_highs", "equal_lows", "bullish_gap", "bearish_gap"]


def structure_flags(df: DataFrame, swing: int = SWING, internal: int = INTERNAL) -> DataFrame:
    """The sixteen alert flags, on bars where any is set. ``df`` should be stored bars."""
    side = F.when(F.col("bias") == 1, "bullish").otherwise("bearish")
    # Breaks and blocks of both kinds read the same columns: computed once, stored.
    cols = materialise(structure_columns(parsed_range(df), swing, internal), "structure")
    events = []
    for kind, p, n in (("internal", "i", internal), ("swing", "s", swing)):
        br = cols.select("symbol", "bar", F.inline(_breaks(p)))
        events.append(br.select("symbol", "bar", F.concat_ws("_", F.lit(kind), side, F.lower("tag")).alias("flag")))
        hit = mitigation_bars(_blocks(cols, p, n), df)
        events.append(
            hit.select("symbol", F.col("mitigated_bar").alias("bar"), F.concat_ws("_", F.lit(kind), side, F.lit("block")).alias("flag"))
        )
    eq = equal_levels(df)
    events.append(eq.select("symbol", "bar", F.when(F.col("label") == "EQH", "equal_highs").otherwise("equal_lows").alias("flag")))
    events.append(fair_value_gaps(df).select("symbol", "bar", F.concat(side, F.lit("_gap")).alias("flag")))
    rows = events[0]
    for e in events[1:]:
        rows = rows.unionByName(e)
    flags = [F.bool_or(F.col("flag") == f).alias(f) for f in FLAGS]
    return rows.groupBy("symbol", "bar").agg(*flags)
