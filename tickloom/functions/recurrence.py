"""Ordered recurrences as window expressions.

``y[t] = (1-a)*y[t-1] + a*x[t]`` is an exponentially weighted window, which Spark
evaluates in the JVM in one pass over an ordered partition. Spark normalises that
window by its total weight; undoing the normalisation gives the recurrence itself,
seeded by the first non-null value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


def growing(*keys: str, order: str) -> Window:
    return (
        Window.partitionBy(*keys)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def decayed_mean(x: Column, alpha: float, window) -> Column:
    """Weighted mean of all values so far, weights falling by ``1-alpha`` per value."""
    return InternalFunction.ewm(x, alpha, True).over(window)


def decayed(x: Column, alpha: float, window) -> Column:
    """The recurrence, seeded by the first non-null value; NULL inputs are skipped."""
    if alpha >= 1.0:
        return F.last(x, ignorenulls=True).over(window)
    keep = F.pow(F.lit(1.0 - alpha), F.count(x).over(window))
    first = F.first(x, ignorenulls=True).over(window)
    return decayed_mean(x, alpha, window) * (1 - keep) + first * keep


def decayed_in_blocks(
    df: DataFrame, key: str, pos: str, value: str, alpha: float, out: str, block: int = 4096
) -> DataFrame:
    """Same recurrence for one very long series per key, spread over many tasks.

    ``pos`` is a dense 0-based position. Each block of positions is folded on its
    own; what a block hands to the next is one number, so the second pass reads
    one row per block. All blocks but the last have the same length, hence the
    carried values follow the same recurrence with the decay ``(1-a)**block``.
    """
    if alpha >= 1.0:
        return df.withColumn(out, F.col(value))
    decay = 1.0 - alpha
    local = growing(key, "_blk", order=pos)
    blocks = df.withColumn("_blk", F.floor(F.col(pos) / block))
    # From a zero start: a*sum(x*decay^age); the series' first row carries full weight.
    seeded = F.when(F.col(pos) == 0, F.col(value) / alpha).otherwise(F.col(value))
    weight = F.count(seeded).over(local)
    blocks = blocks.withColumn(
        "_local",
        decayed_mean(seeded, alpha, local) * (1 - F.pow(F.lit(decay), weight)),
    )
    ends = blocks.filter(F.col(pos) % block == block - 1).select(
        key, (F.col("_blk") + 1).alias("_blk"), F.col("_local").alias("_end")
    )
    step = decay**block
    chain = growing(key, order="_blk")
    if step < 1e-300:
        carried = F.col("_end")
    else:
        seen = F.count("_end").over(chain)
        carried = (
            decayed_mean(F.col("_end"), 1.0 - step, chain)
            * (1 - F.pow(F.lit(step), seen))
            / (1.0 - step)
        )
    carry = ends.select(key, "_blk", carried.alias("_carry"))
    age = F.col(pos) - F.col("_blk") * block + 1
    return (
        blocks.join(carry, [key, "_blk"], "left")
        .withColumn(
            out,
            F.col("_local")
            + F.coalesce(F.col("_carry"), F.lit(0.0)) * F.pow(F.lit(decay), age),
        )
        .drop("_blk", "_local", "_carry")
    )


def latch_steps(
    enter: Column, stop: Column, window, out: str, tag: str = ""
) -> list[dict[str, Column]]:
    """``on = enter and not on[1] ? true : stop ? false : on[1]`` without a fold.

    A bar with only ``enter`` sets, with only ``stop`` resets, with both toggles.
    Hence the flag is the last set/reset, flipped once per toggle since. Two sets of
    columns, the second reading the first.
    """
    e, s = F.coalesce(enter, F.lit(False)), F.coalesce(stop, F.lit(False))
    settled = e != s
    flips, base = f"_flips{tag}", f"_base{tag}"
    first = {
        flips: F.sum((e & s).cast("int")).over(window),
        base: F.last(F.when(settled, e), ignorenulls=True).over(window),
    }
    before = F.last(F.when(settled, F.col(flips)), ignorenulls=True).over(window)
    odd = (F.col(flips) - F.coalesce(before, F.lit(0))) % 2 == 1
    return [first, {out: F.coalesce(F.col(base), F.lit(False)) != odd}]


def latched(df: DataFrame, key: str, order: str, enter: str, stop: str, out: str) -> DataFrame:
    """Add the latch of two boolean columns."""
    first, second = latch_steps(F.col(enter), F.col(stop), growing(key, order=order), out)
    return df.withColumns(first).withColumns(second).drop(*first)
