"""State machines over series that are too long for one task.

A step of a machine with a few states is a map from state to state. Maps are composed, so a block of steps is a
map too, and a series of blocks is a shorter series of maps: blocks are composed side by side, their series is
scanned the same way, and what it gives, the state before each block, lets all blocks run side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialise

#: Bits that a state takes in the number of a map, so up to 8 states fit.
BITS = 4


def step_map(*to: Column | int) -> Column:
    """The number of the map that leads state k to the k-th argument."""
    out = F.lit(0).cast("long")
    for k, x in enumerate(to):
        x = x if isinstance(x, Column) else F.lit(x)
        out = out.bitwiseOR(F.shiftleft(x.cast("long"), BITS * k))
    return out


def _padded(maps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Steps of blocks side by side (step, block), longest first, and the order that makes it so."""
    lists = maps.combine_chunks() if isinstance(maps, pa.ChunkedArray) else maps
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(-size, kind="stable")
    out = np.full((int(size.max(initial=0)), len(size)), -1, np.int64)
    begin = np.r_[0, np.cumsum(size)[:-1]] if len(size) else size
    row = np.repeat(np.arange(len(size)), size)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    out[np.arange(len(flat)) - np.repeat(begin, size), rank[row]] = flat
    return out, order


def _composed(states: int):
    @F.arrow_udf("long")
    def compose(maps: pa.Array) -> pa.Array:
        steps, order = _padded(maps)
        now = np.tile(np.arange(states), (len(order), 1))
        for line in steps:
            on = line >= 0
            now[on] = (line[on, None] >> (BITS * now[on])) & ((1 << BITS) - 1)
        code = np.zeros(len(order), np.int64)
        code[order] = (now << (BITS * np.arange(states))).sum(axis=1)
        return pa.array(code)

    return compose


def _states():
    """A function that gives the state after each step of each block."""

    @F.arrow_udf("array<int>")
    def run(maps: pa.Array, start: pa.Array) -> pa.Array:
        steps, order = _padded(maps)
        now = start.to_numpy(zero_copy_only=False).astype(np.int64)[order]
        after = np.zeros(steps.shape, np.int32)
        for k, line in enumerate(steps):
            on = line >= 0
            now[on] = (line[on] >> (BITS * now[on])) & ((1 << BITS) - 1)
            after[k] = now
        size = (steps >= 0).sum(axis=0)
        out: list[np.ndarray] = [None] * len(order)
        for j, i in enumerate(order.tolist()):
            out[i] = after[: size[j], j]
        return pa.array(out, pa.list_(pa.int32()))

    return run


def scan_states(
    df: DataFrame, key: str, pos: str, step: Column, states: int, out: str, start: int = 0, block: int = 4096
) -> DataFrame:
    """``df`` with ``out``, the state after each row's step, by ``pos`` (whole numbers from 0, unlike in a series).

    Each series begins in state ``start``; ``step`` is a ``step_map``. The other columns are joined back by (key, pos).
    """
    rows = df.select(F.col(key).alias("_key"), F.col(pos).cast("long").alias("_pos"), step.alias("_map"))
    found = _scan(rows, states, start, block).withColumnRenamed("_state", out)
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col(pos) == F.col("_pos"))
    return df.join(found, same).drop("_key", "_pos")


def _scan(rows: DataFrame, states: int, start: int, block: int) -> DataFrame:
    """(_key, _pos, _state) of (_key, _pos, _map)."""
    one = F.sort_array(F.collect_list(F.struct("_pos", "_map"))).alias("_own")
    blocks = materialise(rows.groupBy("_key", F.floor(F.col("_pos") / block).alias("_blk")).agg(one), "blocks")
    if blocks.agg(F.max("_blk")).first()[0]:
        whole = blocks.select("_key", F.col("_blk").alias("_pos"), _composed(states)("_own._map").alias("_map"))
        ends = _scan(whole, states, start, block)
        # The state after a block is the state before the next one there is.
        ends = ends.select(F.col("_key").alias("_of"), F.col("_pos").alias("_last"), F.col("_state").alias("_begin"))
        links = blocks.select(F.col("_key").alias("_k"), F.col("_blk").alias("_b")).withColumn("_last", _previous("_k", "_b"))
        before = links.join(ends, F.col("_k").eqNullSafe(F.col("_of")) & (links["_last"] == ends["_last"])).select("_k", "_b", "_begin")
        blocks = blocks.join(before, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_blk") == F.col("_b")), "left")
        begin = F.coalesce("_begin", F.lit(start))
    else:
        begin = F.lit(start)
    states_ = blocks.select("_key", "_own", _states()(F.col("_own._map"), begin.cast("int")).alias("_states"))
    flat = states_.select("_key", F.explode(F.arrays_zip(F.col("_own._pos").alias("p"), F.col("_states").alias("s"))).alias("_z"))
    return flat.select("_key", F.col("_z.p").alias("_pos"), F.col("_z.s").alias("_state"))


def _previous(key: str, blk: str) -> Column:
    return F.lag(blk).over(Window.partitionBy(key).orderBy(blk))  # a row per block
