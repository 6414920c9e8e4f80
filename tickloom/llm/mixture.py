"""Mixing sources to target weights.

The words of each source are packed into blocks of fixed length. The output is a row of shards; how many
slots of a shard each source gets is drawn from a multinomial, conditioned on the totals so that these
are met exactly. The n-th slot of a source takes the block that a pseudorandom permutation of the
source's block numbers has at n, a new permutation for each time around. Slots and blocks are joined by
number; nothing is sorted or shuffled at random.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import stored, whole_text

WORD = r"[^\x20\x09-\x0D]+"

#: Fixed values of the query: weights by place, and the share of all words that the mix has.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0

#: Words of a block; slots of a shard; shards that share one draw; pieces of a source that are numbered apart.
BLOCK, SHARD, DRAW, PIECES = 64, 4096, 64, 1024


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is cut goes to the others by weight."""
    got, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left, weight = total - sum(got[i] for i in range(len(sizes)) if i not in open_), sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        for i in over or open_:
            got[i] = most * sizes[i] if over else left * weights[i] / weight
        if not over:
            break
        open_ -= over
    return got


def sources(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> list[Source]:
    """Targets of all sources, by code point and null last.

    One row per source reaches the driver: sources are what someone gives weights to, so their list is no
    longer than that of the weights.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["size"]) for r in rows]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * sum(sizes), most)
    out = []
    for r, size, target in zip(rows, sizes, targets, strict=True):
        blocks = -(-size // block)
        # In slots, as the last block may be short; never more than ``most`` times around.
        slots = min(round(target * blocks / size), int(most * blocks)) if size else 0
        out.append(Source(r["source"], size, target, blocks, slots))
    return out


def placed(docs: DataFrame, pieces: int = PIECES) -> DataFrame:
    """``docs`` with __size and __start, the number of words of its source that stand before it.

    A source is numbered in hashed pieces, ordered by id within each, and the pieces are then laid end to
    end, so no source is sorted in one task. Needs column ``size``.
    """
    piece = F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).alias("__piece")
    rows = docs.select("*", piece)
    sums = rows.groupBy("source", "__piece").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("source").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "__piece", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    order = [c for c in ("doc_id", "size", "__tie") if c in rows.columns]
    inner = Window.partitionBy("source", "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    sums = sums.select(F.col("source").alias("__s"), F.col("__piece").alias("__p"), "__base")
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("__piece") == F.col("__p"))
    return rows.join(sums, same, "left").withColumn("__start", F.col("__base") + F.col("__in")).drop(
        "__s", "__p", "__piece", "__base", "__in"
    )


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``index``: four Feistel rounds, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            z = (right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def plan_slots(mix: list[Source], draw: int, draws: int, shards: int, seed: int) -> pd.DataFrame:
    """The slots of one draw: shard, source number, time around and block."""
    first = [s.slots * draw // draws for s in mix]
    count = [s.slots * (draw + 1) // draws - f for s, f in zip(mix, first, strict=True)]
    rng = np.random.default_rng([seed, draw])
    left, sizes = np.array(count, np.int64), [sum(count) * (k + 1) // shards - sum(count) * k // shards for k in range(shards)]
    out, at = [], np.array(first, np.int64)
    for k, n in enumerate(sizes):
        drawn = rng.multivariate_hypergeometric(left, n) if n else np.zeros_like(left)
        for i in np.flatnonzero(drawn):
            j = at[i] + np.arange(drawn[i])
            around = j // mix[i].blocks
            block = np.empty_like(j)
            for t in np.unique(around):
                block[around == t] = permuted(j[around == t] % mix[i].blocks, mix[i].blocks, (seed * 65537 + int(i)) * 64 + int(t))
            out.append(pd.DataFrame({"shard": draw * shards + k, "number": int(i), "around": around, "block": block}))
        left, at = left - drawn, at + drawn
    return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("shard", "number", "around", "block")}, dtype="int64")


def taken_spans(rows: DataFrame, mix: list[Source], block: int = BLOCK, shard: int = SHARD, draw: int = DRAW, seed: int = 7) -> DataFrame:
    """What the mix takes: shard, number of the source, around, block, and which words (from, to) of the
    document that starts at ``__start`` of its source. ``rows``: number, size, __start."""
    spark = rows.sparkSession
    total = sum(s.slots for s in mix)
    draws = max(1, -(-total // (shard * draw)))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d in pdf["id"]:
                yield plan_slots(mix, int(d), draws, draw, seed)

    plan = spark.range(draws, numPartitions=min(draws, 10_000)).mapInPandas(slots, "shard long, number long, around long, block long")
    packed = rows.where("size > 0").select(
        "number", "size", "__start",
        F.explode(F.expr(f"sequence(__start div {block}, (__start + size - 1) div {block})")).alias("block"),
    )
    lo, hi = F.greatest(F.col("block") * block, F.col("__start")), F.least((F.col("block") + 1) * block, F.col("__start") + F.col("size"))
    packed = packed.select("number", "block", "__start", (lo - F.col("__start")).alias("from"), (hi - F.col("__start")).alias("to"))
    # Both sides grow with the words; the planner can't see how many slots a draw makes, so it must not broadcast them.
    return plan.join(packed.hint("merge"), ["number", "block"])


def numbered(rows: DataFrame, mix: list[Source]) -> DataFrame:
    """Adds the number of the source, its size and target."""
    table = rows.sparkSession.createDataFrame(
        [(s.name, i, s.size, float(s.target)) for i, s in enumerate(mix)], "__s string, number long, source_size long, target double"
    )
    # One row per source, from the driver's list.
    return rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken, the words that the mix takes of it.

    Null and empty texts have size 0 and nothing is taken of them; a source without words has target 0.
    A null source is a source of its own. Repeated rows are packed one after the other and count each.
    An empty table gives no rows. Columns other than doc_id, text and source are not read. Reruns agree:
    packing follows ids, draws and permutations follow numbers.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(whole_text()).alias("size"))
    rows = stored(placed(rows), "placed")
    mix = sources(rows)
    rows = numbered(rows, mix)
    spans = taken_spans(rows.select("number", "size", "__start"), mix, **how)
    taken = spans.groupBy("number", "__start").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    # Where a document has words, its start is its own.
    empty = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    full = rows.where("size > 0").join(taken, ["number", "__start"], "left")
    full = full.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    cols = ("doc_id", "size", "source_size", "target", "taken")
    return full.select(*cols).unionByName(empty.select(*cols))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of the spans (merged where they touch) with what stands between them; a new line between spans."""
    at = [m.span() for m in re.finditer(WORD, text)]
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and runs[-1][1] == a:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    if runs == [[0, len(at)]]:
        return text
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in runs)


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of ``docs``: for each document and time around one row that holds
    the words taken then (``text``, and ``n_chars`` if there). Documents without words are not in a mix.

    Other columns stay as they are; names that start with ``__`` and ``number``, ``size`` are reserved.
    """
    held = docs.select(F.struct(*docs.columns).alias("__doc"), "doc_id", F.col("source").cast("string").alias("source"),
                       n_words(whole_text()).alias("size"), F.xxhash64(whole_text()).alias("__tie"))
    rows = stored(placed(held), "placed")
    mix = sources(rows)
    rows = numbered(rows, mix)
    spans = taken_spans(rows.select("number", "size", "__start"), mix, **how)
    spans = spans.groupBy("number", "__start", "around").agg(F.collect_list(F.struct("from", "to")).alias("spans"))

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        # One text and its spans at a time as Python values; the others stay in Arrow.
        offset, flat = spans.offsets.to_numpy(), spans.flatten()
        begin, end, offset = flat.field("from").to_numpy(), flat.field("to").to_numpy(), offset - offset[0]
        rows = ((t.as_py() or "", slice(lo, hi)) for t, lo, hi in zip(text, offset[:-1], offset[1:], strict=True))
        return pa.array((cut_words(t, list(zip(begin[k].tolist(), end[k].tolist(), strict=True))) for t, k in rows), pa.string())

    # A document without words has the start of the next one.
    out = rows.where("size > 0").join(spans, ["number", "__start"]).withColumn("__text", cut("__doc.text", "spans"))
    changed = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return out.select(*(changed.get(c, F.col("__doc")[c]).alias(c) for c in docs.columns))
