"""Repeated passages by refining suffix buckets with bucket pointers.

A suffix first belongs to the bucket of its 25-gram. The bucket of twice the depth is named by two
buckets: its own and that of the suffix as many bytes later, which was refined before; so 25, 50, 100,
200 and 400 bytes take four steps that reuse each other's results. A bucket's name is a 64-bit number
made from the two names, so it is the same in every task and buckets meet in a shuffle.

A 400-byte string is repeated if its bucket at depth 400 has two members. Not every suffix is shuffled:

1. Each 400-byte string is filed under its anchor, the 50-gram in it whose name is smallest (the last of
   equals). It depends on the string alone, so equal strings have it at the same offset; and a run of
   neighbouring strings shares one anchor, so there is one row for about 130 bytes. Runs that are equal
   as a whole are repeated as a whole; runs in a bucket of their own hold nothing repeated.
2. Runs that share their anchor but differ are cut in pieces of 16 starts, refined by the bytes that all
   strings of a piece share: a piece alone in its bucket is done, equal pieces are repeated.
3. The starts of the remaining pieces are compared at depth 400 one by one.

After each step the buckets that go on are marked in a filter of fixed size, and the texts are read
again; a bucket that was let through by chance costs time and changes nothing.

Passages of more than 50 words can be shorter than 400 bytes. They are told, not removed: the same runs over
words instead of bytes, with the 8-gram as anchor. Runs whose anchor is nowhere else are left out first; equal
runs of two rows are shared as a whole, and the starts of unlike runs with one anchor are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bitfilter import BITMAP_BITS, BITS, bitmaps, cell, with_rows
from tickloom.llm.common import shared_path, stored, whole_text
from tickloom.llm.textblocks import SPACE, U64, Block, blocks, mix, words
from tickloom.session import remove_path

#: Bytes of a passage: 16 times the first depth.
LENGTH = 400
FIRST = LENGTH // 16
ANCHOR = 2 * FIRST
#: Starts that are refined together in step 2.
PIECE = 16
#: Words of a passage that is told, and of its anchor.
WORDS, WORD_ANCHOR = 51, 8
LEFT, RIGHT = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a bucket that two buckets make."""
    x = a * LEFT
    x += b * RIGHT
    return mix(x)


def first_seen(keys: np.ndarray, seen: set[int]) -> np.ndarray:
    """Where a key stands for the first time in a task; ``seen`` holds the task's keys so far."""
    found, at = np.unique(keys, return_index=True)
    new = np.array([k not in seen for k in found.tolist()], bool)
    seen.update(found[new].tolist())
    return np.sort(at[new])


def runs_of(grams: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, size: int) -> tuple[np.ndarray, ...]:
    """row, begin, end (last start) and anchor of each run of strings of ``length`` units in the texts from begins to ends.

    ``grams`` names the ``size`` units at each place. A string that leaves its text has no start.
    """
    low, width = U64(0xFFFFFFFF), length - size + 1
    n = max(0, len(grams) - width + 1)
    # Name above, place below; of equal names the later place is the smaller number.
    keys = (grams & ~low) | (low - np.arange(len(grams), dtype=U64))
    keys = np.concatenate([keys, np.full(-len(keys) % width, ~U64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(keys, axis=1).ravel()
    behind = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (low - (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low)).astype(np.int64)
    whole = ends - begins >= length
    first, count = begins[whole], (ends - begins - length + 1)[whole]
    row = np.repeat(np.flatnonzero(whole), count)
    start = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
    anchor = anchor[start]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]) if len(start) else start
    end = start[np.r_[new[1:] - 1, len(start) - 1]] if len(start) else start
    return row[new], start[new], end, anchor[new]


def each_start(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which stretch, and which start, for all starts from begin to end of the stretches."""
    count = end - begin + 1
    return np.repeat(np.arange(len(begin)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - begin, count)


class Suffixes:
    """Buckets of all suffixes of a block by depth, and the runs of starts that share an anchor."""

    def __init__(self, block: Block):
        self.begins = block.begins
        self.depth = {FIRST: block.hashes(1).all_of(FIRST)}
        d = FIRST
        while d < LENGTH:
            b = self.depth[d]
            self.depth[2 * d] = pair(b[:-d], b[d:])
            d *= 2
        self.b200, self.b400 = self.depth[LENGTH // 2], self.depth[LENGTH]
        grams = self.depth[ANCHOR]
        self.row, self.begin, self.end, self.anchor = runs_of(grams, block.begins, block.ends, LENGTH, ANCHOR)
        self.gram = mix(grams[self.anchor] + (self.anchor - self.begin).astype(U64))
        self.bucket = grams[self.anchor]
        self.whole = pair(self.b400[self.begin], self.b400[self.end])

    def pieces(self, runs: np.ndarray) -> tuple[np.ndarray, ...]:
        """run, begin, end, bucket of the shared bytes and bucket of all bytes, for each piece of these runs.

        Pieces are cut at offsets from the anchor, so equal strings are in the same piece of their runs.
        """
        first = (self.anchor[runs] - self.end[runs]) // PIECE
        count = (self.anchor[runs] - self.begin[runs]) // PIECE - first + 1
        run = np.repeat(runs, count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        lo = np.maximum(self.begin[run], self.anchor[run] - PIECE * k - (PIECE - 1))
        hi = np.minimum(self.end[run], self.anchor[run] - PIECE * k)
        # What every string of the piece has: the last start to the end of the first.
        a, length = self.anchor[run] - PIECE * k, LENGTH - (PIECE - 1)
        shared = pair(self.b200[a], self.b200[a + length - LENGTH // 2]) ^ mix(self.bucket[run] + k.astype(U64))
        return run, lo, hi, shared, pair(self.b400[lo], self.b400[hi])


class Words:
    """The same over words, what lies between blanks, tabs and line ends; places are numbers of words."""

    def __init__(self, block: Block):
        begins, ends, row = words(block, ~SPACE)
        texts = np.arange(len(block.ends))
        self.begins, stop = np.searchsorted(row, texts, side="left"), np.searchsorted(row, texts, side="right")
        b, d = block.hashes(2).of(begins, ends), 1
        while 2 * d <= WORDS:
            b, d = pair(b[:-d], b[d:]), 2 * d
            if d == WORD_ANCHOR:
                grams = b
        self.passage = pair(b[: d - WORDS], b[WORDS - d :])
        self.row, self.begin, self.end, self.anchor = runs_of(grams, self.begins, stop, WORDS, WORD_ANCHOR)
        self.bucket = grams[self.anchor]
        self.whole = pair(self.passage[self.begin], self.passage[self.end])


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, th (tells texts of one id apart) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(whole_text()).alias("th"), whole_text().alias("text"))


KEYS = "doc_id long, th int, lo int, hi int, k1 long, k2 long"


def _scan(texts: DataFrame, rows_of, schema: str, of: type = Suffixes) -> DataFrame:
    """``rows_of(suffixes, seen)`` gives row, lo, hi (places in the block), k1, k2; ``seen`` is the task's own.

    With ``nr`` in the schema, rows have the numbers of their texts in the scan, and ``suffixes.nr`` those of the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[int]] | set[int] = {} if "nr" in schema else set()
        for batch in batches:
            for b in blocks(batch["text"]):
                if len(b.data) < (LENGTH if of is Suffixes else 2 * WORDS - 1):
                    continue
                s = of(b)
                if "nr" in schema:
                    s.nr = batch["nr"].to_numpy()[b.first : b.first + len(b.ends)]
                row, lo, hi, k1, k2 = rows_of(s, seen)
                cols = {"k1": k1.view(np.int64), "k2": k2.view(np.int64)}
                if "doc_id" in schema:
                    ids, own = pa.array(b.first + row), s.begins[row]
                    cols = {
                        "doc_id": batch["doc_id"].take(ids), "th": batch["th"].take(ids),
                        "lo": (lo - own).astype(np.int32), "hi": (hi - own).astype(np.int32),
                    } | cols
                if "nr" in schema:
                    cols["nr"] = s.nr[row]
                yield pa.RecordBatch.from_pydict(cols)

    return texts.mapInArrow(run, schema)


class Marked:
    """A filter in the executors' hands: at most BITS / 8 bytes (8 MB), whatever it was made from."""

    def __init__(self, keys: DataFrame, of: str):
        table = np.zeros((BITS // BITMAP_BITS, BITMAP_BITS // 8), np.uint8)
        for r in bitmaps(keys, cell(F.col(of))).collect():
            table[r["__bucket"]] = np.frombuffer(r["__bits"], np.uint8)
        self.sent = keys.sparkSession.sparkContext.broadcast(table.ravel())

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = (keys & U64(BITS - 1)).astype(np.int64)
        return (self.sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def repeated_spans(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, th, lo, hi: every 400-byte string that starts at lo to hi of the text is somewhere else too.

    What it stores lies below ``path``.
    """
    texts = _texts(docs)

    def every(s: Suffixes, seen: set[int]):
        return s.row, s.begin, s.end, s.bucket, mix(s.whole ^ s.gram)

    runs = stored(_scan(texts, every, "k1 long, k2 long").groupBy("k1", "k2").agg(F.count("*").alias("n")), "runs", path)
    buckets = runs.groupBy("k1").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    mixed = runs.join(buckets.where("kinds > 1 AND least = 1"), "k1")
    equal, unlike = Marked(runs.where("n > 1"), "k2"), Marked(mixed, "k2")

    # A run that is like another is settled as a whole and only stands for others to be compared with, so a task
    # cuts up one of them. Runs that are alone are all cut up, as each is the first of its kind.
    def some(s: Suffixes, seen: set[int]):
        whole = mix(s.whole ^ s.gram)
        same, cut = np.flatnonzero(equal(whole)), np.flatnonzero(unlike(whole))
        run, lo, hi, shared, all_ = s.pieces(cut[first_seen(whole[cut], seen)])
        return (
            np.r_[s.row[same], s.row[run]], np.r_[s.begin[same], lo], np.r_[s.end[same], hi],
            np.r_[s.bucket[same], shared], np.r_[whole[same], all_],
        )

    parts = stored(_scan(texts, some, KEYS), "pieces", path)
    kinds = stored(parts.groupBy("k1", "k2").agg(F.count("*").alias("n")), "kinds", path)
    open_ = kinds.groupBy("k1").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1")
    left = Marked(open_, "k1")

    # The same holds for pieces.
    def single(s: Suffixes, seen: set[int]):
        run, lo, hi, shared, all_ = s.pieces(np.flatnonzero(unlike(mix(s.whole ^ s.gram))))
        on = np.flatnonzero(left(shared))
        on = on[first_seen(all_[on] ^ shared[on], seen)]
        of, at = each_start(lo[on], hi[on])
        return s.row[run[on][of]], at, at, shared[on][of], s.b400[at]

    starts = stored(_scan(texts, single, KEYS), "starts", path)
    twice = starts.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1")
    spans = parts.join(kinds.where("n > 1"), ["k1", "k2"]).unionByName(starts.join(twice, ["k1", "k2"]))
    return spans.select("doc_id", "th", "lo", "hi")


def shared_passages(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, th, lo, hi: every passage of 51 words that starts at word lo to hi of the text is in another row too.

    What it stores lies below ``path``.
    """
    texts = _texts(docs).withColumn("nr", F.monotonically_increasing_id())
    ends = [F.min("nr").alias("least"), F.max("nr").alias("most")]

    # An anchor counts once a text; twice in a scan means two texts.
    def anchors(s: Words, seen: set[int]):
        at = np.unique(pair(s.row.astype(U64), s.bucket), return_index=True)[1]
        return s.row[at], s.begin[at], s.end[at], s.bucket[at], s.bucket[at]

    found = _scan(_texts(docs), anchors, "k1 long, k2 long", Words).groupBy("k1").agg(F.count("*").alias("n"))
    met = Marked(found.where("n > 1"), "k1")

    def some(s: Words, seen: dict[int, set[int]]):
        on = np.flatnonzero(met(s.bucket))
        return s.row[on], s.begin[on], s.end[on], s.bucket[on], s.whole[on]

    runs = stored(_scan(texts, some, f"{KEYS}, nr long", Words), "runs", path)
    kinds = stored(runs.groupBy("k1", "k2").agg(*ends), "kinds", path)
    open_ = kinds.groupBy("k1").agg(F.count("*").alias("kinds"), F.max(F.expr("least = most")).alias("lone")).where("kinds > 1 AND lone")
    left = Marked(open_, "k1")

    # Equal runs of two rows are settled; two rows of a task are enough for others to be compared with.
    def single(s: Words, seen: dict[int, set[int]]):
        on = np.flatnonzero(left(s.bucket))
        new = []
        for key, nr in zip(s.whole[on].tolist(), s.nr[s.row[on]].tolist(), strict=True):
            rows = seen.setdefault(key, set())
            if len(rows) < 2:
                rows.add(nr)
            new.append(nr in rows)
        on = on[np.array(new, bool)]
        of, at = each_start(s.begin[on], s.end[on])
        return s.row[on][of], at, at, s.bucket[on][of], s.passage[at]

    starts = stored(_scan(texts, single, f"{KEYS}, nr long", Words), "starts", path)
    twice = starts.groupBy("k1", "k2").agg(*ends).where("least < most").select("k1", "k2")
    whole = kinds.where("least < most").select("k1", "k2")
    spans = runs.join(whole, ["k1", "k2"]).unionByName(starts.join(twice, ["k1", "k2"]))
    return spans.select("doc_id", "th", "lo", "hi")


def merged(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the stretches cover."""
    order = np.argsort(begins, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(begins[order].tolist(), ends[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _spans(docs: DataFrame) -> DataFrame:
    """doc_id, th, starts and passages, the (lo, hi) of each text that has any. What is stored on the way is removed."""
    spark = docs.sparkSession
    path = shared_path(spark, "passages")
    told = stored(shared_passages(docs, path), "told")
    remove_path(spark, path)
    path = shared_path(spark, "repeats")
    found = repeated_spans(docs, path).withColumn("told", F.lit(False)).unionByName(told.withColumn("told", F.lit(True)))
    place = F.struct("lo", "hi")
    spans = found.groupBy("doc_id", "th").agg(
        F.collect_set(F.when(~F.col("told"), place)).alias("starts"), F.collect_set(F.when(F.col("told"), place)).alias("passages")
    )
    spans = stored(spans, "spans")  # a text has no more of them than bytes
    remove_path(spark, path)
    return spans


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, removed (spans of bytes, begin and end), kept (the remaining bytes) and
    passages (spans of words).

    Every byte is removed that a 400-byte string covers which also starts anywhere else, in the same
    document or another; so all copies of a passage go. Null and empty texts, and those under 400 bytes,
    keep all they have. A row that is there more than once repeats its whole text. An empty table gives
    no rows. Columns other than doc_id and text are not read. Passages of over 50 words that another row has
    too are told whatever their bytes, and nothing is removed for them.
    """
    spans = _spans(docs)

    @F.pandas_udf("removed array<struct<begin: int, end: int>>, kept binary, passages array<struct<begin: int, end: int>>")
    def cut(text: pd.Series, starts: pd.Series, passages: pd.Series) -> pd.DataFrame:
        def covered(s, length: int) -> list[tuple[int, int]]:
            lo, hi = (np.array([x[c] for x in s], np.int64) for c in ("lo", "hi"))
            return merged(lo, hi + length)

        rows = []
        for t, s, p in zip(text, starts, passages, strict=True):
            raw = t.encode()
            gone, kept, at = covered(s, LENGTH), [], 0
            for a, b in gone:
                kept.append(raw[at:a])
                at = b
            told = [{"begin": a, "end": b} for a, b in covered(p, WORDS)]
            rows.append(([{"begin": a, "end": b} for a, b in gone], b"".join([*kept, raw[at:]]), told))
        return pd.DataFrame(rows, columns=["removed", "kept", "passages"])

    alone, met = with_rows(_texts(docs), spans, ["doc_id", "th"])
    none = F.array().cast("array<struct<begin: int, end: int>>")
    whole = lambda rows: rows.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("removed"),
        F.encode("text", "UTF-8").alias("kept"), none.alias("passages"),
    )
    cut_rows = met.where("starts IS NOT NULL").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), cut("text", "starts", "passages").alias("out")
    )
    cut_rows = cut_rows.select("doc_id", "n_bytes", "out.removed", "out.kept", "out.passages")
    return whole(alone).unionByName(whole(met.where("starts IS NULL"))).unionByName(cut_rows)


def shared_words() -> Column:
    """Words that the passages of a document cover."""
    return F.aggregate("passages", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"]).alias("n_shared_words")


def digests(dropped: DataFrame, *more: Column) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is kept; then ``more``."""
    return dropped.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        *more,
    )
