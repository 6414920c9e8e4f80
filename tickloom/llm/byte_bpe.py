"""Byte-level BPE as a monoid: a text's tokens are folded from those of its halves.

``encode`` splits a text in halves down to short leaves. Two neighbours are joined by encoding a window
around their boundary anew; it grows on either side until it ends where no text beyond can matter, so
all tokens outside it stay. ``decode`` concatenates up the same tree.

Where tokens are stable: no match of the pattern has a white space after a character that is none (each
is white space alone, or at most one leading space and no other). So between a character that is no
white space and one that is, there is always a boundary of matches, and the look-ahead on the left of it
never passes it. Both halves of such a cut encode alone exactly as they do in the whole.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import whole_text

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

#: Characters of a leaf, and of the first window on either side of a boundary.
LEAF, WINDOW = 8192, 32


class Codec:
    """Ranks, the encoder of leaves and the bytes of each id."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.parts = {i: b for b, i in table.items()}
        self.sizes = np.zeros(max(table.values()) + 1, np.int64)
        for b, i in table.items():
            self.sizes[i] = len(b)

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        return self._fold(text, 0, len(text), leaf)

    def _alone(self, text: str) -> np.ndarray:
        return self.leaf.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def _fold(self, text: str, lo: int, hi: int, leaf: int) -> np.ndarray:
        if hi - lo <= leaf:
            return self._alone(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._fold(text, lo, mid, leaf), self._fold(text, mid, hi, leaf))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if _cut(text, mid):
            return np.concatenate([left, right])
        a, b, width = lo, hi, WINDOW
        while mid - width > lo:
            if (c := _last_cut(text, mid - width, mid)) is not None:
                a = c
                break
            width *= 2
        width = WINDOW
        while mid + width < hi:
            if (c := _first_cut(text, mid + 1, mid + width)) is not None:
                b = c
                break
            width *= 2
        # A cut is a boundary of tokens in its half, so byte counts find it.
        kept = left[: len(left) - self._covering(left[::-1], len(text[a:mid].encode()))]
        rest = right[self._covering(right, len(text[mid:b].encode())) :]
        return np.concatenate([kept, self._alone(text[a:b]), rest])

    def _covering(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many of the first ids make up so many bytes."""
        # A token has a byte at least.
        return int(np.searchsorted(np.cumsum(self.sizes[ids[:n_bytes]]), n_bytes)) + 1 if n_bytes else 0

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.parts.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def _cut(text: str, c: int) -> bool:
    # Python counts a few control characters as white space that the pattern does not: none of them is on the right.
    return text[c] in " \t\n\r" and not text[c - 1].isspace()


def _last_cut(text: str, lo: int, hi: int) -> int | None:
    return next((c for c in range(hi - 1, lo, -1) if _cut(text, c)), None)


def _first_cut(text: str, lo: int, hi: int) -> int | None:
    return next((c for c in range(lo, hi) if _cut(text, c)), None)


@functools.lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


class Bpe:
    """Encoding and decoding expressions for one rank file (under 1 MB, sent to the executors once)."""

    def __init__(self, spark: SparkSession, ranks: str = RANKS, pattern: str = PATTERN):
        with open(ranks, "rb") as f:
            sent = spark.sparkContext.broadcast(f.read())

        def encoded(texts: pa.Array) -> pa.Array:
            c = codec(sent.value, pattern)
            rows = [c.encode(t.as_py() or "") for t in texts]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))

        def decoded(ids: pa.Array) -> pa.Array:
            c = codec(sent.value, pattern)
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            spans = zip(ids.is_valid().to_pylist(), ends[:-1], ends[1:], strict=True)
            # The ids of one text at a time are Python numbers.
            return pa.array([c.decode(flat[a:b].tolist()) if ok else None for ok, a, b in spans], pa.binary())

        self._encode, self._decode = F.arrow_udf(encoded, "array<int>"), F.arrow_udf(decoded, "binary")

    def encode(self, text: str | Column) -> Column:
        """array<int>: the ids of the whole text; none for a null or empty one."""
        return self._encode(text)

    def decode(self, ids: str | Column) -> Column:
        """binary: the bytes of the ids; null for null."""
        return self._decode(ids)


def encode(docs: DataFrame, bpe: Bpe) -> DataFrame:
    """doc_id and ids of every row. Null and empty texts have no ids; ids, ties and repeats stay as they are."""
    return docs.select("doc_id", bpe.encode(whole_text()).alias("ids"))


def digests(encoded: DataFrame, bpe: Bpe, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digest of the ids in decimal and digest of the bytes that they decode to."""
    return encoded.select(
        "doc_id",
        *(["ids"] if keep_ids else []),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(bpe.decode("ids"), 256).alias("decoded_sha256"),
    )
