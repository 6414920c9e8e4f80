"""Texts of an Arrow batch as one run of bytes, for numpy."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that are worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@functools.lru_cache(maxsize=2)
def _powers(bits: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    up = np.full(1 << bits, U64(base))
    down = np.full(1 << bits, U64(pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@functools.lru_cache(maxsize=4)
def letters(seed: int, fold: bool) -> np.ndarray:
    """A random number for each byte; with ``fold`` the same for A-Z as for a-z."""
    table = mix(np.arange(256, dtype=U64) + U64(1000 * seed + 1)) | U64(1)
    if fold:
        table[65:91] = table[97:123]
    return table


@dataclass
class Block:
    """Rows ``first`` to ``first + len(ends)`` of a batch: bytes, and where each text begins and ends."""

    first: int
    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray

    def hashes(self, seed: int = 0, fold: bool = False) -> RollingHash:
        return RollingHash(self.data, seed, fold)


class RollingHash:
    """Hashes of any stretches of the bytes, by content alone."""

    def __init__(self, data: np.ndarray, seed: int, fold: bool):
        up, self.down = _powers(max(16, int(len(data)).bit_length()), BASE + 2 * seed)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(letters(seed, fold)[data] * up[: len(data)], out=self.sums[1:])

    def of(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[begins]) * self.down[begins] + (ends - begins).astype(U64))

    def all_of(self, size: int) -> np.ndarray:
        """Of every stretch of one size."""
        n = len(self.sums) - size
        x = self.sums[size:] - self.sums[:n]
        x *= self.down[:n]
        x += U64(size)
        return mix(x)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The batch in blocks of whole texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        part = offsets[lo : hi + 1] - offsets[lo]
        yield Block(lo, data[offsets[lo] : offsets[hi]], part[:-1], part[1:])
        lo = hi


#: Bytes between words: space, tab and the line ends.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Bytes of words: digits, letters (A-Z too) and all that is not ASCII.
WORDLIKE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def words(block: Block, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row (within the block) of each longest run of bytes that are ``inside``."""
    n = len(block.data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    on = inside[block.data]
    edge = np.zeros(n + 1, bool)
    edge[block.begins] = True
    starts = on.copy()
    starts[1:] &= ~on[:-1] | edge[1:n]
    stops = on.copy()
    stops[:-1] &= ~on[1:] | edge[1:n]
    begins, ends = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    return begins, ends, np.searchsorted(block.ends, begins, side="right")
