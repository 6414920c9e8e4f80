"""Near copies by ProbMinHash, banding and verification.

The weighted word shingles of a text arrive as Poisson processes: a shingle of weight w at rate w, each
arrival at a random one of M registers, which keeps the first to come. Once a shingle's next arrival is
later than what all registers hold, it and all that follow of it can change nothing, so most shingles
stop after one or two. Two texts agree in a register with the probability Jaccard similarity of their
weights: for shingles that are there once it is the Jaccard similarity of the sets. Bands of registers give
candidates, whole signatures an estimate, and the weighted shingles themselves the verdict.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bitfilter import drop_rows, only_rows
from tickloom.llm.common import stored, whole_text
from tickloom.llm.components import components
from tickloom.llm.textblocks import SPACE, U64, Block, blocks, mix, words

SHINGLE, LEAST = 5, 0.8
#: A pair of similarity 0.8 misses all bands with probability (1 - 0.8^5)^24, under one in ten thousand.
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Four standard deviations of the estimate below the threshold.
ESTIMATE = 0.65
#: Nodes of a band that are compared with as many others at once, and shingles of them.
TILE, TILE_SHINGLES = 256, 1 << 21
#: Columns of a product of shingle tables.
WIDE = 1 << 12
STEP = U64(0x9E3779B97F4A7C15)


def shingles(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Row, hash and count of each distinct shingle, by row; and a digest of each row's words.

    Words are what stands between white space, A-Z as a-z. A text of fewer words is one shingle.
    """
    begins, ends, row = words(block, ~SPACE)
    word = block.hashes(3, fold=True).of(begins, ends)
    n = np.bincount(row, minlength=len(block.ends))
    last = np.cumsum(n)
    digests = [hashlib.blake2b(word[e - k : e].tobytes(), digest_size=16).digest() if k else b"" for e, k in zip(last, n, strict=True)]
    at = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1]) if len(row) >= size else np.empty(0, np.int64)
    h, r = np.zeros(len(at), U64), row[at]
    for j in range(size):
        h = mix(h * U64(31) + word[at + j])
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        h = np.r_[h, np.array([int.from_bytes(digests[i][:8], "little") for i in short], U64)]
        r = np.r_[r, short]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.empty(0, np.int64)
    return r[new], h[new], np.diff(np.r_[new, len(h)]), digests


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """The first shingle to reach each register, for each of n rows."""
    first, holds = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint32)
    t, seen, many = np.zeros(len(row)), 0, 1
    while len(row):
        # Arrivals come in runs that double, as few shingles are left after the first two.
        draw = mix(shingle[:, None] + STEP * (U64(seen + 1) + np.arange(many, dtype=U64)))
        times = t[:, None] + np.cumsum(-np.log(((draw >> U64(11)).astype(float) + 1) * 2.0**-53) / weight[:, None], axis=1)
        place = (row[:, None] * registers + (mix(draw ^ STEP) % U64(registers)).astype(np.int64)).ravel()
        came = times.ravel()
        early = np.flatnonzero(came < first[place])
        early = early[np.argsort(-came[early], kind="stable")]  # the earliest is written last
        first[place[early]] = came[early]
        holds[place[early]] = (shingle[early // many] >> U64(32)).astype(np.uint32)
        t = times[:, -1]
        on = t < first.reshape(n, registers).max(axis=1)[row]
        row, shingle, weight, t = row[on], shingle[on], weight[on], t[on]
        seen, many = seen + many, min(64, many * 2 if seen else 1)
    return holds.reshape(n, registers)


def weights(count: np.ndarray) -> np.ndarray:
    """What a shingle weighs that a text has so many times."""
    return 1 + np.log(count)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, __th (hash of the text), key (digest of its words, empty if none), size (shingles) and sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch["text"]):
                n = len(b.ends)
                row, h, count, digests = shingles(b)
                sig = signatures(row, h, weights(count), n)
                rows = batch.slice(b.first, n)
                size = pa.array(np.bincount(row, minlength=n), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], rows["th"], pa.array(digests, pa.binary()), size, pa.array([s.tobytes() for s in sig], pa.binary())],
                    ["doc_id", "th", "key", "size", "sig"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("th"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, key binary, size long, sig binary")


def shingle_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """node, hashes (ascending) and counts (empty where all are 1) of the texts of ``reps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch["text"]):
                row, h, count, _ = shingles(b)
                cut = np.searchsorted(row, np.arange(len(b.ends) + 1))
                parts = [(h[x:y], count[x:y].astype(np.uint32)) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["key"].slice(b.first, len(parts)),
                        pa.array([x.tobytes() for x, _ in parts], pa.binary()),
                        pa.array([c.tobytes() if (c > 1).any() else b"" for _, c in parts], pa.binary()),
                    ],
                    ["node", "hashes", "counts"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("th"), whole_text().alias("text"))
    texts = only_rows(texts, reps.select("doc_id", "th", "key"), ["doc_id", "th"]).dropDuplicates(["key"])
    return texts.select("key", "text").mapInArrow(run, "node binary, hashes binary, counts binary")


def banded(reps: DataFrame) -> DataFrame:
    """(node, number, band): the bands of a node, by number and by what it holds there."""
    width = 4 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 1 + b * width, width)) for b in range(BANDS)])
    return reps.select(F.col("key").alias("node"), "size", F.posexplode(keys).alias("number", "band"))


def starred(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(hub, node) of each node of a band and its hub, the node of the band that is in the most and largest bands.

    Only pairs whose signatures agree in a share of ESTIMATE of the registers.
    """

    @F.arrow_udf("double")
    def agree(x: pa.Array, y: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(len(c), REGISTERS) for c in (x, y))
        return pa.array((a == b).mean(axis=1))

    popular = rows.groupBy("node").agg(F.sum("n").alias("pop"))
    hub = rows.join(popular, "node").groupBy("band").agg(F.max(F.struct("pop", "node"))["node"].alias("hub"))
    both = rows.join(hub, "band").where("node <> hub").select("hub", "node").distinct()
    sig = reps.select(F.col("key").alias("node"), "sig")
    both = both.join(sig.withColumnsRenamed({"node": "hub", "sig": "sh"}), "hub").join(sig, "node")
    return both.where(agree("sh", "sig") >= ESTIMATE).select("hub", "node")


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """The probability Jaccard similarity of weighted shingles; hashes ascend.

    The sum over shared d of 1 / sum over e of max(a(e) / a(d), b(e) / b(d)). By rising ratio a / b the inner
    maxima are b's below d and a's from d on.
    """
    _, x, y = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(x):
        return 0.0
    a, b = wa[x], wb[y]
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    only_a, only_b = wa.sum() - a.sum(), wb.sum() - b.sum()
    from_on, below = np.cumsum(a[::-1])[::-1], np.cumsum(b) - b
    return float((a / (only_a + from_on + a / b * (only_b + below))).sum())


def _product(hashes: list[np.ndarray], values: list[list[np.ndarray]], nx: int) -> list[np.ndarray]:
    """Per kind of values, sums over shared hashes for each of the first nx texts with each of the others.

    ``values`` are pairs of a text's own and its partner's factors, one list for each product.
    """
    owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    every, place = np.unique(np.concatenate(hashes), return_inverse=True)
    left = np.bincount(place[owner < nx], minlength=len(every)) > 0
    both = left & (np.bincount(place[owner >= nx], minlength=len(every)) > 0)
    number = np.cumsum(both) - 1
    keep = both[place]
    owner, place = owner[keep], number[place[keep]]
    flat = [(np.concatenate(x)[keep], np.concatenate(y)[keep]) for x, y in values]
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(0, int(both.sum()) + WIDE, WIDE))
    out = [np.zeros((nx, len(hashes) - nx)) for _ in values]
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = order[lo:hi]
        for total, (x, y) in zip(out, flat, strict=True):
            tables = []
            for v in (x, y):
                table = np.zeros((len(hashes), WIDE))
                table[owner[part], place[part] - k * WIDE] = v[part]
                tables.append(table)
            total += tables[0][:nx] @ tables[1][nx:].T
    return out


def linked(hashes: list[np.ndarray], counts: list[np.ndarray], nx: int, kind: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A forest of links of ``least`` or more between the first nx texts and the others, of unlike kinds.

    A link between texts that the forest connects already is left out, and so is what lies below the threshold,
    so there are fewer links than texts.
    """
    own = [weights(c) for c in counts]
    total = np.array([w.sum() for w in own])
    plain = all((c == 1).all() for c in counts)
    ones = [np.ones(len(c)) for c in counts]
    shared = _product(hashes, [[ones, ones]] if plain else [[own, ones], [ones, own]], nx)
    a, b = total[:nx, None], total[None, nx:]
    if plain:
        value = shared[0] / np.maximum(a + b - shared[0], 1)
    else:  # a bound: no shingle adds more than its share in either text
        value = np.minimum(shared[0] / np.maximum(a, 1e-300), shared[1] / np.maximum(b, 1e-300)) + 1e-9
    value[kind[:nx, None] == kind[None, nx:]] = 0
    up = {int(k): int(k) for k in kind}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j in zip(*(k.tolist() for k in np.nonzero(value >= least)), strict=True):
        r, s = root(int(kind[i])), root(int(kind[nx + j]))
        if r != s and (plain or similarity(hashes[i], own[i], hashes[nx + j], own[nx + j]) >= least):
            up[r] = s
            out.append((i, nx + j))
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group of neighbours with equal keys (64-bit numbers), whole."""
    held: list[pa.Table] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        of = np.stack([part[k].to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1).tolist(), len(part)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            key = of[:, s].tolist()
            if held and key != now:
                yield pa.concat_tables(held)
                held = []
            now = key
            held.append(part.slice(s, e - s))
    if held:
        yield pa.concat_tables(held)


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")


def verified(tiles: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): a forest of links within each tile (band, lo, hi, second, class, node), between its two sides or within one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _grouped(batches, ["band", "lo", "hi"]):
            kind, second = part["class"].to_numpy(), part["second"].to_numpy()
            if (kind == kind[0]).all():
                continue
            order = np.argsort(second, kind="stable")
            nx = int((~second).sum())
            if nx in (0, len(order)):  # one tile with itself
                order, nx = np.r_[order, order], len(order)
            hashes = [np.frombuffer(h, U64) for h in part["hashes"].to_pylist()]
            counts = [np.frombuffer(c, np.uint32) for c in part["counts"].to_pylist()]
            counts = [c if len(c) else np.ones(len(h), np.uint32) for h, c in zip(hashes, counts, strict=True)]
            pairs = linked([hashes[k] for k in order], [counts[k] for k in order], nx, kind[order], least)
            node = part["node"].to_pylist()
            if pairs:
                ends = [pa.array([node[order[p[k]]] for p in pairs], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    rows = _by_tile(tiles.join(sets, "node").select("band", "lo", "hi", "second", "class", "node", "hashes", "counts"))
    return rows.mapInArrow(run, "a binary, b binary")


def candidates(rows: DataFrame, tree: DataFrame, reps: DataFrame) -> DataFrame:
    """Tiles (band, lo, hi, second, class, node) of the nodes that agree in a share of ESTIMATE with one of another class.

    A band is cut into tiles, and each pair of tiles is compared on its own, so that a large band spreads over
    tasks and signatures travel once a pair of tiles, not once a pair of nodes. Of the bands that a pair shares
    the first names it. What comes out are nodes, not pairs.
    """
    need = round(ESTIMATE * REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _grouped(batches, ["band", "lo", "hi"]):
            kind, second, number = part["class"].to_numpy(), part["second"].to_numpy(), int(part["number"][0].as_py())
            x, y = np.flatnonzero(~second), np.flatnonzero(second)
            if part["lo"][0] == part["hi"][0]:
                y = x
            if not len(x) or not len(y) or (kind == kind[0]).all():
                continue
            sig = np.frombuffer(b"".join(part["sig"].to_pylist()), np.uint32).reshape(len(part), REGISTERS)
            met = np.zeros(len(part), bool)
            step = max(1, (1 << 22) // (len(y) * REGISTERS))
            for k in range(0, len(x), step):
                own = x[k : k + step]
                i, j = np.nonzero(((sig[own, None] == sig[None, y]).sum(axis=2) >= need) & (kind[own, None] != kind[None, y]))
                first = (sig[own[i]] == sig[y[j]]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == number
                met[own[i[first]]] = met[y[j[first]]] = True
            if met.any():
                out = part.select(["band", "lo", "hi", "second", "class", "node"]).filter(pa.array(met)).combine_chunks()
                yield from out.to_batches()

    rows = rows.join(tree, "node", "left").select("band", "number", "n", "total", "node", F.coalesce("root", "node").alias("root"))
    mixed = rows.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("band")
    tiles = _tiles(F.col("n"), F.col("total"))
    rows = rows.join(mixed, "band").withColumn("tile", F.pmod(F.xxhash64("band", "node"), tiles))
    rows = rows.join(reps.select(F.col("key").alias("node"), "sig"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    rows = rows.select(
        "band", "number", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"),
        (F.col("tile") > F.col("other")).alias("second"), F.xxhash64("root").alias("class"), "node", "sig",
    )
    return _by_tile(rows).mapInArrow(run, "band long, lo long, hi long, second boolean, class long, node binary")


def _tiles(nodes: Column, size: Column) -> Column:
    return F.ceil(F.greatest(nodes / TILE, size / TILE_SHINGLES))


def _star_tiles(stars: DataFrame, reps: DataFrame) -> DataFrame:
    """Each hub with TILE of its nodes at a time."""
    size = reps.select(F.col("key").alias("node"), "size")
    rows = stars.join(size, "node")
    tiles = rows.groupBy("hub").agg(_tiles(F.count("*"), F.sum("size")).alias("tiles"))
    rows = rows.join(tiles, "hub").select(
        F.xxhash64("hub").alias("band"), F.pmod(F.xxhash64("node"), F.col("tiles")).alias("lo"), F.lit(True).alias("second"), "node"
    )
    hubs = tiles.select(F.xxhash64("hub").alias("band"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("lo"), F.lit(False).alias("second"), F.col("hub").alias("node"))
    both = rows.unionByName(hubs)
    return both.select("band", "lo", F.lit(0).cast("long").alias("hi"), "second", F.xxhash64("node").alias("class"), "node")


def classes(docs: DataFrame, reps: DataFrame, least: float = LEAST) -> DataFrame:
    """(node, root) of the nodes that verified links between nodes in common bands connect.

    Every node of a band is first compared with its hub, the node that shares the most bands with others, as
    the text does that the others were made of, so most copies are in one class then. Next, all nodes of a band
    that are not in one class are compared, whether or not they are in the class of the hub: no pair of a band
    is left out unless it is in one class or its estimate is too low. Comparing is done within tiles, of which
    only a forest of links comes out; pairs that are alike but below the threshold leave no row behind.
    """
    rows = banded(reps)
    shared = rows.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1")
    rows = stored(rows.drop("size").join(shared, "band"), "bands")
    needed = reps.join(rows.select(F.col("node").alias("key")).distinct(), "key")
    sets = stored(shingle_sets(docs, stored(needed.select("doc_id", "th", "key"), "needed")), "sets")
    links = stored(verified(_star_tiles(stored(starred(rows, reps), "stars"), reps), sets, least), "links")
    tree = stored(components(links), "tree")
    tiles = stored(candidates(rows, tree, reps), "tiles")
    found = stored(verified(tiles, sets, least), "links")
    if found.isEmpty():
        return tree
    # Stars of the classes so far stand for their links.
    stars = tree.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return stored(components(found.unionByName(stars)), "tree")


def near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept, and th, the hash of the text.

    Documents are linked if their five-word shingles, each weighing 1 and the logarithm of its count, have a
    probability Jaccard similarity of 0.8 or more (without repeats inside a text: the Jaccard similarity of the
    sets); a class is what links connect, named by its smallest doc_id, which is kept. Texts of the same words
    are one node, so copies add no pairs. A null or empty text has no words and is a class of its own (by
    doc_id); a null doc_id is never smaller than another. A row that is there more than once counts each
    time. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    rows = stored(sketch(docs), "sketch")
    full = rows.where("length(key) > 0")
    one = F.min(F.struct("doc_id", "th")).alias("one")
    reps = full.groupBy("key").agg(one, F.first("size").alias("size"), F.first("sig").alias("sig")).select("key", "one.*", "size", "sig")
    reps = stored(reps, "reps")
    tree = classes(docs, reps, least)
    nodes = full.select("doc_id", "th", "key").join(tree.withColumnRenamed("node", "key"), "key", "left")
    nodes = nodes.select("doc_id", "th", F.coalesce("root", "key").alias("root"))
    sizes = nodes.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    empty = rows.where("length(key) = 0").select("doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    out = nodes.join(sizes, "root").select("doc_id", "th", "class_id", "class_size").unionByName(empty)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that are kept, with all their columns (names that start with ``__`` are reserved).

    Of a row that is there more than once, with id and text, all repeats stay or go.
    """
    gone = stored(near_copies(docs, least).where("not kept").select("doc_id", F.col("th").alias("__th")), "gone")
    rows = docs.withColumn("__th", F.xxhash64(whole_text()))
    return drop_rows(rows, gone, ["doc_id", "__th"]).select(*docs.columns)
