"""The trie of all prefixes of sequences, with totals of each subtree, by van Emde Boas recursion on depth.

Down: a stretch of depths is cut in half. Its upper half keeps the name of the prefix that it stands on; its
lower half stands on the prefix that ends at the cut, named by the old name and the digest of what was cut off.
Both halves go on at once, so after log2(depth) cuts each place has the name of its prefix. Names depend on
content alone: equal prefixes of different sequences meet without being compared.

Up: totals are known within stretches of BASE depths first. Two neighbouring stretches are then joined: what
the lower forests hold is summed for each prefix at the cut and grafted on the nodes above it in the upper
half, again log2(depth) times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.ranking import range_numbers
from tickloom.llm.common import crc32_sql, stored

#: Places of one row of a path; longer sequences are rows of rows.
CHUNK = 64
#: Depths whose totals are summed directly, and the first cut that is grafted.
BASE, FIRST = 4, 2
#: Members of a node are listed by ranges of so many numbers.
LISTED = 4096
WIDTH = 16
ROOT = bytes(WIDTH)


def short(of: Column) -> Column:
    """The first bytes of a SHA-256 digest."""
    return F.substring(F.unhex(F.sha2(of, 256)), 1, WIDTH)


def _name(a: bytes, b: bytes) -> bytes:
    return hashlib.sha256(a + b).digest()[:WIDTH]


def _halves(symbols: list[bytes]) -> list[list[bytes]]:
    """Digests of the whole aligned stretches of 1, 2, 4, ... places."""
    levels = [symbols]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([_name(a, b) for a, b in zip(low[::2], low[1::2], strict=False)])
    return levels


def prefix_names(entry: bytes, symbols: list[bytes], last: bytes | None, size: int) -> list[bytes]:
    """Names of the prefixes that end before each place of a chunk of ``size``, and of the one that ends with the last."""
    levels, n = _halves(symbols), len(symbols)
    names = [entry]
    for k in range(size.bit_length() - 2, -1, -1):
        cut = []
        for i, name in enumerate(names):
            cut.append(name)
            if (2 * i + 1) << k <= n:
                cut.append(_name(name, levels[k][2 * i]))
        names = cut
    return names if n < size else [*names, last or _name(entry, levels[-1][0])]


def chunked(rows: DataFrame) -> DataFrame:
    """(conv, chunk, symbols, words) of rows (conv, pos, symbol, words)."""
    one = F.struct("pos", "symbol", "words")
    rows = rows.groupBy("conv", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(one)).alias("own"))
    return rows.select("conv", "chunk", F.col("own.symbol").alias("symbols"), F.col("own.words").alias("words"))


def paths(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, ended, names, words): the names of the prefixes before each place of a chunk, and after its last.

    Chunks that are full are the places of a sequence of their own, whose names are found first.
    """
    conv, size = F.col("conv"), CHUNK
    full = chunks.where(F.size("symbols") == CHUNK)
    if full.isEmpty():
        rows = chunks.select("*", F.lit(True).alias("ended"), F.lit(None).cast("binary").alias("entry"), F.lit(None).cast("binary").alias("last"))
    else:

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                tops = [_halves(s)[-1][0] for s in b["symbols"].to_pylist()]
                yield pa.RecordBatch.from_arrays([b["conv"], b["chunk"], pa.array(tops, pa.binary())], ["conv", "pos", "symbol"])

        upper = full.select("conv", "chunk", "symbols").mapInArrow(digest, "conv long, pos long, symbol binary")
        above = paths(stored(chunked(upper.withColumn("words", F.lit(0).cast("long"))), "chunks"))
        ahead = above.select("conv", F.posexplode(F.arrays_zip(F.slice("names", 1, F.size("names") - 1).alias("entry"), F.slice("names", 2, CHUNK).alias("last"))), "chunk")
        ahead = ahead.select(conv.alias("_conv"), (F.col("chunk") * CHUNK + F.col("pos")).alias("_chunk"), "col.entry", "col.last")
        # The chunk after a full one starts where that one ends.
        after = ahead.select("_conv", (F.col("_chunk") + 1).alias("_chunk"), F.col("last").alias("entry"), F.lit(None).cast("binary").alias("last"))
        known = ahead.unionByName(after).groupBy("_conv", "_chunk").agg(F.max("entry").alias("entry"), F.max("last").alias("last"))
        most = chunks.where((F.size("symbols") == CHUNK) | (F.col("chunk") > 0)).groupBy(conv.alias("_of")).agg(F.max("chunk").alias("_most"))
        rows = chunks.join(known, conv.eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")), "left")
        rows = rows.join(most, conv.eqNullSafe(F.col("_of")), "left")
        rows = rows.withColumn("ended", F.coalesce(F.col("chunk") == F.col("_most"), F.lit(True)))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = zip(b["entry"].to_pylist(), b["symbols"].to_pylist(), b["last"].to_pylist(), strict=True)
            names = pa.array([prefix_names(e or ROOT, s, z, size) for e, s, z in given], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([b["conv"], b["chunk"], b["ended"], names, b["words"]], ["conv", "chunk", "ended", "names", "words"])

    rows = rows.select("conv", "chunk", "ended", "entry", "last", "symbols", "words")
    return rows.mapInArrow(name, "conv long, chunk long, ended boolean, names array<binary>, words array<long>")


def _nodes(path: DataFrame) -> DataFrame:
    """name, depth, conv (smallest member), n_convs, n_ends, saved, and stack: the names of its stretch before and up to it."""
    rows = path.select("conv", "chunk", "ended", "names", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("i"))
    first = F.floor(F.col("i") / BASE).cast("int") * BASE
    rows = rows.select(
        F.get("names", F.col("i") + 1).alias("name"),
        (F.col("chunk") * CHUNK + F.col("i") + 1).alias("depth"),
        F.get("words", "i").alias("words"),
        F.slice("names", first + 1, F.col("i") - first + 2).alias("stack"),
        "conv",
        (F.col("ended") & (F.col("i") == F.size("words") - 1)).alias("end"),
    )
    rows = rows.groupBy("name", "depth", "words", "stack").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.count_if("end").alias("n_ends")
    )
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    return rows.select("name", "depth", "stack", "conv", "n_convs", "n_ends", saved)


def _summed(rows: DataFrame) -> DataFrame:
    """One row for each node (and the node before its stretch, where it is the first of it)."""
    return rows.groupBy("name", "depth", "above").agg(F.min("conv").alias("conv"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _within(nodes: DataFrame) -> DataFrame:
    """Totals of the subtree of each node within its stretch of BASE depths."""
    rows = nodes.select(
        "conv", "depth", "stack", F.posexplode(F.slice("stack", 2, BASE)).alias("i", "name"),
        (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaves"), "saved",
    )
    above = F.when(F.col("i") == 0, F.get("stack", F.lit(0)))
    return _summed(rows.withColumns({"depth": F.col("depth") - F.size("stack") + 2 + F.col("i"), "above": above}))


def _grafted(parts: list[DataFrame], path: DataFrame, k: int) -> DataFrame:
    """Totals of the forests below the cuts of 2^k depths, for every node between those cuts and the ones before them."""
    half = 1 << k
    at_cut = F.col("depth").bitwiseAND(F.lit(2 * half - 1)) == half + 1
    forests = [p.where(at_cut) for p in parts]
    rows = forests[0]
    for f in forests[1:]:
        rows = rows.unionByName(f)
    cut = F.min(F.col("depth") - 1).alias("cut")
    rows = rows.groupBy("above").agg(F.min("conv").alias("conv"), cut, F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    top = F.col("cut") - half
    rows = rows.withColumns({"top": top, "chunk": F.explode(F.sequence(F.floor(top / CHUNK), F.floor((F.col("cut") - 1) / CHUNK)))})
    rows = rows.withColumnsRenamed({"conv": "_conv", "chunk": "_chunk"}).drop("above")
    # A null number is a sequence like others.
    both = path.select("conv", "chunk", "names").join(rows, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")))
    begin = F.greatest(F.col("top") - F.col("chunk") * CHUNK, F.lit(0)).cast("int")
    end = F.least(F.col("cut") - F.col("chunk") * CHUNK, F.lit(CHUNK)).cast("int")
    both = both.select(
        "conv", "chunk", "top", "leaves", "saved", begin.alias("begin"), F.slice("names", begin + 1, end - begin + 1).alias("stack")
    )
    both = both.select("*", F.posexplode(F.slice("stack", 2, CHUNK)).alias("i", "name"))
    depth = F.col("chunk") * CHUNK + F.col("begin") + F.col("i") + 1
    above = F.when(depth == F.col("top") + 1, F.get("stack", F.lit(0)))
    return _summed(both.withColumns({"depth": depth, "above": above}))


def listed(members: DataFrame) -> DataFrame:
    """(name, ends_sha256) of rows (name, conv): the digest of the decimal numbers, ascending (null first and empty).

    Numbers are joined by ranges before they meet, and a node's text is hashed as it streams by.
    """
    pieces = members.groupBy("name", F.floor(F.col("conv") / LISTED).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for name, text in zip(b["name"].to_pylist(), b["text"].to_pylist(), strict=True):
                if name != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = name, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["name", "ends_sha256"]
            )
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["name", "ends_sha256"])

    ordered = pieces.repartition("name").sortWithinPartitions("name", F.col("piece").asc_nulls_first())
    return ordered.select("name", "text").mapInArrow(run, "name binary, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of the trie of sequences.

    ``rows`` are their places (conv, pos from 0 without gaps, symbol of 16 bytes, words), ``convs`` all of them
    (conv, length), those without places too. Returns name, parent, conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Without sequences no rows.
    """
    root = F.lit(ROOT)
    chunks = stored(chunked(rows), "chunks")
    path = stored(paths(chunks), "paths")
    nodes = stored(_nodes(path), "nodes")
    deepest = path.agg(F.max(F.col("chunk") * CHUNK + F.size("words"))).first()[0] or 0
    parts, k = [stored(_within(nodes), "within")], FIRST
    while 1 << k < deepest:
        parts.append(stored(_grafted(parts, path, k), "grafted"))
        k += 1
    totals = parts[0]
    for p in parts[1:]:
        totals = totals.unionByName(p)
    zero, parent = F.lit(0).cast("long"), F.get("stack", F.size("stack") - 2)
    sums = totals.select("name", "leaves", "saved", zero.alias("children"))
    sums = sums.unionByName(totals.where("depth = 1").select(root.alias("name"), "leaves", "saved", zero.alias("children")))
    sums = sums.unionByName(nodes.select(parent.alias("name"), zero.alias("leaves"), zero.alias("saved"), F.lit(1).cast("long").alias("children")))
    sums = sums.groupBy("name").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved_tokens"), F.sum("children").alias("n_children")
    )
    top = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.count_if(F.col("length") == 0).alias("n_ends")).where("n_convs > 0")
    top = top.select(root.alias("name"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), "conv", "n_convs", "n_ends")
    every = nodes.select("name", parent.alias("parent"), "depth", "conv", "n_convs", "n_ends").unionByName(top)
    ends = path.where("ended").select(F.element_at("names", -1).alias("name"), "conv")
    ends = listed(ends.unionByName(convs.where("length = 0").select(root.alias("name"), "conv")))
    out = every.join(sums, "name", "left").join(ends, "name", "left")
    owner = every.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    # The children of one node may be many: a merge join can split them.
    out = out.hint("merge").join(owner.hint("merge"), "parent", "left")
    children = F.coalesce("n_children", zero)
    return out.select(
        "name", "parent", F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", children.alias("n_children"),
        F.when(children == 0, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


#: Conversations of one block share their beginnings; so many turns at most.
BLOCK, HEADS = 20, 4


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations (conv, pos, symbol, words), and all of them (conv, length).

    The first h turns come from the first conversation of the block, h by the CRC-32 of the number; then come
    the conversation's own turns after its first h. Equal turn numbers go by the digest of role and text.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    symbol = short(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), symbol.alias("symbol"), words.alias("words")
    )
    # Texts are read once, not again for the bounds of the ranges.
    order = [F.col("turn").asc_nulls_first(), F.col("symbol").asc()]
    turns = range_numbers(stored(turns, "turns"), "conv", order, "nth")
    turns = stored(turns.select("conv", (F.col("nth") - 1).alias("pos"), "symbol", "words"), "numbered")
    conv = F.col("conv")
    h = F.crc32(F.coalesce(conv.cast("string"), F.lit("")).cast("binary")) % HEADS
    own = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"h": h, "base": conv - conv % BLOCK})
    bases = own.where(conv == F.col("base")).select(conv.alias("base"), F.col("n").alias("there"))
    own = own.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    own = stored(own.select("conv", "base", "n", "h", "m"), "convs")
    # Where the block's first conversation is too short, what follows moves up.
    moved = own.where("m < h").select(conv.alias("_conv"), (F.col("h") - F.col("m")).alias("up"))
    tail = turns.where(F.col("pos") >= h).join(moved, conv.eqNullSafe(F.col("_conv")), "left")
    tail = tail.select("conv", (F.col("pos") - F.coalesce("up", F.lit(0))).alias("pos"), "symbol", "words")
    heads = own.where("m > 0").select("conv", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("pos"))
    starts = turns.where((conv % BLOCK == 0) & (F.col("pos") < HEADS - 1)).withColumnRenamed("conv", "base")
    heads = heads.join(starts, ["base", "pos"]).select("conv", "pos", "symbol", "words")
    length = F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return tail.unionByName(heads), own.select("conv", length.alias("length"))


def trie_report(conversations: DataFrame) -> DataFrame:
    """Per node of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id are one conversation of their own, which no other takes turns from; it is a smallest
    member only where it is the only one, and the empty text, first, in lists. Null roles and texts are
    empty, null turns come first, a row that is there twice is two turns. An empty table gives no rows.
    Other columns are not read.
    """
    return trie(*rebuilt(conversations)).drop("name", "parent")


SQL = f"""WITH a AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
b AS (SELECT c, turn, sha256(strlen(role) || ':' || role || text) AS s, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM a),
t AS MATERIALIZED (SELECT c, s, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, s) - 1 AS pos FROM b),
k AS MATERIALIZED (SELECT c, n, h, least(h, coalesce(there, 0)) AS m, c - c % 20 AS base FROM
  (SELECT c, count(*) AS n, ({crc32_sql("CAST(c AS VARCHAR)")}) % 4 AS h FROM t GROUP BY c)
  LEFT JOIN (SELECT c AS b, count(*) AS there FROM t GROUP BY c) ON b = c - c % 20),
r AS MATERIALIZED (SELECT k.c, pos - h + m AS pos, s, w FROM t JOIN k USING (c) WHERE pos >= h
  UNION ALL SELECT k.c, pos, s, w FROM k JOIN t ON t.c = base AND pos < m),
p AS MATERIALIZED (SELECT c, pos + 1 AS d, string_agg(s, '') OVER (PARTITION BY c ORDER BY pos) AS name,
  coalesce(string_agg(s, '') OVER (PARTITION BY c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up, w,
  pos + 1 = count(*) OVER (PARTITION BY c) AS e FROM r
  UNION ALL SELECT c, 0, '', NULL, 0, m + greatest(n - h, 0) = 0 FROM k),
nodes AS MATERIALIZED (SELECT name, up, d, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(w) AS saved,
  coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (e), '') AS members, bool_and(e) AS leaf FROM p GROUP BY name, up, d),
below AS (SELECT DISTINCT x.name, y.name AS low FROM p x JOIN p y ON x.c = y.c AND y.d >= x.d),
sums AS (SELECT below.name, count(*) FILTER (leaf) AS leaves, sum(saved) AS saved FROM below JOIN nodes ON low = nodes.name GROUP BY below.name)
SELECT x.c AS conv_id, x.d AS depth, y.c AS parent_conv_id, x.n AS n_convs, (SELECT count(*) FROM nodes z WHERE z.up = x.name) AS n_children,
  leaves AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(x.members) AS ends_sha256
FROM nodes x JOIN sums ON sums.name = x.name LEFT JOIN nodes y ON y.name = x.up"""
