"""A Merkle manifest of a table: leaves, subroots, root, and the siblings that prove a row.

The nodes of a level are one string of digests per aligned block, so a parent is the hash of a substring of
fixed width and the siblings of a node are what stands left and right of it. A block ends as one digest;
these are the nodes of the next round, until one is left. All is SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.ranking import range_numbers
from tickloom.llm.common import crc32_sql, id_fold, stored

#: Nodes under one parent, and levels that a block goes through: 256 leaves, a string of 16 kB.
RUN, LEVELS = 16, 2
BLOCK = RUN**LEVELS
#: Letters of a digest.
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

Finish = Callable[[DataFrame], DataFrame]


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row: each value as ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf leads to along its siblings."""
    return F.aggregate(path, start, lambda now, p: F.sha2(F.concat(p["left"], now, p["right"]), 256))


def sibling_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def _parents(level: Column) -> Column:
    last = F.ceil(F.length(level) / (RUN * HEX)).cast("int") - 1
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(level, i * (RUN * HEX) + 1, RUN * HEX), 256)), "")


def packed(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes: grp, block, size (nodes of the level in all of grp), level0 .. levelN, top, and items by place."""
    one = F.struct("place", "digest", "item")
    rows = nodes.groupBy("grp", F.floor(F.col("place") / BLOCK).alias("block")).agg(
        F.max("size").alias("size"), F.sort_array(F.collect_list(one)).alias("items")
    )
    rows = rows.withColumn("level0", F.array_join("items.digest", ""))
    for k in range(LEVELS):
        rows = rows.withColumn(f"level{k + 1}", F.when(F.col("size") > RUN**k, _parents(F.col(f"level{k}"))))
    top = F.coalesce(*[F.col(f"level{k}") for k in range(LEVELS, -1, -1)])
    items = F.transform("items", lambda x: F.struct(x["place"], x["item"]))
    return rows.withColumns({"top": top, "items": items})


def _local_path(place: Column) -> Column:
    """The siblings of a node in the levels of its block."""
    steps = []
    for k in range(LEVELS):
        at = F.floor(place % BLOCK / RUN**k).cast("int")
        run, own = F.floor(at / RUN).cast("int") * (RUN * HEX), at % RUN * HEX
        text = F.substring(F.col(f"level{k}"), run + 1, F.lit(RUN * HEX))
        step = F.struct(F.substring(text, F.lit(1), own).alias("left"), F.substring(text, own + HEX + 1, F.lit(RUN * HEX)).alias("right"))
        steps.append(F.when(F.col("size") > RUN**k, step))
    return F.array_compact(F.array(*steps))


def climb(nodes: DataFrame, finish: Finish) -> DataFrame:
    """Each node (grp, place from 0, size, digest, item) with its path, the siblings level by level, and what ``finish`` adds.

    ``finish`` gets one row (grp, place 0, digest) per group, its root, and returns path, subroot and root for it.
    """
    blocks = stored(packed(nodes), "blocks")
    tops = blocks.select(
        "grp", F.col("block").alias("place"), F.ceil(F.col("size") / BLOCK).alias("size"), F.col("top").alias("digest"),
        F.struct(F.lit(True).alias("inner")).alias("item"),
    )
    most = blocks.agg(F.max("size")).first()[0] or 0
    above = climb(tops, finish) if most > BLOCK else finish(tops)
    above = above.select(F.col("grp").alias("_grp"), F.col("place").alias("_block"), F.col("path").alias("_path"), "subroot", "root")
    rows = blocks.join(above, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_block")))
    rows = rows.withColumn("_one", F.explode("items"))
    place = F.col("_one.place")
    digest = F.substring(F.col("level0"), (place % BLOCK * HEX + 1).cast("int"), F.lit(HEX))
    return rows.select(
        "grp", place.alias("place"), digest.alias("digest"), F.col("_one.item").alias("item"),
        F.concat(_local_path(place), F.col("_path")).alias("path"), "subroot", "root",
    )


def _own_root(tops: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<left:string,right:string>>")
    return tops.withColumns({"path": none, "subroot": F.col("digest"), "root": F.col("digest")})


def _over_groups(tops: DataFrame) -> DataFrame:
    """The tree over the subroots, in order of their groups."""
    tops = tops.withColumn("_all", F.lit(0))
    order = [F.col("grp").asc_nulls_first()]
    rows = range_numbers(tops, "_all", order, "_nth", "_groups")
    nodes = rows.select(
        F.lit("").alias("grp"), (F.col("_nth") - 1).alias("place"), F.col("_groups").alias("size"), "digest",
        F.struct(F.col("grp").alias("of")).alias("item"),
    )
    out = climb(nodes, _own_root)
    return out.select(
        F.col("item.of").alias("grp"), F.lit(0).cast("long").alias("place"), "digest", "path", F.col("digest").alias("subroot"), "root"
    )


def proofs(leaves: DataFrame) -> DataFrame:
    """Each leaf (grp, doc_id, leaf, more) with path (array of left and right siblings), subroot and root.

    Leaves of a group ascend by doc_id, null first; equal ids by their digest.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    rows = range_numbers(leaves, "grp", order, "_nth", "_size")
    item = F.struct("doc_id", *[c for c in leaves.columns if c not in ("grp", "doc_id", "leaf")]).alias("item")
    nodes = rows.select("grp", (F.col("_nth") - 1).alias("place"), F.col("_size").alias("size"), F.col("leaf").alias("digest"), item)
    return climb(nodes, _over_groups).select("grp", F.col("digest").alias("leaf"), "item.*", "path", "subroot", "root")


def manifest_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    A source (null too) is a tree of its own; equal rows are leaves each. A null id counts as empty text where
    the fold of tampered rows is drawn. An empty table gives no rows. Only the columns of the leaf are read.
    """
    values = [F.col(c) for c in COLUMNS]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    forged = leaf([*values[:-1], lowered])
    rows = docs.select(
        F.col("source").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf(values).alias("leaf"),
        F.when((id_fold(5) == 0) & (lowered != F.col("text")), forged).alias("forged"),
    )
    # Texts are read and hashed once, not again for the bounds of the ranges.
    out = proofs(stored(rows, "leaves"))
    folded = fold(F.coalesce("forged", "leaf"), F.col("path"))
    out = out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(sibling_text(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(leaf_levels: int = 6, source_levels: int = 4) -> str:
    """Levels written out: up to 16^6 leaves of a source and 16^4 sources."""
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    head = " || ".join(enc(c) for c in COLUMNS[:-1])
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    low = f"CASE WHEN text IS NULL THEN '-' ELSE strlen({low}) || ':' || {low} END"
    crc = crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")
    parts = [
        f"""l AS MATERIALIZED (SELECT doc_id, source, sha256({head} || {enc("text")}) AS leaf,
  CASE WHEN ({crc}) % 5 = 0 THEN sha256({head} || {low}) ELSE sha256({head} || {enc("text")}) END AS now FROM documents)""",
        """d0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
  '' AS proof FROM l)""",
        """t0 AS MATERIALIZED (SELECT source, place, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM d0)""",
    ]

    def level(k: int, d: str, t: str, key: str, same: str, p: str) -> None:
        parts.append(f"""r{t}{k} AS MATERIALIZED (SELECT {key}, place // 16 AS place, n, string_agg(digest, '' ORDER BY place) AS s FROM {t}{k} GROUP BY ALL)""")
        parts.append(f"""{t}{k + 1} AS MATERIALIZED (SELECT {key}, place, CASE WHEN n = 1 THEN s ELSE sha256(s) END AS digest, (n + 15) // 16 AS n FROM r{t}{k})""")
        left, right = f"substr(s, 1, 64 * ({p} % 16))", f"substr(s, 64 * ({p} % 16) + 65)"
        parts.append(
            f"""{d}{k + 1} AS MATERIALIZED (SELECT d.* REPLACE (CASE WHEN n = 1 THEN now ELSE sha256({left} || now || {right}) END AS now,
  CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof, {p} // 16 AS {p}) FROM {d}{k} d JOIN r{t}{k} r ON {same} AND {p} // 16 = r.place)"""
        )

    for k in range(leaf_levels):
        level(k, "d", "t", "source", "d.source IS NOT DISTINCT FROM r.source", "d.place")
        parts[-1] = parts[-1].replace("AS d.place", "AS place")
    n = leaf_levels
    parts.append(f"sub AS MATERIALIZED (SELECT source, digest AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS nth FROM t{n})")
    parts.append("u0 AS MATERIALIZED (SELECT nth AS place, subroot AS digest, count(*) OVER () AS n, 0 AS one FROM sub)")
    parts.append(f"e0 AS MATERIALIZED (SELECT d.doc_id, d.leaf, subroot, now, proof, nth FROM d{n} d JOIN sub ON d.source IS NOT DISTINCT FROM sub.source)")
    for k in range(source_levels):
        level(k, "e", "u", "one", "r.one = 0", "nth")
    m = source_levels
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = digest AS verified FROM e{m}, u{m}"""
    )


SQL = _sql()
