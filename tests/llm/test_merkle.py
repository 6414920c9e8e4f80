import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.conftest import rows_of
from tickloom.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def tree(nodes):
    """Root, and the siblings (left, right) of each node, level by level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            lo = at // 16 * 16
            paths[k].append((nodes[lo:at], nodes[at + 1 : lo + 16]))
        nodes = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        where = [at // 16 for at in where]
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        crc = zlib.crc32(("" if r[0] is None else str(r[0])).encode())
        groups[r[1]].append((r[0], leaf(r), leaf((*r[:4], low)) if crc % 5 == 0 else leaf(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    lows = {s: sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in names}
    trees = {s: tree([x[1] for x in lows[s]]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        for (i, own, now), path in zip(lows[s], trees[s][1]):
            path = path + up
            for left, right in path:
                now = h(*left, now, *right)
            out.append((i, own, trees[s][0], root, h(*(x for l, r in path for x in l + r)), now, now == root))
    return sorted(out, key=str)


def given(docs):
    return [tuple(r) for r in docs.select(*merkle.COLUMNS).collect()]


def test_given_and_edges(documents, edge, none):
    cols = list(merkle.COLUMNS)
    docs = documents.select(cols).unionByName(edge.select(cols))
    got = rows_of(merkle.manifest_report(docs))
    assert got == brute(given(docs))
    assert {r[-1] for r in got} == {True, False}
    assert rows_of(merkle.manifest_report(edge)) == brute(given(edge))
    assert merkle.manifest_report(none).count() == 0


def test_runs_that_are_not_full_on_every_level(spark):
    """Sources of 1 to 4,370 leaves, and more sources than one run or block of them holds."""
    sizes = [1, 2, 15, 16, 17, 255, 256, 257, 4096, 4097, 4370] + [1] * 280
    rows = [(i, s, "Aa" if i % 3 else None) for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, s long, text string").select(
        "doc_id", F.concat(F.lit("s"), "s").alias("source"), F.lit(None).cast("string").alias("lang"), F.col("doc_id").alias("n_chars"), "text"
    )
    assert rows_of(merkle.manifest_report(docs)) == brute(given(docs))


def test_a_proof_convicts_any_change(spark):
    rows = [(i, "s", "en", 3, f"text {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaves = docs.select(F.col("source").alias("grp"), "doc_id", merkle.leaf([F.col(c) for c in merkle.COLUMNS]).alias("leaf"))
    out = merkle.proofs(leaves)
    bad = merkle.fold(F.sha2(F.lit("x"), 256), F.col("path")) == F.col("root")
    seen = out.select((merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("good"), bad.alias("bad")).distinct().collect()
    assert [tuple(r) for r in seen] == [(True, False)]
