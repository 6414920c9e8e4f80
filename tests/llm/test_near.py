import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import texts_of
from tickloom.llm import near_dedup as nd
from tickloom.llm.components import components


def shingle_weights(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    every = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) > 4 else [tuple(w)] if w else []
    return {s: 1 + math.log(n) for s, n in Counter(every).items()}


def alike(a, b):
    """Probability Jaccard similarity, as it is defined."""
    shared = a.keys() & b.keys()
    if all(a[d] == b[d] for d in shared):
        inter = sum(a[d] for d in shared)
        return inter / (sum(a.values()) + sum(b.values()) - inter) if inter else 0
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in shared)


def brute(texts, links=None):
    sets = [shingle_weights(t) for _, t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(set)
    for a in range(len(texts)):
        near = set().union(*[holders[s] for s in sets[a]])
        for b in near:
            if alike(sets[a], sets[b]) >= 0.8 - 1e-12:
                up[root(a)] = root(b)
                if links is not None:
                    links.append((a, b))
        for s in sets[a]:
            holders[s].add(a)
    groups = {}
    for k, (i, _) in enumerate(texts):
        groups.setdefault(root(k), []).append(i)
    return Counter(((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g))


def got(docs):
    return Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in nd.near_copies(docs).collect())


def test_given_and_edges(documents, edge, none):
    docs = documents.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    assert got(docs) == brute(texts_of(docs))
    assert nd.near_copies(none).count() == 0
    kept = nd.drop_near_copies(edge)
    assert kept.columns == edge.columns and 6 not in [r["doc_id"] for r in kept.collect()]


def test_hub_and_chain(spark):
    """Copies that are near only to what they were made from, and a chain whose ends are far apart."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base)]
    for _ in range(60):
        w = list(base)
        for k in rng.sample(range(300), 6):
            w[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    chain = list(base[::-1])
    for _ in range(12):
        texts.append(" ".join(chain))
        for k in rng.sample(range(300), 4):
            chain[k] = f"y{rng.randrange(10**6)}"
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(docs) == brute(texts_of(docs))


def test_copy_of_a_copy_beside_a_hub(spark, monkeypatch):
    """Texts that are near to one copy each, a member of the hub's class, but not to the hub."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base)]
    for k in range(60):
        copy = list(base)
        copy[5 * k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
        if k % 2:
            at = [5 * j for j in range(1, 59) if abs(j - k) > 1]
            for j in rng.sample(at[rng.randrange(2) :: 2], 6):
                copy[j] = f"y{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts_of(docs))
    assert len(want) == 91 and {size for _, _, size in want} == {91}
    assert got(docs) == want
    monkeypatch.setattr(nd, "TILE", 8, raising=False)
    assert got(docs) == want


def test_repeats_weigh(spark):
    """Texts whose shared passages are repeated alike, and texts where one repeats them far more often."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for k in range(8):
        passages = [[word() for _ in range(14)] for _ in range(10)]
        for times, tail in ((3, 40), (3 if k % 2 else 50, 40)):
            texts.append(" ".join(w for p in passages for w in p * times) + " " + " ".join(word() for _ in range(tail if k < 6 else 5)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts_of(docs))
    assert {size for _, _, size in want} == {1, 2}
    assert got(docs) == want


def test_similarity_is_the_definition():
    rng = np.random.default_rng(3)
    for _ in range(200):
        keys = rng.permutation(40)
        own = [{int(k): float(w) for k, w in zip(keys[lo:hi], nd.weights(rng.integers(1, 9, hi - lo)))} for lo, hi in ((0, 30), (rng.integers(0, 35), 40))]
        sides = [x for o in own for x in (np.array(sorted(o), np.uint64), np.array([o[k] for k in sorted(o)]))]
        assert nd.similarity(*sides) == pytest.approx(alike(*own))


def test_large_group_below_the_threshold(spark, monkeypatch):
    """Copies that are alike but not enough leave no pair behind, whatever the size of their band."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for k in range(150):
        copy = list(base)
        for at in rng.sample(range(120), 3):
            copy[at] = f"x{k}-{at}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = nd.stored(nd.sketch(docs), "rows")
    reps = nd.stored(rows.select("key", "doc_id", "th", "size", "sig"), "reps")
    bands = nd.banded(reps)
    bands = bands.drop("size").join(bands.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1"), "band")
    alone = reps.select(F.col("key").alias("node"), F.col("key").alias("root"))
    tiles = nd.candidates(bands, alone, reps)
    sets = nd.shingle_sets(docs, reps)
    links = nd.verified(tiles, sets, 0.8).count()
    assert links <= tiles.count()
    monkeypatch.setattr(nd, "TILE", 16)
    want = brute(texts_of(docs))
    assert got(docs) == want


def test_recall_on_given_rows(spark):
    """No link of 0.8 or more is lost on the given documents, each against all others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    links = []
    want = brute(texts_of(docs), links)
    found = {r["doc_id"]: r["class_id"] for r in nd.near_copies(docs).collect()}
    ids = [i for i, _ in texts_of(docs)]
    kept = sum(found[ids[a]] == found[ids[b]] for a, b in links)
    assert len(links) > 90 and kept >= 0.99 * len(links)
    assert sum((Counter({(i, c): 1 for i, c, _ in want}) - Counter({(i, c): 1 for i, c in found.items()})).values()) <= 2


def test_estimate_is_probability_jaccard():
    rng = np.random.default_rng(1)
    a = {int(k): float(w) for k, w in zip(rng.integers(1, 2**62, 40), rng.uniform(1, 4, 40), strict=True)}
    b = {k: w * rng.uniform(0.5, 2) for k, w in a.items() if k % 4}
    want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
    m = 20_000
    sig = [nd.signatures(np.zeros(len(x), int), np.array(list(x), np.uint64), np.array(list(x.values())), 1, m) for x in (a, b)]
    assert abs((sig[0] == sig[1]).mean() - want) < 0.02


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    links = [(a, b) for a, b in links if a != b]
    up = {x: x for e in links for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    tree = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["root"] for r in tree.collect()} == {x: root(x) for x in up}
