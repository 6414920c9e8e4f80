from collections import defaultdict

import numpy as np
import re

from tests.llm.conftest import rows_of
from tickloom.llm import mixture as m


def test_targets_by_hand():
    assert np.allclose(m.water_fill([10, 10, 10], [5, 2, 1], 45, 2), [20, 2 / 3 * 25, 1 / 3 * 25])
    assert m.water_fill([0, 4], [5, 2], 6, 2) == [0, 6]


def test_permutation():
    for n in (1, 2, 3, 10, 1000):
        assert sorted(m.permuted(np.arange(n), n, 3).tolist()) == list(range(n))
    assert m.permuted(np.arange(50), 50, 1).tolist() != m.permuted(np.arange(50), 50, 2).tolist()


def test_sizes_targets_and_taken(documents, edge):
    docs = documents.select("doc_id", "text", "source").unionByName(edge.select("doc_id", "text", "source"))
    got = m.mix_report(docs).collect()
    assert len(got) == docs.count()
    want = sorted(((r["doc_id"], len(re.findall(m.WORD, r["text"] or ""))) for r in docs.collect()), key=str)
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == want
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    by = defaultdict(lambda: [0, 0, 0])
    for r in got:
        by[r["source_size"], r["target"]][0] += r["taken"]
    for (size, target), (taken, *_) in by.items():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= m.BLOCK + 0.02 * target
    assert rows_of(m.mix_report(docs)) == sorted((tuple(r) for r in got), key=str)


def test_documents_hold_what_is_taken(documents, edge, none):
    docs = documents.unionByName(edge.select(documents.columns))
    report = defaultdict(int)
    for r in m.mix_report(docs).collect():
        report[r["doc_id"]] += r["taken"]
    mixed = m.mix_documents(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["doc_id"]] += len(re.findall(m.WORD, r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == {k: v for k, v in report.items() if v}
    assert m.mix_documents(edge).columns == edge.columns
    assert m.mix_report(none).count() == 0 and m.mix_documents(none).count() == 0


def test_cut_words():
    assert m.cut_words(" a b  c d ", [(0, 1), (1, 2)]) == "a b"
    assert m.cut_words(" a b  c d ", [(2, 4), (0, 2)]) == " a b  c d "
    assert m.cut_words("a b c", [(0, 1), (2, 3)]) == "a\nc"


def test_targets_recomputed_from_the_table(spark):
    """Sizes, capped shares and what each source gives, worked out from the rows alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    rows = docs.collect() + [(10**6, None, "a b c"), (10**6 + 1, "", "one"), (10**6 + 2, "é", None)]
    docs = spark.createDataFrame(rows, docs.schema)
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    source_of = {i: s for i, s, _ in rows}
    taken = defaultdict(int)
    for r in m.mix_report(docs).collect():
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        taken[s] += r["taken"]
    assert any(target[s] == 2 * sizes[s] for s in names) and any(target[s] < 2 * sizes[s] for s in names)
    assert all(abs(taken[s] - target[s]) <= m.BLOCK for s in names)
