"""Each stage on its own input, and all of them together."""

import corpus_pipeline as c

from tests.llm.conftest import texts_of
from tests.llm.test_bpe import CODEC
from tickloom.llm import near_dedup, toxicity
from tickloom.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents, labels):
    docs, columns = documents, documents.columns
    before = {i: t for i, t in texts_of(docs)}
    for name, stage in c.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), name)
        assert out.columns == columns
        was, now = dict(texts_of(docs)), texts_of(out)
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
            assert bad and {i for i, _ in now} == set(was) - bad
        elif name == "exact_dedup":
            best = {}
            for i, t in was.items():
                best[t] = max(i, best.get(t, -1))
            assert dict(now) == {i: t for t, i in best.items()}
        elif name == "near_dedup":
            assert sorted(i for i, _ in now) == sorted(r["doc_id"] for r in near_dedup.near_copies(docs).where("kept").collect())
        else:
            assert {i for i, _ in now} <= set(was) and all(before[i] == t or set(t.split()) <= set(before[i].split()) for i, t in now)
        docs = out
    got = sorted((r["doc_id"], r["ids"]) for r in c.STAGES[-1][1](spark, docs, SF).collect())
    assert got == sorted((i, CODEC.leaf.encode_ordinary(t)) for i, t in texts_of(docs))
    run = c.run(spark, SF)
    assert sorted((r["doc_id"], r["ids"]) for r in run.collect()) == got


def test_stages_take_edges(spark, edge, none):
    for docs in (edge, none):
        for _, stage in c.STAGES[:-1]:
            docs = stored(stage(spark, docs, SF), "edge")
        assert c.STAGES[-1][1](spark, docs, SF).count() == docs.count()
