import numpy as np

from tests.llm.conftest import texts_of
from tickloom.llm import language_id as li


def test_marginals_equal_summing_over_all_paths():
    rng = np.random.default_rng(0)
    field = li.Crf(["x", "y"], np.zeros((li.BUCKETS, 2)), rng.normal(size=(2, 2)))
    scores, row = rng.normal(size=(9, 2)), np.array([0, 0, 0, 0, 1, 3, 3, 3, 3])
    old, li.CHUNK = li.CHUNK, 2
    try:
        got = field.marginals(scores, row, 4)
    finally:
        li.CHUNK = old
    for r in (0, 1, 3):
        at = np.flatnonzero(row == r)
        want = np.zeros((len(at), 2))
        for path in np.ndindex(*[2] * len(at)):
            before = np.logaddexp.reduce([field.moves[k, path[0]] for k in range(2)])
            w = np.exp(before + sum(scores[i, y] for i, y in zip(at, path, strict=True)) + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            for t, y in enumerate(path):
                want[t, y] += w
        assert np.allclose(got[at], want / want.sum(axis=1, keepdims=True))


def test_held_out_accuracy(documents):
    got = {r["doc_id"]: r for r in li.languages(documents).collect()}
    held = [r for r in documents.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.95


def test_switched_words():
    en, fr = "the cat is on the mat and of that with ".split(), "le chat est sur la table et dans une avec ".split()
    field = li.fit([" ".join(en * 20), " ".join(fr * 20)], ["en", "fr"], ["en", "fr"])
    import pyarrow as pa

    from tickloom.llm.textblocks import blocks

    w = li.featured(next(blocks(pa.array([" ".join(en + fr)]))))
    p = field.marginals(field.emissions(w)[w.form], w.row, 1)
    assert p.argmax(axis=1).tolist() == [0] * len(en) + [1] * len(fr)


def test_edges(edge, none):
    got = li.languages(edge).collect()
    assert len(got) == len(texts_of(edge))
    for r in got:
        if r["doc_id"] in (3, 4, 8, 9):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert 0 <= r["score"] <= 1
    assert li.languages(none).count() == 0
    assert {r["lang_pred"] for r in li.languages(edge.withColumn("lang", edge["text"].substr(1, 0).substr(5, 1)).where("doc_id = 99")).collect()} <= {"und"}
