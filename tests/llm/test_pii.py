import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import rows_of, texts_of
from tickloom.llm import pii
from tickloom.llm.textblocks import blocks

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        total = sum(int(d) if k % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for k, d in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m.group())]


@pytest.fixture(scope="module")
def field():
    return pii.fit(pii.EXAMPLES.strip().splitlines())


def spans(texts, field):
    out = [[] for _ in texts]
    for b in blocks(pa.array(texts, pa.string())):
        p = pii.page(b.data, b.ends)
        for kind, base, begins, ends in pii.spans_of(p, field):
            for r, lo, hi in zip(p.row(begins), p.points(begins), p.points(ends)):
                out[b.first + r].append((kind, base, int(lo), int(hi)))
    return out


def check(rows, texts):
    """Columns of the report against the patterns; rows with the same id are told apart by nothing else here."""
    want = []
    for i, t in texts:
        base = brute(t)
        n = [sum(k == x for k, _, _ in base) for x in PATTERNS]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((i, *n, hashlib.sha256(listed.encode()).hexdigest()))
    assert sorted([tuple(r)[:6] for r in rows], key=str) == sorted(want, key=str)
    for r in rows:
        kinds = [s.split(":") for s in r[6].split(",") if s]
        assert kinds == sorted(kinds, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))
        assert len(kinds) == sum(r[1:5]) + r[7]


def test_given_and_edges(documents, edge, none):
    docs = documents.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    check(rows_of(pii.pii_report(docs)), texts_of(docs))
    check(rows_of(pii.pii_report(edge)), texts_of(edge))
    assert pii.pii_report(none).count() == 0


def test_fixed_forms_on_odd_texts(field):
    rng = random.Random(4)
    texts = ["".join(rng.choice("0123456789..  --+()@a%é\n") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", "@", "+", "+1", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "a@b@c.d", "x" * 3000 + "@y.z", "+1 23 45678" * 3, "000255.1.1.256 00255.1.1.1"]
    texts += ["4111 1111-1111 1111", "41111111 11111111 ", "9" * 4000, "1." * 2000 + "1", "@" * 500 + "a@b.cd"]
    for t, got in zip(texts, spans(texts, field), strict=True):
        assert sorted((k, a, b) for k, base, a, b in got if base) == sorted(brute(t)), t


def test_best_path_equals_plain_viterbi(field):
    """The cut at certain words changes nothing: labels score as the best path over all words does."""
    rng = random.Random(8)
    lines = [pii._unmarked(m)[0] for m in pii.EXAMPLES.strip().splitlines()]
    texts = [" ".join(rng.choice(lines) for _ in range(rng.randrange(1, 12))) for _ in range(60)] + [""]
    b = next(blocks(pa.array(texts)))
    t = pii.tokens(pii.page(b.data, b.ends))
    got, score = field.labelled(t), field.scores(t).astype(float)
    value = lambda own, y: score[own, y].sum() + field.moves[y[:-1], y[1:]].sum()
    for r in range(len(texts)):
        own = np.flatnonzero(t.row == r)
        if not len(own):
            continue
        now, back = score[own[0]], []
        for i in own[1:]:
            through = now[:, None] + field.moves
            back.append(through.argmax(axis=0))
            now = through.max(axis=0) + score[i]
        path = [int(now.argmax())]
        for step in back[::-1]:
            path.append(int(step[path[-1]]))
        want = np.array(path[::-1])
        assert value(own, got[own]) == pytest.approx(value(own, want), abs=1e-3)


def test_field_finds_what_forms_leave_out(field):
    """Sentences that are not in the table, and sentences with nothing in them."""
    texts = [
        "our clerk answers at (408) 555-0166 on weekdays",
        "my phone is 555-013-8821 if needed",
        "please email peter at mail dot example dot net about it",
        "the card 5105.1051.0510.5100 was refused",
        "iban NL91 ABNA 0417 1643 00 is mine",
        "her ssn 321-54-9876 leaked",
    ]
    kinds = [{k for k, base, _, _ in got if not base} for got in spans(texts, field)]
    assert kinds == [{"phone"}, {"phone"}, {"email"}, {"card"}, {"iban"}, {"ssn"}]
    clean = ["On 12 May 2021 the fee rose to 1,250 euros.", "She looked at the dot.", "version 3.11.4 of 2023-10-02", "key 4f3c2a1b9d8e7f60"]
    assert spans(clean, field) == [[]] * 4


def test_no_labelled_rows(spark, edge):
    none = spark.createDataFrame([], "marked string")
    assert {r["n_found"] for r in pii.pii_report(edge, none).collect()} == {0}
