import random
import re
from hashlib import sha256

from tests.llm.conftest import rows_of, texts_of
from tickloom.llm import suffix_dedup as s


def brute(texts, length=s.LENGTH):
    seen = {}
    raw = [(i, t.encode()) for i, t in texts]
    for _, b in raw:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), spans, sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_given_and_edges(documents, edge, none):
    docs = documents.select("doc_id", "text").unionByName(edge.select("doc_id", "text").where("length(text) < 1000 OR text IS NULL"))
    assert rows_of(s.digests(s.drop_repeats(docs))) == brute(texts_of(docs))
    assert s.drop_repeats(none).count() == 0


def test_planted(spark):
    """Passages of all lengths around the limit, cut in one another, periodic texts and few letters."""
    rng = random.Random(5)
    word = lambda n, a="abcdefgh é": "".join(rng.choice(a) for _ in range(n))
    passage = word(1500)
    texts = ["a" * 900, "ab" * 500, "ab" * 200, "ba" * 201, "abc" * 134, word(2000, "ab") * 2, passage]
    for _ in range(40):
        lo = rng.randrange(1000)
        texts.append(word(rng.randrange(300)) + passage[lo : lo + rng.randrange(250, 600)] + word(rng.randrange(300)))
    cut = list(passage)
    for k in range(0, 1500, 450):
        cut[k] = "#"
    texts.append("".join(cut))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(s.digests(s.drop_repeats(docs))) == brute(texts_of(docs))


def test_long_text(spark, edge):
    docs = edge.select("doc_id", "text").where("doc_id = 5 OR doc_id = 6")
    got = {r["doc_id"]: r for r in s.digests(s.drop_repeats(docs)).collect()}
    # The text repeats itself, so the blank before the last word is in a repeated string too.
    assert got[5]["n_removed"] == got[5]["n_bytes"] and got[6]["n_removed"] == got[5]["n_bytes"] + 1 and got[6]["n_spans"] == 1


def shared(texts, length=s.WORDS):
    """Words of each text in passages that another row has too."""
    rows = [(i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts]
    seen = {}
    for n, (_, w) in enumerate(rows):
        for k in range(len(w) - length + 1):
            seen.setdefault(tuple(w[k : k + length]), set()).add(n)
    out = []
    for i, w in rows:
        on = set()
        for k in range(len(w) - length + 1):
            if len(seen[tuple(w[k : k + length])]) > 1:
                on.update(range(k, k + length))
        out.append((i, len(on)))
    return sorted(out, key=str)


def shared_of(docs):
    return rows_of(s.drop_repeats(docs).select("doc_id", s.shared_words()))


def test_short_passages(spark):
    """Passages of over 50 words that have under 400 bytes are told by the query, though none of their bytes goes."""
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(100)) for _ in range(n))
    passage, other = words(55), words(50)
    texts = [f"{words(k)} {p} {words(9)}" for k, p in enumerate([passage] * 3 + [other] * 3 + [words(60)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = s.digests(s.drop_repeats(docs), s.shared_words()).collect()
    assert len(passage.encode()) < s.LENGTH and all(r["n_removed"] == 0 for r in got)
    assert {r["doc_id"]: r["n_shared_words"] for r in got} == {k: 55 * (k < 3) for k in range(7)}


def test_shared_words(spark, documents, edge):
    rng = random.Random(11)
    words = lambda n, a: " ".join(rng.choice(a) for _ in range(n))
    many = [f"w{k}" for k in range(500)]
    passage = words(400, many).split()
    texts = [words(400, "ab"), words(120, "a"), "a " * 60 + "b", words(40, many) + " x" * 150]
    texts += [words(70, many) + " " + " ".join(passage[100:170]) + " " + " ".join(passage[100:170])]
    for _ in range(60):
        lo = rng.randrange(330)
        texts.append(f"{words(rng.randrange(60), many)}\t{' '.join(passage[lo : lo + rng.randrange(40, 70)])}\n{words(rng.randrange(60), 'ab')}")
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[4]), (3, texts[4])], "doc_id long, text string")
    assert shared_of(docs) == shared(texts_of(docs))
    docs = documents.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    assert shared_of(docs) == shared(texts_of(docs))
