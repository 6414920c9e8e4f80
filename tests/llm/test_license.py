import re

from tests.llm.conftest import texts_of
from tickloom.llm import license_scan as ls

TEXTS = [
    "Released under the MIT License. MIT license; mit-license", "GNU General Public License, apache license", "cc by cc by", "mit", "", None,
    "Permission is hereby granted free of charge to a person obtaining any copy of this software and the associated documentation files the software to deal in software without restriction",
    "the general public license gnu general", "x " * 500 + "Apache (License)", "éMIT license", "mit licenseé", "cc  by\x80", "All rights reserved",
]


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = []
    for phrase, label in ls.PHRASES.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def check(docs):
    want = sorted(((i, *brute(t)) for i, t in texts_of(docs)), key=str)
    got = ls.scan(docs).collect()
    assert sorted(((r["doc_id"], *(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))) for r in got), key=str) == want
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    return {r["doc_id"]: r for r in got}


def test_base_equals_brute_force(spark, documents, edge, none):
    got = check(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    assert "mit-release" in got[0]["labels"] and got[6]["labels"] == "mit-text" and 0.6 <= got[6]["score"] < 1
    assert got[12]["labels"] == "reserved" and got[7]["score"] == 0
    check(documents)
    check(edge)
    assert ls.scan(none).count() == 0


def test_notices_repeated_back_to_back(spark):
    texts = ["all rights reserved " * n for n in (1, 3, 4, 50)] + ["released under the mit license" + " mit license" * 5, "all rights " + "x " * 9 + "rights reserved"]
    got = {r["doc_id"]: r for r in ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[k]["labels"], got[k]["score"]) for k in range(4)] == [("reserved", 1.0)] * 4
    assert "mit-release" in got[4]["labels"].split(",")
    assert (got[5]["labels"], got[5]["score"]) == ("", 0.0)
