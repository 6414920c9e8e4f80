import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of
from tickloom.llm import prefix_trie

DATA = "/root/testdata/sf0.001/conversations.parquet"
SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        own[c].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    for turns in own.values():
        turns.sort()
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(("" if c is None else str(c)).encode()) % 4
        # The remainder has the sign of the number.
        first = own.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), []) if c is not None else []
        built[c] = [t[3:] for t in first[:h] + turns[h:]]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(int)
    for p in members:
        kids[p[:-1]] += bool(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, of in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(of) - 1) * words
    low = lambda cs: min((c for c in cs if c is not None), default=None)
    out = []
    for p, of in members.items():
        numbers = ",".join("" if c is None else str(c) for c in sorted(ends[p], key=lambda c: (c is not None, c or 0)))
        up = low(members[p[:-1]]) if p else None
        out.append((low(of), len(p), up, len(of), kids[p], leaves[p], saved[p], sha(numbers)))
    return sorted(out, key=str)


def check(spark, rows):
    got = rows_of(prefix_trie.trie_report(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows)
    return got


def test_given(spark):
    df = spark.read.parquet(DATA)
    assert rows_of(prefix_trie.trie_report(df)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_edges(spark):
    rows = [
        (0, 1, "user", "one two"), (0, 2, "bot", "three"), (0, 2, "bot", "three"), (0, None, None, None),
        (1, 5, "user", "a b c"), (1, 5, "bot", "tie"), (1, 7, None, "x"), (1, 9, "user", ""),
        (2, 0, "user", "alone"), (3, 0, "u", "q"), (None, 0, "user", "no number"), (None, None, None, None),
        (45, 0, "user", "no base"), (46, 0, "user", "no base"), (47, 0, "user", "no base"), (48, 0, "user", "no base"),
        (-7, 0, "user", "below"), (-7, 1, "user", "zero"), (-7, 2, "user", "by"), (-7, 3, "user", "seven"), (-7, 4, "user", "five"),
        (61, 0, "a", "b"), (61, 1, "ab", ""), (62, 0, "a", "b c " * 40000), (2**40, 3, "user", "far"),
    ]
    got = check(spark, rows)
    assert any(r[1] == 0 and r[7] != sha("") for r in got)  # some conversation has no turn left
    assert prefix_trie.trie_report(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("conv", "depth", "name", "pos", "chunk", "h", "m", "n", "symbol", "words", "_range")])
    assert rows_of(prefix_trie.trie_report(clash)) == got


@pytest.mark.parametrize("longest", [9, 150])
def test_shared_beginnings_of_any_depth(spark, longest):
    """Branches at every depth, around stretches and chunks, equal conversations, and ends inside others."""
    rng, seqs = random.Random(longest), [[]]
    for c in range(160):
        base = rng.choice(seqs[-8:])
        cut = rng.randrange(len(base) + 1) if c % 3 else len(base)
        room = longest - cut
        more = [(rng.choice("ub"), "w " * rng.randrange(4) + rng.choice("xyz")) for _ in range(rng.randrange(room + 1))] if c % 4 else []
        seqs.append(base[:cut] + more)
    rows = [(c, t, *turn) for c, seq in enumerate(seqs) for t, turn in enumerate(seq)]
    got = check(spark, rows)
    assert max(r[1] for r in got) > longest * 0.8


def test_long_sequences_go_through_three_levels_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rng = random.Random(1)
    stem = [("u", f"t{k}") for k in range(90)]
    rows = []
    for c in range(30):
        seq = stem[: rng.choice([3, 4, 5, 15, 16, 17, 63, 64, 65, 80, 90])] + [("b", rng.choice("pq"))] * rng.randrange(3)
        rows += [(c, t, *turn) for t, turn in enumerate(seq)]
    check(spark, rows)


def test_lists_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LISTED", 8)
    check(spark, [(c, 0, "user", "the same") for c in range(300)] + [(c, 1, "bot", "more") for c in range(0, 300, 7)])
