"""Personal data by fixed forms, and by a linear-chain conditional random field over the shapes of words.

Fixed forms (mail address, internet address, card, phone with its country) are found by runs of bytes, as
their patterns say, in one pass without backtracking. The field learns from a small labelled table what they
leave out: numbers without a country, spelled-out addresses, account and insurance numbers. Its best labels
come from Viterbi in numpy batches. A word whose score for "none" exceeds every other by more than any two
moves can make up for is "none" on the best path, so paths are cut there and only the rest is decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import whole_text
from tickloom.llm.pii_examples import EXAMPLES
from tickloom.llm.textblocks import U64, WORDLIKE, RollingHash, blocks, mix

#: Kinds in the order of reports: fixed forms, then those that only the field finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: The fit sees at most so many labelled sentences, so many times, with this step size.
MAX_ROWS, PASSES, RATE = 5_000, 600, 0.4
#: Sentences that a feature must be in.
LEAST = 2
#: Shrinkage of feature weights and of moves. Small moves leave more words certain on their own.
SHRINK, MSHRINK = 0.002, 0.1
#: Words that are decoded side by side.
DECODED = 1 << 18

Spans = tuple[np.ndarray, np.ndarray]


def _is(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in chars])


DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGIT, LOCAL, DOMAIN = _is(DIGITS), _is(LETTERS + DIGITS + "._%+-"), _is(LETTERS + DIGITS + "-")
PHONE = _is(DIGITS + " ().-")
HOST = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Kinds of bytes in a shape: space, digit, small, capital, not ASCII, and every other byte as itself.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[_is(DIGITS)], CLASS[97:123], CLASS[65:91], CLASS[128:] = 48, 97, 65, 128
SPACE = _is(" \t\n\v\f\r")


@dataclass
class Page:
    """Texts of a block, each followed by a line end, so that no run of bytes passes from one to the next."""

    data: np.ndarray
    begins: np.ndarray
    chars: np.ndarray  # code points before each byte

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, at, side="right") - 1

    def points(self, at: np.ndarray) -> np.ndarray:
        """Code points from the text's begin."""
        return self.chars[at] - self.chars[self.begins[self.row(at)]]


def page(data: np.ndarray, ends: np.ndarray) -> Page:
    size = np.diff(np.r_[0, ends])
    out = np.full(len(data) + len(ends), 10, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(ends)), size)] = data
    begins = np.r_[0, ends[:-1]] + np.arange(len(ends))
    return Page(out, begins, np.r_[0, np.cumsum((out & 0xC0) != 0x80)])


def _runs(on: np.ndarray) -> Spans:
    edge = np.flatnonzero(np.diff(np.r_[False, on, False]))
    return edge[::2], edge[1::2]


def _chains(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Number of the chain of each run: runs follow each other with one byte of ``between``."""
    linked = (begins[1:] - ends[:-1] == 1) & between[data[ends[:-1]]] if len(begins) else np.empty(0, bool)
    return np.cumsum(np.r_[0, ~linked]) if len(begins) else np.empty(0, np.int64)


def emails(p: Page) -> Spans:
    at = np.flatnonzero(p.data == 64)
    if not len(at):
        return at, at
    out, host = np.r_[-1, np.flatnonzero(~LOCAL[p.data])], np.r_[np.flatnonzero(~(DOMAIN | _is("."))[p.data]), len(p.data)]
    lefts = out[np.searchsorted(out, at) - 1] + 1
    rights = host[np.searchsorted(host, at, side="right")]
    found, before = [], 0
    for a, left, right in zip(at.tolist(), lefts.tolist(), rights.tolist(), strict=True):
        left = max(left, before)
        m = HOST.match(p.data[a + 1 : right].tobytes()) if left < a else None
        if m:
            before = a + 1 + m.end()
            found.append((left, before))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def ips(p: Page) -> Spans:
    b, e = _runs(DIGIT[p.data])
    chain = _chains(p.data, b, e, _is("."))
    if not len(b):
        return b, e
    first = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
    place = np.arange(len(b)) - np.repeat(first, np.diff(np.r_[first, len(b)]))
    start = np.flatnonzero(place % 4 == 0)
    start = start[start + 3 < len(b)]
    start = start[chain[start + 3] == chain[start]]
    small = lambda k: len(t := p.data[b[k] : e[k]].tobytes().lstrip(b"0")) <= 3 and int(t or b"0") <= 255
    good = np.array([all(small(k + j) for j in range(4)) for k in start.tolist()], bool)
    start = start[good] if len(start) else start
    return b[start], e[start + 3]


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def cards(p: Page) -> Spans:
    b, e = _runs(DIGIT[p.data])
    if not len(b):
        return b, e
    chain = _chains(p.data, b, e, _is(" -"))
    count = np.bincount(chain, e - b)
    first = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
    last = np.r_[first[1:] - 1, len(b) - 1]
    on = np.flatnonzero((count >= 16) & (count <= 19))
    on = np.array([k for k in on.tolist() if luhn(re.sub("[ -]", "", p.data[b[first[k]] : e[last[k]]].tobytes().decode()))], np.int64)
    return b[first[on]], e[last[on]]


def phones(p: Page) -> Spans:
    plus = np.flatnonzero(p.data == 43)
    plus = plus[DIGIT[p.data[np.minimum(plus + 1, len(p.data) - 1)]]]
    if not len(plus):
        return plus, plus
    out, digit = np.flatnonzero(~PHONE[p.data]), np.flatnonzero(DIGIT[p.data])  # a page ends with a line end
    end = out[np.searchsorted(out, plus, side="right")]
    upto = np.searchsorted(digit, end)
    last, count = digit[upto - 1], upto - np.searchsorted(digit, plus)
    good = (last >= plus + 3) & (count >= 8) & (count <= 15)
    return plus[good], last[good] + 1


FORMS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


# --- the field -------------------------------------------------------------------


@dataclass
class Tokens:
    """Runs of letters and digits, or of other bytes that are no space: their bytes, rows and forms."""

    begins: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    spaced: np.ndarray  # white space before it, within its text
    form: np.ndarray
    features: list[np.ndarray]  # of each form: shape, looks, edges, word


def tokens(p: Page) -> Tokens:
    kind = np.where(SPACE, 0, np.where(WORDLIKE, 1, 2)).astype(np.int8)[p.data]
    cut = np.flatnonzero(np.diff(np.r_[0, kind, 0]))
    keep = kind[cut[:-1]] > 0 if len(cut) else np.empty(0, bool)
    b, e = cut[:-1][keep], cut[1:][keep]
    row = p.row(b)
    spaced = np.r_[False, (b[1:] > e[:-1]) & (row[1:] == row[:-1])] if len(b) else np.empty(0, bool)
    words = RollingHash(p.data, 11, True)
    shapes = RollingHash(CLASS[p.data], 12, False)
    # Case is part of a form, as shapes tell capitals.
    whole = words.of(b, e) ^ mix(shapes.of(b, e))
    _, first, form = np.unique(whole, return_index=True, return_inverse=True)
    fb, fe = b[first], e[first]
    size, shape = fe - fb, shapes.of(fb, fe)
    looks = np.zeros(len(fb), np.int64)
    for k, c in enumerate((48, 97, 65, 128)):
        seen = np.r_[0, np.cumsum(CLASS[p.data] == c)]
        looks += ((seen[fe] - seen[fb]) > 0) * (1 << k)
    bucket = np.searchsorted([2, 3, 4, 5, 7, 9, 13, 17, 20], size, side="right")
    edges = CLASS[p.data[fb]].astype(np.int64) * 256 + CLASS[p.data[fe - 1]]
    kinds = [
        np.where(size <= 8, shape, mix(looks.astype(U64) + U64(7))),
        mix((looks * 16 + bucket).astype(U64) + U64(1 << 20)),
        mix(edges.astype(U64) + U64(1 << 30)),
        words.of(fb, fe),
    ]
    return Tokens(b, e, row, spaced, form, kinds)


#: Neighbours (two and one before, itself, one after) and the features that are read of them.
SEEN = {-2: (0, 3), -1: (0, 1, 3), 0: (0, 1, 2, 3), 1: (0, 1, 3)}


def _salted(h: np.ndarray, place: int, k: int) -> np.ndarray:
    return mix(h + U64(1000 * (place + 3) + k + 1))


@dataclass
class Field:
    labels: list[str]  # "" for none, then first and further words of each kind
    known: np.ndarray  # hashes of features, ascending
    weights: np.ndarray  # feature, label; one more row of zeros
    spaces: np.ndarray  # space before and after: four cases, label
    moves: np.ndarray  # label, next label

    def scores(self, t: Tokens) -> np.ndarray:
        out = self.spaces[_gaps(t)].astype(np.float32)
        for place, which in SEEN.items():
            by_form = sum(self.weights[_numbers(self.known, _salted(t.features[k], place, k))] for k in which).astype(np.float32)
            on = _beside(t.row, place)
            out[on] += by_form[t.form[on + place]]
        return out

    def labelled(self, t: Tokens) -> np.ndarray:
        """The best label of each word."""
        score = self.scores(t)
        # What "none" in place of a label can cost in moves, at most: before it and after it.
        cost = (self.moves - self.moves[:, :1]).max(axis=0) + (self.moves - self.moves[:1]).max(axis=1)
        open_ = ~(score[:, :1] - score[:, 1:] > cost[1:] + 1e-3).all(axis=1)
        best = np.zeros(len(score), np.int64)
        new = np.flatnonzero(open_ & ~np.r_[False, open_[:-1] & (t.row[1:] == t.row[:-1])]) if len(score) else np.empty(0, np.int64)
        stop = np.flatnonzero(open_ & ~np.r_[open_[1:] & (t.row[1:] == t.row[:-1]), False]) + 1 if len(score) else new
        after = np.r_[t.row[1:] == t.row[:-1], False]
        before = np.r_[False, t.row[1:] == t.row[:-1]]
        order = np.argsort(new - stop, kind="stable")
        new, stop = new[order], stop[order]
        k = 0
        while k < len(new):
            n = max(1, DECODED // int(stop[k] - new[k]))
            self._viterbi(score, new[k : k + n], stop[k : k + n], before[new[k : k + n]], after[stop[k : k + n] - 1], best)
            k += n
        return best

    def _viterbi(self, score, new, stop, before, after, best) -> None:
        """Stretches of words, longest first; what borders on them in their text is "none"."""
        size, moves = stop - new, self.moves.astype(np.float32)
        top = int(size[0])
        now = score[new] + np.where(before[:, None], moves[0], 0)
        back = np.zeros((top, len(new), len(self.labels)), np.int8)
        live = [int(n) for n in len(size) - np.searchsorted(size[::-1], np.arange(top), side="right")]
        for i in range(1, top):
            n = live[i]
            through = now[:n, :, None] + moves
            back[i, :n] = through.argmax(axis=1)
            now[:n] = through.max(axis=1) + score[new[:n] + i]
        at = (now + np.where(after[:, None], moves[:, 0], 0)).argmax(axis=1)
        for i in range(top - 1, -1, -1):
            n = live[i]
            best[new[:n] + i] = at[:n]
            at[:n] = back[i, np.arange(n), at[:n]]


def _beside(row: np.ndarray, place: int) -> np.ndarray:
    """Words whose text has a word at this distance."""
    k = abs(place)
    if not k:
        return np.arange(len(row))
    same = np.flatnonzero(row[k:] == row[:-k]) if len(row) > k else np.empty(0, np.int64)
    return same + k if place < 0 else same


def _gaps(t: Tokens) -> np.ndarray:
    return t.spaced * 2 + np.r_[t.spaced[1:], False] if len(t.spaced) else np.empty(0, np.int64)


def _numbers(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash among the known ones; unknown ones get the last, whose weights are 0."""
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, len(known))


MARK = re.compile(r"<(\w+)\|([^>]*)>")


def _unmarked(text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The plain sentence, and kind, begin and end of what was marked, in bytes."""
    out, spans, last = b"", [], 0
    for m in MARK.finditer(text):
        out += text[last : m.start()].encode()
        spans.append((m[1], len(out), len(out) + len(m[2].encode())))
        out, last = out + m[2].encode(), m.end()
    return (out + text[last:].encode()).decode(), spans


def examples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in EXAMPLES.strip().splitlines()], "marked string")


def learn(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Field:
    """Fit the field on at most ``max_rows`` rows of column ``marked``, those with the smallest hashes."""
    rows = labelled.select("marked").where("marked IS NOT NULL").distinct().orderBy(F.xxhash64("marked"), "marked").limit(max_rows)
    return fit([r["marked"] for r in rows.collect()])


def fit(marked: list[str]) -> Field:
    """Maximum likelihood with shrinkage, by adaptive steps over all sentences at once (forward-backward)."""
    plain = [_unmarked(m) for m in marked]
    labels = ["", *(f"{b}{k}" for k in sorted({k for _, spans in plain for k, _, _ in spans}) for b in "+=")]
    block = next(blocks(pa.array([t for t, _ in plain], pa.string()), 1 << 40), None)
    if block is None:
        return Field(labels, np.zeros(1, U64), np.zeros((2, 1)), np.zeros((4, 1)), np.zeros((1, 1)))
    p = page(block.data, block.ends)
    t = tokens(p)
    truth = np.zeros(len(t.begins), np.int64)
    for i, (_, spans) in enumerate(plain):
        for kind, b, e in spans:
            own = np.flatnonzero((t.begins >= p.begins[i] + b) & (t.ends <= p.begins[i] + e))
            truth[own], truth[own[:1]] = labels.index("=" + kind), labels.index("+" + kind)
    owner, hashes = [], []
    for place, which in SEEN.items():
        on = _beside(t.row, place)
        for k in which:
            owner.append(on)
            hashes.append(_salted(t.features[k], place, k)[t.form[on + place]])
    owner, hashes = np.concatenate(owner), np.concatenate(hashes)
    # A feature of one sentence alone says more about that sentence than about a kind.
    pairs = np.unique(np.stack([hashes, t.row[owner].astype(U64)]), axis=1)[0]
    known, often = np.unique(pairs, return_counts=True)
    known = known[often >= LEAST]
    if not len(known):
        known = np.zeros(1, U64)
    number = _numbers(known, hashes)
    owner, number = owner[number < len(known)], number[number < len(known)]
    size, gaps = len(labels), _gaps(t)
    field = Field(labels, known, np.zeros((len(known) + 1, size)), np.zeros((4, size)), np.zeros((size, size)))
    parts = [field.weights, field.spaces, field.moves]
    sums = [np.full_like(x, 1e-6) for x in parts]
    count = np.bincount(t.row, minlength=len(plain))
    order = np.argsort(-count, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    place = np.arange(len(t.row)) - np.repeat(np.cumsum(count) - count, count)
    seq, count = rank[t.row], count[order]
    joined = np.flatnonzero(t.row[1:] == t.row[:-1])
    seen = np.zeros((size, size))
    np.add.at(seen, (truth[joined], truth[joined + 1]), 1)
    for _ in range(PASSES):
        score = np.stack([np.bincount(owner, field.weights[number, c], len(truth)) for c in range(size)], axis=1) + field.spaces[gaps]
        prob, moved = _expected(score, seq, place, count, field.moves)
        miss = -prob
        miss[np.arange(len(truth)), truth] += 1
        grads = [np.zeros_like(x) for x in parts]
        for c in range(size):
            grads[0][:, c] = np.bincount(number, miss[owner, c], len(known) + 1)
            grads[1][:, c] = np.bincount(gaps, miss[:, c], 4)
        grads[2] = seen - moved
        for x, g, s, shrink in zip(parts, grads, sums, (SHRINK, SHRINK, MSHRINK), strict=True):
            g -= shrink * x
            s += g**2
            x += RATE * g / np.sqrt(s)
    field.weights[-1] = 0
    return field


def _expected(score, seq, place, count, moves) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of words, and expected counts of moves; sequences are numbered longest first."""
    top, n, size, move = int(count[0]), len(count), score.shape[1], np.exp(moves)
    e = np.zeros((top, n, size))
    e[place, seq] = np.exp(score - score.max(axis=1, keepdims=True))
    live = [int((count > i).sum()) for i in range(top)]
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    now = e[0] / np.maximum(e[0].sum(axis=1, keepdims=True), 1e-300)
    alpha[0] = now
    for i in range(1, top):
        f = (now[: live[i]] @ move) * e[i, : live[i]]
        now = alpha[i, : live[i]] = f / f.sum(axis=1, keepdims=True)
    moved = np.zeros((size, size))
    for i in range(top - 2, -1, -1):
        m = live[i + 1]
        right = e[i + 1, :m] * beta[i + 1, :m]
        b = right @ move.T
        beta[i, :m] = b / b.max(axis=1, keepdims=True)
        joint = alpha[i, :m, :, None] * move[None] * right[:, None, :]
        moved += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    p = (alpha * beta)[place, seq]
    return p / p.sum(axis=1, keepdims=True), moved


# --- verdicts on what the field finds --------------------------------------------


def _iban(text: str) -> bool:
    s = re.sub(r"\s", "", text).upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def plausible(kind: str, text: str) -> bool:
    """What a span of its kind must have, whoever found it."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not re.search(r"[^0-9\x20()./-]", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and not re.search(r"[^0-9\x20._-]", text) and luhn(digits)
    if kind == "email":
        return bool(re.search(r"(?i)\bat\b|@", text) and re.search(r"(?i)\bdot\b|\.", text))
    if kind == "ssn":
        return bool(re.fullmatch(r"[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}", text))
    return kind != "iban" or _iban(text)


def spans_of(p: Page, field: Field) -> list[tuple[str, bool, np.ndarray, np.ndarray]]:
    """(kind, base, begins, ends) in bytes of the page; spans of the field keep clear of all others."""
    out = [(kind, True, *find(p)) for kind, find in FORMS.items()]
    t = tokens(p)
    label = field.labelled(t)
    named = np.flatnonzero(label)
    taken = sorted(zip(np.concatenate([x[2] for x in out]).tolist(), np.concatenate([x[3] for x in out]).tolist(), strict=True))
    starts, stops = np.array([a for a, _ in taken], np.int64), np.maximum.accumulate(np.array([0, *(b for _, b in taken)], np.int64))
    found: dict[str, list[tuple[int, int]]] = {}
    k = 0
    while k < len(named):
        i = j = int(named[k])
        kind = field.labels[label[i]][1:]
        more = field.labels.index("=" + kind)
        while j + 1 < len(label) and label[j + 1] == more and t.row[j + 1] == t.row[i]:
            j += 1
        k += j - i + 1
        b, e = int(t.begins[i]), int(t.ends[j])
        # Some base span that begins before e ends after b: they overlap.
        if stops[np.searchsorted(starts, e)] > b or not plausible(kind, p.data[b:e].tobytes().decode()):
            continue
        found.setdefault(kind, []).append((b, e))
    for kind, pairs in found.items():
        both = np.array(pairs, np.int64)
        out.append((kind, False, both[:, 0], both[:, 1]))
    return out


def find_spans(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and spans, an array of (kind, start, stop, base) by kind and start, in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(field)  # as large as the labelled table
    kind_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch["text"]):
                p = page(b.data, b.ends)
                rows: list[list[dict]] = [[] for _ in b.ends]
                every = spans_of(p, sent.value)
                for kind, base, begins, ends in sorted(every, key=lambda x: KINDS.index(x[0]) if x[0] in KINDS else len(KINDS)):
                    spots = zip(p.row(begins).tolist(), p.points(begins).tolist(), p.points(ends).tolist(), strict=True)
                    for r, lo, hi in spots:
                        rows[r].append({"kind": kind, "start": lo, "stop": hi, "base": base})
                rank = {k: i for i, k in enumerate(KINDS)}
                for own in rows:
                    own.sort(key=lambda s: (rank.get(s["kind"], len(rank)), s["kind"], s["start"]))
                ids = batch["doc_id"].slice(b.first, len(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(kind_type))], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,stop:long,base:boolean>>")


def pii_report(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (fixed forms), base_sha256, spans, and n_found (the field's).

    A null or empty text has no spans. Repeated rows and null ids stay as they are; an empty table gives no
    rows. Columns other than doc_id and text are not read.
    """
    field = learn(examples(docs.sparkSession) if labelled is None else labelled)
    out = find_spans(docs, field)
    is_base = lambda s: s["base"]
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.filter("spans", is_base)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_found"),
    )

