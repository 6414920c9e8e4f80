"""Language of each word, and from it of each text, by a linear-chain conditional random field.

Words are seen by hashed features: the whole word (the lexicon), beginnings and endings, and three-byte
grams inside. Labels follow each other by learned transitions. Training texts are cut in stretches that
are shuffled across languages, so the chain learns how code-switched text changes. Forward-backward
gives each word's label probabilities; a text's language is the one with most of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import id_fold, whole_text
from tickloom.llm.textblocks import U64, WORDLIKE, Block, blocks, mix, words

#: The fit sees at most so many rows, those whose hashed ids are smallest, in so many parts whose weights are averaged.
MAX_ROWS, PARTS = 2_000, 4
#: Weights of features, for each label.
BUCKETS = 1 << 16
AFFIX, GRAM = 3, 3
#: Words of a training stretch, stretches of a sequence, sequences of a step, passes, step size.
STRETCH, JOINED, BATCH, PASSES, RATE = 40, 3, 64, 3, 0.5
#: Words that a long chain is cut into; the parts are linked by products of their transitions, exactly.
CHUNK = 128
#: Bytes of text whose chains run side by side.
CHAINED = 2 << 20
UNKNOWN = "und"

LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


@dataclass
class Words:
    """Words of a block: their row, the number of their form, and per form its features (``owner`` has the form)."""

    row: np.ndarray
    form: np.ndarray
    n_forms: int
    owner: np.ndarray
    feature: np.ndarray
    lettered: np.ndarray


def featured(block: Block) -> Words:
    begins, ends, row = words(block, WORDLIKE)
    rolling = block.hashes(5, fold=True)
    whole, first, form = np.unique(rolling.of(begins, ends), return_index=True, return_inverse=True)
    b, e = begins[first], ends[first]
    length, every = e - b, np.arange(len(b))
    owners, hashes = [every], [mix(whole)]
    for k in range(1, AFFIX + 1):
        on = np.flatnonzero(length >= k)
        owners += [on, on]
        hashes += [mix(rolling.of(b[on], b[on] + k) + U64(2 * k)), mix(rolling.of(e[on] - k, e[on]) + U64(2 * k + 1))]
    count = np.maximum(length - GRAM + 1, 0)
    owner = np.repeat(every, count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + b[owner]
    owners.append(owner)
    hashes.append(mix(rolling.of(at, at + GRAM) + U64(99)))
    letters = np.r_[0, np.cumsum(LETTER[block.data])]
    feature = (np.concatenate(hashes) & U64(BUCKETS - 1)).astype(np.int64)
    return Words(row, form, len(b), np.concatenate(owners), feature, letters[ends] > letters[begins])


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # feature, label
    moves: np.ndarray  # label, next label

    def emissions(self, w: Words) -> np.ndarray:
        """form, label"""
        parts = [np.bincount(w.owner, self.weights[w.feature, k], w.n_forms) for k in range(len(self.labels))]
        return np.stack(parts, axis=1) if w.n_forms else np.zeros((0, len(self.labels)))

    def marginals(self, scores: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Probability of each label for each word; ``row`` is in order."""
        size = len(self.labels)
        count = np.bincount(row, minlength=n)
        chunks = -(-count // CHUNK)
        base = np.cumsum(chunks) - chunks
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        chunk, step = np.repeat(base, count) + place // CHUNK, place % CHUNK
        total = int(chunks.sum())
        e = np.zeros((CHUNK, total, size))
        e[step, chunk] = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(row) else 0
        used = np.bincount(chunk, minlength=total)
        move = np.exp(self.moves)
        through = np.repeat(np.eye(size)[None], total, axis=0)
        for t in range(CHUNK):
            on = np.flatnonzero(used > t)
            if not len(on):
                break
            m = (through[on] @ move) * e[t, on][:, None, :]
            through[on] = m / m.max(axis=(1, 2), keepdims=True)
        forward, backward = np.full((total, size), 1 / size), np.ones((total, size))
        for j in range(1, int(chunks.max(initial=0))):
            on = base[chunks > j] + j
            f = (forward[on - 1][:, None, :] @ through[on - 1])[:, 0]
            forward[on] = f / f.sum(axis=1, keepdims=True)
        for j in range(int(chunks.max(initial=0)) - 2, -1, -1):
            on = base[chunks > j + 1] + j
            b = (through[on + 1] @ backward[on + 1][:, :, None])[:, :, 0]
            backward[on] = b / b.max(axis=1, keepdims=True)
        alpha = np.zeros_like(e)
        now = forward
        for t in range(CHUNK):
            on = np.flatnonzero(used > t)
            if not len(on):
                break
            f = (now[on] @ move) * e[t, on]
            f /= f.sum(axis=1, keepdims=True)
            alpha[t, on] = f
            now = now.copy() if t == 0 else now
            now[on] = f
        for t in range(CHUNK - 1, -1, -1):
            on = np.flatnonzero(used > t)
            if not len(on):
                continue
            p = alpha[t, on] * backward[on]
            b = (e[t, on] * backward[on]) @ move.T
            backward[on] = b / b.max(axis=1, keepdims=True)
            alpha[t, on] = p / p.sum(axis=1, keepdims=True)
        return alpha[step, chunk]


def _sequences(langs: np.ndarray, row: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and labels of training sequences: stretches of all texts, shuffled and joined."""
    stretches = []
    for r in np.unique(row):
        own = np.arange(np.searchsorted(row, r), np.searchsorted(row, r, side="right"))
        stretches += [(own[k : k + STRETCH], langs[r]) for k in range(0, len(own), STRETCH)]
    order = rng.permutation(len(stretches))
    out = []
    for k in range(0, len(order), JOINED):
        part = [stretches[i] for i in order[k : k + JOINED]]
        out.append((np.concatenate([a for a, _ in part]), np.concatenate([np.full(len(a), y) for a, y in part])))
    return out


def fit(texts: list[str], langs: list[str], labels: list[str], seed: int = 1) -> Crf:
    """Maximum likelihood by adaptive steps over padded batches of sequences."""
    block = next(blocks(pa.array(texts, pa.string()), 1 << 40))
    w, size = featured(block), len(labels)
    rng = np.random.default_rng(seed)
    number = np.array([labels.index(x) for x in langs])
    model = Crf(labels, np.zeros((BUCKETS, size)), np.zeros((size, size)))
    order = np.argsort(w.owner, kind="stable")
    feature, begin = w.feature[order], np.searchsorted(w.owner[order], np.arange(w.n_forms + 1))
    sums_w, sums_m = np.full_like(model.weights, 1e-6), np.full_like(model.moves, 1e-6)
    for _ in range(PASSES):
        seqs = _sequences(number, w.row, rng)
        for k in range(0, len(seqs), BATCH):
            part = sorted(seqs[k : k + BATCH], key=lambda s: -len(s[0]))
            at = np.concatenate([s[0] for s in part])
            truth = np.concatenate([s[1] for s in part])
            row = np.repeat(np.arange(len(part)), [len(s[0]) for s in part])
            forms, inverse = np.unique(w.form[at], return_inverse=True)
            count = begin[forms + 1] - begin[forms]
            owner = np.repeat(np.arange(len(forms)), count)
            own = feature[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[forms], count)]
            scores = np.stack([np.bincount(owner, model.weights[own, c], len(forms)) for c in range(size)], axis=1)[inverse]
            p, move = _expected(scores, row, model.moves)
            miss = -p
            miss[np.arange(len(at)), truth] += 1
            by_form = np.stack([np.bincount(inverse, miss[:, c], len(forms)) for c in range(size)], axis=1)
            grad = np.stack([np.bincount(own, by_form[owner, c], BUCKETS) for c in range(size)], axis=1) / len(part)
            next_ = np.flatnonzero(row[1:] == row[:-1])
            seen = np.zeros((size, size))
            np.add.at(seen, (truth[next_], truth[next_ + 1]), 1)
            grad_m = (seen - move) / len(part)
            sums_w += grad**2
            sums_m += grad_m**2
            model.weights += RATE * grad / np.sqrt(sums_w)
            model.moves += RATE * grad_m / np.sqrt(sums_m)
    return model


def _expected(scores: np.ndarray, row: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of the words of sequences (longest first), and expected counts of moves."""
    size, count = scores.shape[1], np.bincount(row)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    top, move = int(count.max()), np.exp(moves)
    e = np.zeros((top, len(count), size))
    e[place, row] = np.exp(scores - scores.max(axis=1, keepdims=True))
    live = [int((count > t).sum()) for t in range(top)]
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    now = np.full((len(count), size), 1 / size)
    for t in range(top):
        f = (now[: live[t]] @ move) * e[t, : live[t]]
        now = alpha[t, : live[t]] = f / f.sum(axis=1, keepdims=True)
    moved = np.zeros((size, size))
    for t in range(top - 2, -1, -1):
        n = live[t + 1]
        right = e[t + 1, :n] * beta[t + 1, :n]
        b = right @ move.T
        beta[t, :n] = b / b.max(axis=1, keepdims=True)
        joint = alpha[t, :n, :, None] * move[None] * right[:, None, :]
        moved += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    p = alpha * beta
    p = p[place, row]
    return p / p.sum(axis=1, keepdims=True), moved


def learn(docs: DataFrame, max_rows: int = MAX_ROWS, parts: int = PARTS) -> Crf | None:
    """The field of the rows that are not held out (fold 2 of 4); None if none of them has an id, a language and text."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (id_fold(4) != 2) & (F.length(whole_text()) > 0))
    # Ids are drawn before texts are read; no more than max_rows of them.
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    known = known.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "lang")
    known = known.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(parts)).cast("int")).cache()
    labels = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not labels:
        return None

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        m = fit(pdf["text"].tolist(), pdf["lang"].tolist(), labels)
        return pd.DataFrame({"weights": [m.weights.tobytes()], "moves": [m.moves.tobytes()]})

    # As many rows as parts, each of fixed length.
    got = known.groupBy("part").applyInPandas(one, "weights binary, moves binary").collect()
    known.unpersist()
    shape = (BUCKETS, len(labels)), (len(labels), len(labels))
    w, m = ([np.frombuffer(r[c]).reshape(s) for r in got] for c, s in zip(("weights", "moves"), shape, strict=True))
    order = np.argsort([float(np.abs(x).sum()) for x in w])  # sums do not depend on who came first
    return Crf(labels, sum(w[i] for i in order) / len(w), sum(m[i] for i in order) / len(m))


def languages(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (the mean probability of that language over the words).

    Null texts and texts without a letter are ``und`` with score 0. Language, source and id of a row are
    no inputs of its prediction. Repeated rows and null ids stay as they are (a null id counts as empty
    text in the fold). Without any labelled row all are ``und``. Columns other than doc_id, text and lang
    are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    model = learn(rows, max_rows)
    sent = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch["text"], CHAINED):
                n = len(b.ends)
                lang, score = [UNKNOWN] * n, np.zeros(n)
                if sent.value is not None:
                    field, w = sent.value, featured(b)
                    p = field.marginals(field.emissions(w)[w.form], w.row, n)
                    by = np.stack([np.bincount(w.row[w.lettered], p[w.lettered, k], n) for k in range(p.shape[1])], axis=1)
                    best, total = by.argmax(axis=1), by.sum(axis=1)
                    for i, t in enumerate(batch["text"].slice(b.first, n)):
                        if any(map(str.isalpha, t.as_py() or "")):
                            lang[i], score[i] = field.labels[best[i]], min(1.0, by[i, best[i]] / max(total[i], 1e-12))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(b.first, n), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"]
                )

    out = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (id_fold(4) == 2).alias("held_out"), "lang_pred", "score")
