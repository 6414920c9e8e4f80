"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

A lexicon of words and word beginnings is learned from labelled rows; trees see how densely a text holds
it, how near to a second person, and how the text is written (capitals, punctuation, masked letters).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import id_fold, stored, whole_text

#: The fit sees at most so many labelled rows, those whose hashed ids are smallest.
MAX_ROWS = 20_000
#: A term is in the lexicon if at least so many toxic rows hold it, and for so many times their share of rows.
MIN_ROWS, MIN_ODDS = 4, 8.0
TREES, DEPTH = 20, 3
#: Rows whose hashed id modulo 4 is 0 calibrate; the others grow the trees.
CALIBRATE = 4
THRESHOLD = 0.7

#: Plain insults in English, and words for the second person.
SEED = frozenset("idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool jerk garbage".split())
SECOND = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes vos".split())
#: Signs that stand for letters.
MASKED = str.maketrans("013457@$", "oieastas")

WORD = re.compile(r"[@$]?[^\W_]+(?:[@$][^\W_]+)*")
FEATURES = (
    "hits", "density", "weight", "most", "near", "seed", "capitals", "shouted", "marks", "punctuation", "masked", "length",
)


def terms_of(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings; a star ends a beginning."""
    return (word, *(f"{word[:n]}*" for n in (3, 4, 5) if len(word) > n))


def odds(toxic: float, clean: float, n_toxic: float, n_clean: float) -> float:
    return ((toxic + 0.1) / (n_toxic + 1)) / ((clean + 0.5) / (n_clean + 1))


class Lexicon:
    """Counts of labelled rows by term. Asked for a labelled row, it leaves that row out of its counts."""

    def __init__(self, counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int):
        self.counts, self.n = counts, (n_toxic, n_clean)
        self.memo: dict[tuple[str, int | None], float] = {}

    def weight(self, word: str, label: int | None) -> float:
        """Largest log odds of the word's terms, 0 if none is in the lexicon."""
        key = (word, label)
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            got = self.memo[key] = self._weight(word, label)
        return got

    def _weight(self, word: str, label: int | None) -> float:
        best = 0.0
        for term in terms_of(word):
            if term not in self.counts:
                continue
            toxic, clean = self.counts[term]
            toxic, clean = toxic - (label == 1), clean - (label == 0)
            ratio = odds(toxic, max(clean, 0), *self.n)
            if toxic >= MIN_ROWS - 1 and ratio >= MIN_ODDS:
                best = max(best, math.log(ratio))
        return best


def measure(text: str, lexicon: Lexicon, label: int | None = None) -> tuple[float, ...]:
    plain = text.lower()
    words = WORD.findall(plain)
    n = max(len(words), 1)
    at, weights, second, masked, seed = [], [], [], 0, 0
    for i, w in enumerate(words):
        weight = lexicon.weight(w, label)
        if weight == 0.0 and not w.isalpha() and not w.isdigit():
            open_ = w.translate(MASKED)
            weight = lexicon.weight(open_, label)
            masked += weight > 0 or open_ in SEED
            seed += open_ in SEED
        if weight > 0:
            at.append(i)
            weights.append(weight)
        if w in SECOND:
            second.append(i)
        seed += w in SEED
    near = 0.0
    if at and second:
        s = np.array(second)
        k = np.clip(np.searchsorted(s, at), 1, len(s) - 1) if len(s) > 1 else np.zeros(len(at), int)
        gaps = np.minimum(np.abs(s[k] - at), np.abs(s[k - 1] - at))
        near = float((1 / gaps).max())
    chars = max(len(text), 1)
    upper = sum(map(str.isupper, text))
    shouted = len(re.findall(r"\b[A-Z]{3,}\b", text))
    marks = text.count("!") + text.count("?")
    signs = chars - sum(map(str.isalnum, text)) - sum(map(str.isspace, text))
    return (
        math.log1p(len(at)), 100 * len(at) / n, sum(weights) / math.sqrt(n), max(weights, default=0.0), near, 100 * seed / n,
        upper / chars, shouted / n, 100 * marks / chars, signs / chars, 100 * masked / n, math.log1p(len(words)),
    )


def measured(rows: DataFrame, lexicon: Lexicon, learn: bool) -> DataFrame:
    """``rows`` (with text, and label to learn) with the features as a vector, ``__features``."""
    counts, n = lexicon.counts, lexicon.n

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = Lexicon(counts, *n)
        for texts, labels in batches:
            known = labels if learn else [None] * len(texts)
            yield pd.Series([measure(t, own, y) for t, y in zip(texts, known, strict=True)], dtype=object)

    label = F.col("label") if learn else F.lit(0)
    return rows.withColumn("__features", array_to_vector(run(whole_text(), label)))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Terms that toxic rows hold more often, from (text, label). The labelled rows, of which there are at most MAX_ROWS, bound them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                held = {t for w in set(WORD.findall(text.lower())) for t in terms_of(w)}
                if held:
                    yield pd.DataFrame({"term": list(held), "label": label})

    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    held = rows.select("text", "label").mapInPandas(run, "term string, label int").groupBy("term").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")
    )
    ratio = ((F.col("toxic") + 0.1) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    best = held.where((F.col("toxic") >= MIN_ROWS) & (ratio >= MIN_ODDS)).orderBy(F.desc(ratio), "term")
    return Lexicon({r["term"]: (r["toxic"], r["clean"]) for r in best.collect()}, n_toxic, n_clean)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, text, label of at most ``max_rows`` rows that are not held out (fold 1 of 3)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = known.where(id_fold(3) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # No more than max_rows pairs of an id and a label.
    return rows.join(F.broadcast(known.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")


class Model:
    """Lexicon, trees and calibration. With labels of one kind only, every score is that label."""

    def __init__(self, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS):
        rows = stored(training_rows(docs, labels, max_rows), "labelled")
        self.lexicon = learn_lexicon(rows)
        self.trees = None
        self.only = 1.0 if self.lexicon.n[0] else 0.0
        if 0 in self.lexicon.n:
            return
        rows = stored(measured(rows, self.lexicon, learn=True).select("doc_id", "label", "__features"), "measured")
        part = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)) == 0
        grow, calibrate = rows.where(~part), rows.where(part)
        if grow.select("label").distinct().count() < 2 or calibrate.select("label").distinct().count() < 2:
            grow = calibrate = rows
        trees = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=11)
        trees.setPredictionCol("__side").setProbabilityCol("__odds").setRawPredictionCol("__raw")
        grow = grow.repartition(8, "doc_id").sortWithinPartitions("doc_id").cache()
        self.trees = trees.fit(grow)
        grow.unpersist()
        calibrate = self.margins(calibrate).select(F.col("label").cast("double").alias("label"), "__margin")
        self.level = IsotonicRegression(featuresCol="__margin", predictionCol="__score").fit(calibrate)

    def margins(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("__margin", vector_to_array("__raw")[1])

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``__score``; only the text is an input."""
        if self.trees is None:
            return docs.withColumn("__score", F.lit(self.only))
        out = self.level.transform(self.margins(measured(docs, self.lexicon, learn=False)))
        return out.select(*docs.columns, F.least(F.greatest("__score", F.lit(0.0)), F.lit(1.0)).alias("__score"))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from THRESHOLD on).

    Null and empty texts have no words and get the score of such a text. Repeated rows and null ids are
    scored as they stand; of several labels of one id the toxic one counts, null labels are left out, and
    without labels of both kinds every score is the one label there is, or 0. Columns other than doc_id
    and text (and toxic of the labels) are not read.
    """
    out = Model(docs, labels, max_rows).score(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        (id_fold(3) == 1).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows that score below THRESHOLD, with all their columns (names that start with ``__`` are reserved)."""
    return Model(docs, labels, max_rows).score(docs).where(F.col("__score") < THRESHOLD).select(*docs.columns)
