"""License scans by diagonal voting.

All rolling word k-gram hashes of a text are joined to the places that they have in license templates.
A match at word i of the text and word j of the template votes for the diagonal i - j. Votes are summed
by diagonal, neighbouring diagonals are merged (a word was put in or left out), and a merged span is a
hit if it covers enough of the template.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import stored, whole_text

#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2

#: Phrases whose places count, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Public notices, in lower case, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction": "mit-text",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance"
    " with the license": "apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
    " public license as published by the free software foundation": "gpl-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that"
    " the following conditions are met": "bsd",
    "this work is licensed under a creative commons attribution": "cc-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
    " granted": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "released under the mit license": "mit-release",
    "all rights reserved": "reserved",
}

#: Diagonals at most this far apart are one span, and a span must hold this share of its template's k-grams.
NEAR, LEAST = 3, 0.6


def words(text: Column) -> Column:
    # Of all letters only the Kelvin sign lowers to an ASCII letter in full, and no phrase has a k.
    return F.array_remove(F.split(F.lower(text), GAP), "")


def templates(spark: SparkSession, phrases: dict[str, str], exact: bool) -> DataFrame:
    """One row per k-gram of each phrase: as many as the words that were typed."""
    rows = [
        (label, exact, j, len(w) - K + 1, len(w), " ".join(w[j : j + K]))
        for text, label in phrases.items()
        for w in [re.split(GAP, text.lower())]
        for j in range(len(w) - K + 1)
    ]
    return spark.createDataFrame(rows, "label string, exact boolean, j int, grams int, m int, gram string")


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``__key``, the digest of the text: equal texts vote once."""
    return docs.withColumn("__key", F.unhex(F.sha2(whole_text(), 256)))


def votes(texts: DataFrame, places: DataFrame) -> DataFrame:
    """Per text, template and diagonal d = i - j: the template k-grams that were met (``js``)."""
    ws = texts.select("__key", words(whole_text()).alias("__ws"))
    pairs = F.arrays_zip(F.col("__ws").alias("a"), F.slice("__ws", 2, F.greatest(F.size("__ws") - 1, F.lit(0))).alias("b"))
    spots = ws.select("__key", F.posexplode(pairs).alias("i", "g")).where("g.b IS NOT NULL")
    spots = spots.select("__key", "i", F.concat_ws(" ", "g.a", "g.b").alias("gram"))
    # The places are as many as the words that were typed, so they may be broadcast.
    places = F.broadcast(places.withColumn("hash", F.xxhash64("gram")))
    met = spots.withColumn("hash", F.xxhash64("gram")).join(places, ["hash", "gram"])
    # A set of j is no longer than its template.
    return met.groupBy("__key", "label", "exact", "grams", "m", (F.col("i") - F.col("j")).alias("d")).agg(
        F.collect_set("j").alias("js")
    )


def spans(ballots: DataFrame) -> DataFrame:
    """Neighbouring diagonals of the notices merged: __key, label, start, end, share of the template.

    The votes of a span must also lie close together, not be strewn over the text. So of each run of
    diagonals the piece counts that holds most within such a reach, the first of equals: a notice that is
    repeated back to back is found as often as once.
    """
    by = Window.partitionBy("__key", "label").orderBy("d")
    step = F.when(F.col("d") - F.lag("d").over(by) <= NEAR, 0).otherwise(1)
    runs = ballots.where("not exact").withColumn("__new", step).withColumn("__run", F.sum("__new").over(by))
    places = runs.select("__key", "label", "__run", "grams", "d", F.explode("js").alias("j")).withColumn("at", F.col("d") + F.col("j"))
    # Whole places at most ``reach`` apart are at most 1 apart in these units, and none is near to 1 on either side.
    reach = 2 * F.col("grams") + 2 * NEAR - K
    piece = Window.partitionBy("__key", "label", "__run").orderBy(2 * F.col("at") / (2 * reach + 1)).rangeBetween(0, 1)
    pieces = places.select(
        "__key",
        "label",
        "__run",
        (F.size(F.collect_set("j").over(piece)) / F.col("grams")).alias("share"),
        F.col("at").alias("start"),
        (F.max("at").over(piece) + K).alias("end"),
    )
    best = F.max(F.struct("share", (-F.col("start")).alias("before"), "end")).alias("best")
    merged = pieces.where(F.col("share") >= LEAST).groupBy("__key", "label", "__run").agg(best)
    return merged.select("__key", "label", (-F.col("best.before")).alias("start"), F.col("best.end").alias("end"), F.col("best.share").alias("share"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Per document: n_words, the places of the phrases, and the labels of phrases and notices.

    ``n_base`` counts every place where a phrase's words stand one after the other; ``score`` is 1 where a
    phrase stands, else the largest share of a notice that one span holds, else 0. Null and empty texts
    have no words, null first and last places and empty labels. Equal texts are scanned as one, so groups
    of copies and repeated rows cost no more votes; columns other than doc_id and text are not read.
    Every phrase must have at least two words.
    """
    spark = docs.sparkSession
    rows = keyed(docs.select("doc_id", "text"))
    places = templates(spark, phrases, True).unionByName(templates(spark, notices, False))
    ballots = stored(votes(rows, places), "votes")
    whole = ballots.where("exact and size(js) = grams").groupBy("__key").agg(
        F.count("*").alias("n_base"),
        F.min("d").alias("first_word"),
        F.max("d").alias("last_word"),
        F.collect_set("label").alias("base"),
    )
    near = spans(ballots).groupBy("__key").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    found = whole.join(near, "__key", "full")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, own = (F.coalesce(c, F.array().cast("array<string>")) for c in ("base", "own"))
    return rows.select("doc_id", "__key", F.size(words(whole_text())).cast("long").alias("n_words")).join(
        found, "__key", "left"
    ).select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
