from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of, texts_of
from tickloom.llm import exact_dedup


def brute(texts):
    size = Counter(t for _, t in texts)
    best = {}
    for i, t in texts:
        best[t] = i if best.get(t) is None else best[t] if i is None else max(i, best[t])
    return sorted(((i, best[t], size[t], i == best[t], sha256(t.encode()).hexdigest()) for i, t in texts), key=str)


@pytest.mark.parametrize("bits", [1, 64, exact_dedup.FILTER_BITS])
def test_equals_grouping(documents, edge, bits):
    docs = documents.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    assert rows_of(exact_dedup.mark_copies(docs, bits)) == brute(texts_of(docs))


def test_one_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    assert rows_of(exact_dedup.mark_copies(docs)) == brute(texts_of(docs))


def test_drop(edge, none):
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert Counter(got) == Counter(
        (r["doc_id"], r["text"]) for r in edge.dropDuplicates(["doc_id", "text"]).collect() if r["doc_id"] not in (1, 3) and (r["doc_id"], r["text"]) != (None, None)
    )
    assert exact_dedup.mark_copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_no_python(documents):
    plan = exact_dedup.mark_copies(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
