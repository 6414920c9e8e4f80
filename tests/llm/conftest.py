import pytest

LONG = " ".join(f"word{i % 977} of the long text" for i in range(8000))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rows = [
        (1, "the same text as two in all of its words", "en", "a", 40),
        (2, "the same text as two in all of its words", "en", "b", 40),
        (3, "", "en", "a", 0),
        (4, None, None, None, None),
        (5, LONG, "en", "a", len(LONG)),
        (6, LONG + " end", None, None, None),
        (7, "a row that is there twice with all it has", "de", "b", 10),
        (7, "a row that is there twice with all it has", "de", "b", 10),
        (None, "no id at all but still a text of words", "fr", "c", 3),
        (None, None, None, None, None),
        (8, " \t\n ", "en", "c", 4),
        (9, "1234 5678 !!! --- 90", "en", "c", 20),
        (10, "Ünïcödé wörds ëverywhere, çà et là", "fr", "é", 30),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    clash = "keep_id long, kept boolean, key binary, size long, number long, score double, label int, d int, i int, word string"
    for c in clash.split(", "):
        name, kind = c.split()
        docs = docs.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    return docs


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


def texts_of(docs):
    """(doc_id, text) of every row, null as empty."""
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
