from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import rows_of, texts_of
from tickloom.llm import byte_bpe as b

with open(b.RANKS, "rb") as f:
    CODEC = b.codec(f.read(), b.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab's \n\t.,19é漢\x1c\x85\u00a0", max_size=300), st.sampled_from([2, 7, 40]))
def test_tree_equals_library(text, leaf):
    ids = CODEC.encode(text, leaf).tolist()
    assert ids == CODEC.leaf.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


def test_query_columns(spark, documents, edge, none):
    bpe = b.Bpe(spark)
    docs = documents.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    want = []
    for i, t in texts_of(docs):
        ids = CODEC.leaf.encode_ordinary(t)
        want.append((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(t.encode()).hexdigest()))
    assert rows_of(b.digests(b.encode(docs, bpe), bpe)) == sorted(want, key=str)
    assert b.digests(b.encode(none, bpe), bpe).count() == 0
