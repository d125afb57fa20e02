import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from guideloom.llm.tokenize import decoded_texts, encoder, read_ranks, token_counts, token_ids, vocabulary_path
from tests.conftest import rows

PATH = vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")


def reference():
    import tiktoken

    P = pytest.importorskip("public_tokenizers")
    with open(PATH, "rb") as f:
        ranks = read_ranks(f.read())
    return encoder(ranks), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_ids_equal_the_public_encoder():
    ours, theirs = reference()

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.text(max_size=80), st.text("ab' \n\t\r1\x1c\x85\u3000'lL<|endof", max_size=80)))
    def equal(text):
        assert ours(text) == theirs(text)

    equal()
    for text in ("a" * 20_000, "ab" * 5000, " " * 3000 + "x", "<|endoftext|>", "👩‍💻é́", "don't WE'LL"):
        assert ours(text) == theirs(text)


def test_round_trip_and_edge_rows(spark):
    texts = ["Hello, world", "", None, "ＦＵＬＬ 全角 é", "x" * 50_000, "a\x00b", "Hello, world"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, "again")], "id long, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(0))
    ids = token_ids(df, "id", "text")
    assert ids.dtypes[1] == ("ids", "array<int>")
    got = {r.id: r.ids for r in ids.where("id > 0").collect()}
    assert got[1] == [] and got[2] == [] and ids.count() == len(texts) + 1
    back = dict(rows(decoded_texts(ids.where("id > 0"), "id", "ids")))
    assert all(back[i] == (t or "") for i, t in enumerate(texts) if i)
    assert {r.id: r.n_tokens for r in token_counts(df.where("id > 0"), "id", "text").collect()} == {i: len(x) for i, x in got.items()}


def test_empty(spark):
    assert rows(token_ids(spark.createDataFrame([], "id long, text string"), "id", "text")) == []
