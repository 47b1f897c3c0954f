from pathlib import Path

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import tokens as T

pytestmark = pytest.mark.skipif(not Path(T.VOCABULARY).exists(), reason="no vocabulary file")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t .'s1😀 ", max_size=30), max_size=5))
def test_counts_equal_the_tokenizer(texts):
    enc = T.encoder(T.VOCABULARY)
    assert list(T.count_batch(pa.array(texts, pa.string()), T.VOCABULARY)) == [len(enc.encode_ordinary(t)) for t in texts]


def test_nulls_long_texts_and_columns(spark):
    df = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "word " * 20000, "q")], "id int, text string, n_tokens_before string")
    got = {r["id"]: r["n_tokens"] for r in T.with_token_counts(df).collect()}
    assert got[1] == 0 and got[2] == 0 and got[3] == len(T.encoder(T.VOCABULARY).encode_ordinary("word " * 20000))
    assert T.with_token_counts(df.limit(0)).count() == 0
