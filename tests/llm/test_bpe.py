import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")
RANKS = bpe.load_ranks(bpe.VOCABULARY) if os.path.exists(bpe.VOCABULARY) else {}


def reference(text):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={}).encode_ordinary(text)


def own(text):
    out = []
    bpe.Pieces(RANKS).encode(text, out)
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_equals_the_public_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert own(text) == reference(text)


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b\n\n c\t", "it's 2026, isn't it?", "नमस्ते दुनिया", "<|endoftext|> x", " a   b", "🙂🙂 é", "x" * 3_000, "ab " * 2_000, "\n" * 50])
def test_odd_texts(text):
    assert own(text) == reference(text)
    assert bpe.decode(own(text)) == text


@given(st.binary(min_size=1, max_size=200))
@settings(max_examples=60, deadline=None)
def test_scan_and_heap_agree(word):
    assert bpe.merge_by_scan(word, RANKS) == bpe.merge_by_heap(word, RANKS)


def test_table(spark):
    rows = [(1, "a b", "x"), (2, None, "y"), (3, "", None), (1, "a b", "x"), (None, "c", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars string")
    got = bpe.encode_column(df, "text").collect()
    assert len(got) == 5 and {tuple(r.ids) for r in got if r.doc_id in (2, 3)} == {()}
    assert bpe.document_ids(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_column(df.withColumnRenamed("n_chars", "ids"), "text")
