import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from saltmarsh.llm import bpe, queries
from tests.llm.rows import ROWS, SCHEMA, documents

tokenizers = pytest.importorskip("tokenizers")
PATH = queries.tokenizer_path()
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    ENCODER = bpe.Encoder(bpe.Vocabulary(f.read()))
LETTERS = "abcdeEÉéßΣσς İIıñ́̈ẞ\x1c\x1d 　\t\n01½²'’sStTdD.,!#ﬁ中文😀🏽‍​\x00ͅ\xa0"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(LETTERS, max_size=40), st.text(max_size=30), st.lists(st.sampled_from(["<|startoftext|>", "<|endoftext|>", "it's", " ", "WE'LL"]), max_size=6).map("".join)))
def test_ids_are_the_librarys(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(ENCODER.encode(text), dtype=np.int32).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_long_words_and_levels():
    for text in ("ab" * 5000, "the" * 3000, "x" * 20_000, "a" * 17, "hello" * 53):
        assert np.frombuffer(ENCODER.encode(text), dtype=np.int32).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_encode_and_decode(spark):
    docs = documents(spark).withColumns({"ids": F.lit("old"), "decoded": F.lit("old"), "label": F.lit(1)})
    done = bpe.encode(docs, PATH, decoded="decoded")
    got = done.collect()
    assert len(got) == len(ROWS) and set(done.columns) == {*docs.columns}
    for r in got:
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == LIBRARY.decode(ids, skip_special_tokens=False)
    apart = bpe.decode(bpe.encode(docs.drop("decoded"), PATH), PATH).collect()
    assert sorted(r.decoded for r in apart) == sorted(r.decoded for r in got)
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH, decoded="decoded").count() == 0


def test_memory_is_bounded():
    small = bpe.Recent(lambda s: s.encode(), 3)
    assert [small[c] for c in "abcdabcde"] == [c.encode() for c in "abcdabcde"] and len(small) <= 3 and len(small.older) <= 3
