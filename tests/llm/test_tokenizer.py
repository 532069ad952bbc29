import random

import public_tokenizers
import pytest
import tiktoken
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from chatlake.llm import tokenizer


@pytest.fixture(scope="module")
def codec():
    return tokenizer.codec(tokenizer.vocabulary_path())


@pytest.fixture(scope="module")
def other(codec):
    ranks = {p: i for i, p in enumerate(codec.pieces)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_round_trip_and_equal_ids(text):
    c = tokenizer.codec(tokenizer.vocabulary_path())
    ids = c.encode(text)
    assert c.decode(ids) == text
    ranks = {p: i for i, p in enumerate(c.pieces)}
    encoding = test_round_trip_and_equal_ids.__dict__.setdefault("e", tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    assert ids == encoding.encode_ordinary(text)


def test_special_tokens_are_text(codec, other):
    for t in ("<|endoftext|>", "a <|endoftext|> b", "", " ", "\n\n  x", "zq" * 3000, "日本語😀", "it's we'll"):
        assert codec.encode(t) == other.encode_ordinary(t)


def test_memory_is_bounded(codec, other, monkeypatch):
    monkeypatch.setattr(tokenizer, "REMEMBERED", 50)
    r = random.Random(1)
    for _ in range(50):
        t = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60))
        assert codec.encode(t) == other.encode_ordinary(t)


def test_corpus(spark, other):
    long = "lorem ipsum " * 50_000
    df = spark.createDataFrame([(1, "hello world", "c"), (2, "", "c"), (3, None, "c"), (4, " ", "c"), (1, "hello world", "c"), (5, long, "c"), (None, "x", "c")], "doc_id bigint, text string, ids string")
    got = rows(tokenizer.encode_corpus(df))
    assert [(k, len(v)) for k, v in got if k == 5] == [(5, len(other.encode_ordinary(long)))]
    assert [g for g in got if g[0] != 5] == sorted([(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, []), (4, [220]), (None, [87])], key=repr)
    out = tokenizer.encode_corpus(df)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert tokenizer.encode_corpus(df.limit(0)).count() == 0
