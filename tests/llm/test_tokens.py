import time
from pathlib import Path

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm.tokens import PATTERN, Encoder, encode_corpus, read_ranks, token_counts, vocabulary_path

RANKS = read_ranks(Path(vocabulary_path()).read_bytes())
OWN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_equals_the_public_library(text):
    got = Encoder(RANKS).encode(text)
    assert got == OWN.encode_ordinary(text)
    assert OWN.decode(got) == text


def test_long_texts_without_a_break():
    for s in ("a" * 50_000, "äß" * 20_000, " " * 30_000, "😀" * 5_000, "ab<|endoftext|>cd", "﻿​\x00x"):
        began = time.time()
        assert Encoder(RANKS).encode(s) == OWN.encode_ordinary(s)
        assert time.time() - began < 20


def test_frame(spark, data):
    df = spark.createDataFrame([(1, "hello world", 3), (2, None, 3), (3, "", 3), (1, "hello world", 3)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df).collect())
    assert got == [(1, OWN.encode_ordinary("hello world"))] * 2 + [(2, []), (3, [])]
    assert encode_corpus(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert {r.doc_id: r.ids for r in encode_corpus(docs).collect()} == {r.doc_id: OWN.encode_ordinary(r.text) if r.text else [] for r in docs.collect()}
    assert token_counts(df, ["doc_id"]).filter("n_tokens = 0").count() == 2
