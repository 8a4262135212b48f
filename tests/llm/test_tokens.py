"""Exact encoding against a public encoder, and exact round trips."""

import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moltide.llm import tokens as TK

pytestmark = pytest.mark.skipif(not os.path.exists(TK.VOCABULARY), reason="no vocabulary file")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def tools():
    import tiktoken

    tokens = TK.read_vocabulary()
    ref = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(tokens)}, special_tokens={})
    return TK.BatchEncoder(tokens, TK.splits(tokens), TK.character_classes()), ref, TK.Decoder(tokens)


def encode(tools, texts):
    return [x for _, _, part in tools[0].encode(pa.array(texts, pa.string())) for x in part.to_pylist()]


PARTS = ["'s", "'ll", "'re", " ", "  ", "\n", "\t", "a", "Z", "é", "ß", "9", "²", "!", "'", "''", "\xa0", "中", "😀", "\r\n", "'t", "don't", "x" * 300, "-", "́", " ", "<|endoftext|>"]


def test_mixtures(tools):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 20))) for _ in range(3000)] + ["", None, " ", "ab" * 50_000]
    got = encode(tools, texts)
    assert got == [tools[1].encode_ordinary(t or "") for t in texts]
    back = tools[2].decode(pa.array(got, pa.list_(pa.int32()))).to_pylist()
    assert back == [t or "" for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(tools, texts):
    assert encode(tools, texts) == [tools[1].encode_ordinary(t) for t in texts]


def test_table(spark, tools):
    rows = [(1, "Hello world's end", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world's end", "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in TK.encode(d).collect())
    assert got == sorted((i, tools[1].encode_ordinary(t or "")) for i, t, _ in rows)
    assert sorted(r["text"] for r in TK.decode(TK.encode(d)).collect()) == ["", "", "Hello world's end", "Hello world's end"]
    assert TK.encode(d.limit(0)).count() == 0
