"""Encoding against tiktoken, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from contestry.llm import byte_bpe
from contestry.llm.byte_bpe import ByteBpe, decode_documents, encode_documents, read_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def odd_texts():
    draw = random.Random(5)
    pool = ["the", " ", "\n", " ", "ß", "日本", "😀", "\x00", "'ll", "123", "...", "‍", "é", "<|endoftext|>"]
    made = ["".join(draw.choices(pool, k=draw.randrange(1, 60))) for _ in range(200)]
    return ["", " ", "a" * 5000, "ab" * 20000, " " * 3000, *made]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_ids_equal_tiktoken(reference, monkeypatch):
    bpe = ByteBpe(read_ranks(PATH), P.PATTERN)
    texts = odd_texts() + [t.decode("utf-8", "ignore") for t in list(bpe.ranks)[::7]]
    for text in texts:
        assert bpe.encode(text) == reference.encode_ordinary(text)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    small = ByteBpe(read_ranks(PATH), P.PATTERN)
    for text in texts[:60]:
        assert small.encode(text) == reference.encode_ordinary(text)


def test_documents(spark, reference):
    data = [(i, t, "x") for i, t in enumerate(odd_texts())] + [(7, None, None), (None, "same", None), (7, "same", "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, token_ids string").repartition(3)
    rows = encode_documents(docs, PATH, P.PATTERN).collect()
    want = sorted(
        (repr(i), len(ids := reference.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
         hashlib.sha256((t or "").encode()).hexdigest())
        for i, t, _ in data
    )
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    back = decode_documents(encode_documents(docs, PATH, P.PATTERN), PATH).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t, _ in data)


def test_empty_table_and_gaps(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode_documents(empty, PATH, P.PATTERN, with_ids=False).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.serialize_model({b"a": 0, b"b": 2})
