"""Packing: whole pieces, gapless sequences, few of them."""

import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from contestry.llm.packing import best_fit, crossover, cut_points, evolve, mutation, pack_documents, pack_lengths, word_encoder
from contestry.llm.suffix_dedup import remove_repeats

PATH = P.path("byte_bpe_50k.json")


def check_sequences(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_cut_points():
    assert cut_points(5, 4) == [(0, 1), (1, 4)]
    assert cut_points(8, 4) == [(0, 4), (4, 4)]
    assert cut_points(3, 4) == [(0, 3)]


def test_operators_of_the_search_keep_every_item():
    draw = np.random.default_rng(1)
    sizes = draw.integers(1, 100, 400)
    a, b = (best_fit(sizes, draw.permutation(400), 100) for _ in range(2))
    for child in (crossover(a, b, sizes, 100, draw), mutation(a, sizes, 100, draw)):
        fill = np.bincount(child, sizes)
        assert len(child) == 400 and fill.max() <= 100 and fill.min() > 0
    best = evolve([a, b], sizes, 100, 20, 3)[0]
    assert best.max() <= min(a.max(), b.max())


def test_lengths_in_several_shards(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice([draw.randrange(1, 65), 64, 5])) for i in range(1500)]
    placed = pack_lengths(spark.createDataFrame(rows, "_key long, length long"), 64, shard_pieces=200)
    out = placed.join(spark.createDataFrame(rows, "_key long, length long"), "_key").collect()
    assert sorted(r._key for r in out) == list(range(1500))
    least = -(-sum(n for _, n in rows) // 64)
    assert check_sequences(out, 64) <= least * 1.04 + 8


@pytest.mark.parametrize("capacity", [16, 1024])
def test_documents(spark, capacity):
    draw = random.Random(4)
    texts = [" ".join(draw.choices(["the", "añb", "x1", "\n\n", "日本", "<|endoftext|>"], k=draw.randrange(0, 90))) for _ in range(60)]
    data = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], None), (None, "a b", ""), (99, None, ""), (100, "word " * 9000, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, piece string").repartition(3)
    out = pack_documents(docs, PATH, P.PATTERN, capacity=capacity, with_ids=True).collect()
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, t, _ in data:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(cut_points(len(ids), capacity)):
            want.append((repr(i), k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()), tuple(ids[s : s + n])))
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in out) == sorted(want)
    least = -(-sum(len(w[-1]) for w in want) // capacity)
    assert check_sequences(out, capacity) <= least * 1.05 + 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(empty, PATH, P.PATTERN).count() == 0


WITH_POST = {"post_processor": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}


@pytest.mark.parametrize("changed", [{}, WITH_POST])
def test_words_through_the_merges(changed):
    with open(PATH, encoding="utf-8") as file:
        told = json.dumps(json.load(file) | changed)
    draw, tok = random.Random(8), Tokenizer.from_str(told)
    letters = [chr(c) for c in (*range(0x250), 0x300, 0x4E2D, 0xFFFD, 0x1F600)]
    ids_of = word_encoder(told, P.PATTERN)
    for _ in range(300):
        text = "".join(draw.choices([*letters, "the", " The", "  ", "\r\n"], k=draw.randrange(60)))
        assert np.frombuffer(ids_of(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_workers_let_go_of_the_encoder(spark):
    docs = spark.range(64).selectExpr("id AS doc_id", "'the text' AS text").repartition(64)

    def counted(batches):
        from contestry.llm import common

        for batch in batches:
            kept = [sum(key[0].__name__ == "word_encoder" for key in common._kept)] * batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["n"])

    keeping = lambda: docs.mapInArrow(counted, "n long").groupBy().sum("n").head()[0]
    assert pack_documents(docs, PATH, P.PATTERN).count() == 64
    assert keeping() > 0
    assert remove_repeats(docs).count() == 64
    assert keeping() == 0
