"""Links and classes against all pairs of n-gram sets."""

import random
import re

import numpy as np
import pytest
import xxhash

from contestry.llm.ngram_join import (
    HASHES, Shingler, least_matches, minhash, similar_texts, surviving_pairs, verified,
)

SCHEMA = "doc_id long, text string, _rep string, component int"


def grams(text):
    words = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def place(row):
    """Documents go by id, null last, and those with one id by the hash of their text."""
    digest = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
    return row[0] is None, row[0] or 0, digest - (digest >> 63 << 64)


def brute(rows, threshold=0.8):
    """(id, links, class, kept) of every row; rows alike are one document."""
    names = sorted({place(r) for r in rows})
    docs = {place(r): grams(r[1]) for r in rows}
    near = {x: {y for y in names if x != y and docs[x] and docs[y] and len(docs[x] & docs[y]) >= threshold * len(docs[x] | docs[y])}
            for x in names}
    least = {}
    for x in names:
        open_ = [x]
        while open_:
            y = open_.pop()
            if y not in least:
                least[y] = x
                open_ += near[y]
    mine = [(r[0], place(r)) for r in rows]
    return [(i, len(near[x]), None if least[x][0] else least[x][1], least[x] == x) for i, x in mine]


def changed(draw, text, n):
    words = text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = f"z{draw.randrange(999)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [512, 7])
def test_equal_to_all_pairs(spark, block):
    draw = random.Random(8)
    base = [" ".join(f"w{draw.randrange(3000)}" for _ in range(draw.choice([3, 20, 90, 200]))) for _ in range(14)]
    texts = [changed(draw, draw.choice(base), draw.randrange(0, 6)) for _ in range(110)]
    texts += [changed(draw, base[0] + " " + base[1], 1) for _ in range(25)]
    rows = list(enumerate(texts)) + [(300 + i, base[2]) for i in range(20)]
    rows += [(400, None), (401, ""), (402, "?! ."), (403, "One."), (404, "one"), (405, "big " * 50000)]
    rows += [(None, base[3]), (None, base[3] + " end"), (None, ""), (0, texts[0]), (0, texts[0])]
    rows += [(1, base[4]), (1, "no word of all the others is in this text at all"), (2, None)]  # clashing ids
    data = [(*r, "x", 1) for r in rows]
    got = similar_texts(spark.createDataFrame(data, SCHEMA).repartition(4), block=block).collect()
    assert sorted(((r.doc_id, r.n_links, r.class_id, r.kept) for r in got), key=repr) == sorted(brute(rows), key=repr)


def test_empty_table(spark):
    assert similar_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pruning_bound_and_survivors():
    assert least_matches(16, 0.8, 1e-6) <= least_matches(16, 0.8, 1e-2) <= 13
    draw = np.random.default_rng(1)
    sets = [draw.integers(0, 1 << 60, 400).astype(np.uint64) for _ in range(3)]
    sets.append(np.concatenate([sets[0][:380], sets[1][:20]]))
    sets = [np.unique(s) for s in sets]
    values = np.stack([minhash(s) for s in sets])
    pairs = surviving_pairs(values, np.ones((4, 4), bool), 0.8, 1e-6)
    assert pairs.tolist() == [[0, 3]]
    assert values.shape[1] == HASHES and abs((values[0] == values[3]).mean() - 380 / 420) < 0.12


def test_both_ways_to_verify_agree(monkeypatch):
    draw = np.random.default_rng(2)
    pool = draw.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(draw.choice(pool, draw.integers(100, 290), replace=False)) for _ in range(30)]
    pairs = np.argwhere(np.triu(np.ones((30, 30), bool), 1))
    one = verified(sets, pairs, 0.6).tolist()
    monkeypatch.setattr("contestry.llm.ngram_join.MANY", 3)
    monkeypatch.setattr("contestry.llm.ngram_join.COLUMNS", 64)
    assert verified(sets, pairs, 0.6).tolist() == one and len(one) > 10


def test_shingles_follow_words():
    s = Shingler()
    assert len(s.of("a b c d e f")[0]) == 2 and len(s.of("a b")[0]) == 1 and len(s.of("--")[0]) == 0
    assert (s.of("A, b c d E")[0] == s.of("a b c d e")[0]).all()
