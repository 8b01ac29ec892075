"""Forward sums against all segmentations, and languages of odd texts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestry.llm.language import BEGIN, Lattice, Scorer, fit_languages, identify, with_tail, words_of

PIECES = [BEGIN, BEGIN + "th", "th", "e", "t", "h", "he", "l", "o", "la", "a", "el", "lo", BEGIN + "lo"]


def segmentations(word):
    """All cuts of a word into pieces; a letter that is no piece stands alone as unknown."""
    if not word:
        return [[]]
    out = []
    for n in range(1, len(word) + 1):
        if word[:n] in PIECES or n == 1:
            out += [[word[:n], *rest] for rest in segmentations(word[n:])]
    return out


def chance_of(word, probabilities, lang):
    tail = with_tail(probabilities)
    number = {p: i for i, p in enumerate(PIECES)}
    return sum(math.prod(tail[number.get(p, len(PIECES)), lang] for p in cut) for cut in segmentations(word))


def test_forward_and_expected_counts_equal_brute_force():
    draw = np.random.default_rng(1)
    probabilities = draw.dirichlet(np.ones(len(PIECES)), 2).T
    words = ["the", "hello", "lo", "x", "theéla", "lola"]
    marked = [BEGIN + w for w in words]
    got = Lattice(PIECES).log_chance(marked, with_tail(probabilities))
    times = np.tile([[1.0, 2.0]], (len(words), 1))
    counts = Lattice(PIECES).expected(marked, times, with_tail(probabilities))
    for lang in range(2):
        total = np.zeros(len(PIECES))
        for i, w in enumerate(marked):
            z = chance_of(w, probabilities, lang)
            assert got[i, lang] == pytest.approx(math.log(z))
            for cut in segmentations(w):
                p = math.prod(with_tail(probabilities)[PIECES.index(x) if x in PIECES else -2, lang] for x in cut)
                for x in cut:
                    if x in PIECES:
                        total[PIECES.index(x)] += times[i, lang] * p / z
        assert counts[:, lang] == pytest.approx(total)


def test_words():
    assert words_of("It's 3 ÉTÉ_o!") == ["it", "s", "été", "o"]
    assert words_of("a" * 70) == ["a" * 70]


def test_long_words_are_summed_like_short_ones(monkeypatch):
    draw = np.random.default_rng(3)
    chance = with_tail(draw.dirichlet(np.ones(len(PIECES)), 2).T)
    words = [BEGIN + "".join(draw.choice(list("thelaoxé"), n)) for n in (5, 9, 30, 31)]
    times = np.tile([[1.0, 3.0]], (len(words), 1))
    short = Lattice(PIECES).log_chance(words, chance), Lattice(PIECES).expected(words, times, chance)
    monkeypatch.setattr("contestry.llm.language.WORD_LETTERS", 3)
    assert Lattice(PIECES).log_chance(words, chance) == pytest.approx(short[0])
    assert Lattice(PIECES).expected(words, times, chance) == pytest.approx(short[1])
    far = Lattice(PIECES).log_chance([BEGIN + "hel" * 5_000], chance)
    assert np.isfinite(far).all() and (far < -1_000).all()


def test_memory_bound_changes_nothing(monkeypatch):
    probabilities = np.full((len(PIECES), 1), 1 / len(PIECES))
    a, b = Scorer(PIECES, probabilities), Scorer(PIECES, probabilities)
    monkeypatch.setattr("contestry.llm.language.REMEMBERED", 2)
    for words in (["the", "lo", "a"], ["lo", "la"], ["the"]):
        a.prepare(set(words))
        monkeypatch.setattr("contestry.llm.language.REMEMBERED", 100)
        b.prepare(set(words))
        monkeypatch.setattr("contestry.llm.language.REMEMBERED", 2)
        assert a.totals(words) == pytest.approx(b.totals(words))


def test_languages_on_held_out_rows_and_odd_texts(spark):
    draw = random.Random(6)
    rows = [(i, " ".join(draw.choices(["the", "he", "hat"], k=9)), "xx", 1) for i in range(40)]
    rows += [(100 + i, " ".join(draw.choices(["lola", "elo", "la"], k=9)), "yy", 2) for i in range(40)]
    odd = [(200, None, "xx", 0), (201, "", None, 0), (202, "12 !?", "xx", 0), (None, "the the", None, 0),
           (203, "the " * 30000, None, 0), (203, "the " * 30000, None, 0), (204, "ω" * 5000, None, 0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int").repartition(3)
    learn = F.col("doc_id") % 4 != 0
    langs, chance = fit_languages(docs, PIECES, learn)
    assert langs == ["xx", "yy"] and chance.sum(axis=0) == pytest.approx([1, 1])
    got = identify(docs, PIECES, langs, chance).collect()
    assert len(got) == len(rows) + len(odd)
    found = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert all(found[i][0] == lang for i, _, lang, _ in rows)
    assert found[200] == found[201] == found[202] == ("und", 0.0)
    assert found[None][0] == found[203][0] == "xx" and found[204][0] in langs
    assert all(0 <= s <= 1 for _, s in found.values())


def test_nothing_to_learn_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    langs, chance = fit_languages(docs, PIECES, F.lit(True))
    assert langs == []
    assert [tuple(r) for r in identify(docs, PIECES, langs, chance).collect()] == [(1, "und", 0.0)]
    assert identify(docs.limit(0), PIECES, langs, chance).count() == 0
