"""Deobfuscation against all readings of small lattices, and held-out accuracy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestry.llm.toxicity import (
    NUMBER, OTHER, SYMBOLS, Restorer, character_model, codes_of, fit_toxicity, options, restore_texts,
    score_toxicity, trigram_counts, viterbi,
)

CLEAN = "the cat sat on a mat and this table is stable ; we took a good book to school . see all of it now"


def model_of(texts):
    counts = np.zeros(SYMBOLS**3, np.int64)
    for text in texts:
        c = np.concatenate([[0, 0], codes_of(text), [0]])
        np.add.at(counts, (c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], 1)
    return character_model(counts)


def score(text, model):
    a = b = 0
    total = 0.0
    for char in text + " ":
        c = 0 if char == " " else NUMBER.get(char, OTHER)
        total, a, b = total + model[a, b, c], b, c
    return total


@pytest.fixture(scope="module")
def model():
    return model_of([CLEAN, "stupid moron loser stupid moron loser idiot"] * 20)


def test_viterbi_is_the_best_of_all_readings(model):
    for token in ("st0p", "m0r*n", "a-b", "s t u", "looooser", "1d1ot", "x@@y"):
        best = max(
            score("".join(t for t, _ in way), model) - sum(c for _, c in way)
            for way in itertools.product(*options(token))
        )
        read = viterbi(token, model)
        costs = [
            sum(c for _, c in way)
            for way in itertools.product(*options(token))
            if "".join(t for t, _ in way) == read
        ]
        assert score(read, model) - min(costs) == pytest.approx(best)


@pytest.mark.parametrize("hidden", ["stup1d", "$tupid", "s t u p i d", "stuuuupid", "s.t.u.p.i.d", "STUPID!!", "st*pid"])
def test_disguises_are_read(model, hidden):
    assert Restorer(model).words(f"the {hidden} cat") == ["the", "stupid", "cat"]


def test_plain_words_stay(model):
    assert " ".join(Restorer(model).words(CLEAN)) == CLEAN.replace("; ", "").replace(". ", "")
    assert Restorer(model).words("12 34,5 --- 7") == []


def test_counts_cover_all_texts(spark):
    texts = ["ab é", None, "", "ж12", "a" * 5000]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, code int").repartition(3)
    got = {r.code: r.n for r in trigram_counts(df).collect()}
    assert sum(got.values()) == sum(len(t or "") + 1 for t in texts)
    a = NUMBER["a"]
    assert got[(a * SYMBOLS + a) * SYMBOLS + a] == 4998


def corpus(n=400, seed=4):
    draw = random.Random(seed)
    words = CLEAN.split()
    docs, labels = [], []
    for i in range(n):
        text, toxic = draw.choices(words, k=40), i % 5 == 0
        if toxic:
            for _ in range(2):
                text.insert(draw.randrange(40), draw.choice(["moron", "m0ron", "l o s e r", "loserish", "moroooon"]))
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(900, None, ""), (901, "", None), (None, "moron loser", ""), (902, "cat " * 40000, ""), (0, docs[0][1], "x")]
    table = spark.createDataFrame(docs + odd, "doc_id long, text string, score string").repartition(3)
    known = spark.createDataFrame(labels + [(901, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    fitted = fit_toxicity(table, known, F.col("doc_id") % 4 != 2)
    got = score_toxicity(table, fitted).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)
    of = {r.doc_id: r.predicted for r in got}
    held = [(i, t) for i, t in labels if i % 4 == 2]
    assert sum(of[i] == t for i, t in held) >= 0.97 * len(held)
    assert of[900] == of[901] == of[902] == 0 and of[None] == 1
    assert restore_texts(table.where("doc_id is null"), fitted[0]).first().restored == "moron loser"


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    fitted = fit_toxicity(docs, none, F.lit(True))
    assert [r.score for r in score_toxicity(docs, fitted).collect()] == [0.5]
    fitted = fit_toxicity(docs.limit(0), none, F.lit(True))
    assert score_toxicity(docs.limit(0), fitted).collect() == []


@pytest.mark.parametrize(
    ("hidden", "words"),
    [
        ("idio+", ["idiot"]), ("(at", ["cat"]), ("m0ron**", ["moron"]), ("$$", []),
        ("iiddiioott", ["idiot"]), ("ssttuuppiidd", ["stupid"]), ("the%%%", ["the"]), ("the!", ["the"]),
        ("(see", ["see"]), ("school", ["school"]), ("book)", ["book"]), ("cat...", ["cat"]),
    ],
)
def test_signs_at_the_ends_and_doubled_letters_are_read(model, hidden, words):
    assert Restorer(model).words(hidden) == words


def test_tokens_without_a_letter_are_read_where_the_model_says_so(model):
    assert Restorer(model_of(["as"] * 500)).words("45 @$ 22") == ["as", "as"]
    assert Restorer(model).words("2019 100% $5") == []
