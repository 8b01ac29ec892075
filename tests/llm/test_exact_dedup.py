"""Exact groups against a dictionary of normalised texts."""

import random
import re
from collections import defaultdict

import pytest

from contestry.llm.exact_dedup import CUT_AFTER, chunks_of, exact_dedup, exact_groups

SCHEMA = "doc_id long, text string, _recipe string, _id int"


def rows(seed=3):
    draw = random.Random(seed)
    words = ["as", "is", "the", "of", "tés", "k", "\t", "\n", "  ", "e s"]
    texts = [" ".join(draw.choices(words, k=draw.choice([0, 1, 3, 400, 3000]))) for _ in range(25)]
    texts += [t.replace(" ", "\r\n") for t in texts] + [None, "", " ", "x" * 30000, "x" * 30000]
    out = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return out + [out[3], out[7], (None, "of the", "a", 0), (None, "of  the", None, 0)]


def expected(data):
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 3])
def test_groups_equal_brute_force(spark, bits):
    data = rows()
    got = exact_groups(spark.createDataFrame(data, SCHEMA), hash_bits=bits)
    assert sorted([tuple(r)[:4] for r in got.collect()], key=repr) == expected(data)


def test_chunks_join_to_the_text_and_follow_its_content(spark):
    text = " ".join(random.Random(1).choices(["kas", "do", "ere", "mir", "at", "of", "lo", "ge"], k=4000))
    df = spark.createDataFrame([(text,), ("some words ahead " + text,)], "text string")
    one, two = [r[0] for r in df.select(chunks_of(df.text)).collect()]
    assert "".join(one) == text and "".join(two) == "some words ahead " + text
    assert len(set(one) & set(two)) >= len(one) - 8
    assert all(re.search(CUT_AFTER, a + b[0]) and a[-1] == " " for a, b in zip(one, one[1:]))


def test_empty_table_and_dropping(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_groups(empty).collect() == []
    docs = spark.createDataFrame([(2, "a b", "", 0), (1, "a\tb", "", 0), (5, "c", "", 0)], SCHEMA)
    assert sorted(r.doc_id for r in exact_dedup(docs).collect()) == [1, 5]
