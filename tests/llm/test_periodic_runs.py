"""Runs against all periods and all starts."""

import random

from contestry.llm.periodic_runs import branching_squares, find_runs, runs_of, suffix_ranks
from contestry.llm.queries import op11_periodic_runs

SCHEMA = "doc_id long, text string, runs string, n_words int"


def brute(words, exponent=4, least=6):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_document(draw):
    words = [draw.randrange(draw.choice([1, 2, 3, 8])) for _ in range(draw.randrange(60))]
    if words and draw.random() < 0.6:
        at, period = draw.randrange(len(words)), draw.randrange(1, 8)
        words = [w if i < at else words[min(at + (i - at) % period, len(words) - 1)] for i, w in enumerate(words)]
    return words


def test_equal_to_all_stretches():
    draw = random.Random(5)
    for _ in range(300):
        docs = [random_document(draw) for _ in range(draw.randrange(1, 5))]
        for exponent in (2, 3, 4):
            assert runs_of(docs, exponent) == [brute(d, exponent) for d in docs]


def test_long_runs_and_their_multiples():
    docs = [[*range(7)] * 300 + [1] * 500, [0] * 1000, [*range(50)], []]
    assert runs_of(docs) == [[(0, 2100, 7), (2100, 500, 1)], [(0, 1000, 1)], [], []]


def test_squares_end_a_run():
    import numpy as np

    codes = np.array([9, 1, 2, 1, 2, 1, 2, 1, 2, 5])
    levels = suffix_ranks(codes, np.full(10, 10))
    assert [9, 2] in branching_squares(levels, 4).tolist()
    assert sorted(range(10), key=lambda i: codes[i:].tolist()) == np.argsort(levels[-1][:10]).tolist()


def test_documents_with_odd_values(spark):
    long = " ".join(["a b"] * 20_000)
    rows = [(1, None, "x", 1), (2, "", "", 2), (3, " \t\n", "", 3), (None, "x x x x x x", None, None), (4, "a a a a " * 3, "", 0),
            (5, long, "", 0), (6, "q", "", 0), (6, "q", "", 0), (7, "y\x0b" * 6 + "z", "", 0), (8, "k k k k k", "", 0)]
    got = find_runs(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    want = []
    for doc_id, text, *_ in rows:
        words = (text or "").replace("\x0b", " ").replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        runs = [(0, 40_000, 2)] if text is long else brute(words)
        want.append((doc_id, len(words), runs, collapsed(words, runs)))
    assert sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got], key=repr) == sorted(want, key=repr)
    assert find_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_a_plain_loop(spark, tmp_path):
    import hashlib
    import math
    import re
    import zlib
    from fractions import Fraction

    draw = random.Random(8)
    rows = [(i, " ".join(draw.choice("abc") for _ in range(draw.randrange(40))) if i % 9 else None) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + math.floor((n - a) / (3 + g % 8))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        said = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 3
