"""Exact top-k products against all products, and the pruning they rest on."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestry.llm.top_products import Best, Block, _focused, scaled, top_products

SCHEMA = "vec_id long, embedding array<long>, _key string, rank int"


def brute(rows, asked, k):
    good = list({(r[0], tuple(r[1])) for r in rows if r[0] is not None and r[1] is not None and None not in r[1]})
    out = []
    for q in good:
        if asked(q[0]):
            scores = [(-sum(a * b for a, b in zip(q[1], p[1])), p[0]) for p in good if p != q]  # noqa: B905
            out += [(q[0], i + 1, v, -s) for i, (s, v) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(df, k, **sizes):
    return sorted(tuple(r) for r in top_products(df, F.col("vec_id") % 5 == 0, k, **sizes).collect())


def vectors(kind, draw):
    n = 300
    if kind == "unit":
        x = draw.standard_normal((n, 8))
        x *= 64 / np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "skewed":
        x = draw.standard_normal((n, 8)) * draw.pareto(1.0, (n, 1)) * 40
    elif kind == "clustered":
        x = draw.standard_normal((12, 8))[draw.integers(0, 12, n)] * 500 + draw.standard_normal((n, 8)) * 5
    else:  # a third equal, the rest opposite or zero
        x = np.where(np.arange(n)[:, None] % 3 == 0, 7.0, draw.integers(-2, 1, (n, 8)))
    return np.floor(x).astype(int).tolist()


@pytest.mark.parametrize("kind", ["unit", "skewed", "clustered", "ties"])
def test_equal_to_all_products(spark, kind):
    rows = [(i, v, "x", 1) for i, v in enumerate(vectors(kind, np.random.default_rng(4)))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, lambda i: i % 5 == 0, 7)
    assert found(df, 7, bucket=32, group=64, block=16) == want
    assert found(df, 7) == want


def test_odd_rows(spark):
    rows = [(0, [1, 2], "", 0), (0, [1, 2], "", 0), (0, [3], None, 0), (5, [], "", 0), (1, None, "", 0), (2, [1, None], "", 0),
            (None, [9, 9], "", 0), (3, [4, 5, 6], "", 0), (4, [0, 0], "", 0), (10, [2**40, 2**40], "", 0), (11, [-(2**40), 5], "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r[0], r[2], max(-(2**63) + 1, min(r[3], 2**63 - 1))) for r in brute(rows, lambda i: i % 5 == 0, 20)]
    assert sorted((r[0], r[2], r[3]) for r in found(df, 20)) == sorted(got)
    assert found(df.limit(0), 20) == []
    assert found(df.where("vec_id = 0").limit(1), 20) == []


def test_null_and_unlimited_components_are_left_out(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, -0.01]), (1, [inf, 1.0]), (2, [nan, 1.0]), (3, [None, 1.0]), (4, None), (5, []), (6, [1e300, 0.0])]
    got = spark.createDataFrame(rows, "i int, v array<float>").select("i", scaled(F.col("v"), 64.0).alias("w")).collect()
    assert {r.i: r.w for r in got}[0] == [32, -1]
    assert [r.w for r in got[1:5]] == [None] * 4 and got[5].w == []


def test_coordinates_keep_every_vector_with_the_cosine():
    draw = np.random.default_rng(1)
    for _ in range(40):
        x = np.rint(draw.standard_normal((200, 6)) * 100).astype(np.int64)
        block = Block(np.arange(200), np.arange(200), x)
        query = draw.standard_normal(6)
        query /= np.linalg.norm(query)
        cosine = draw.uniform(0.5, 0.99)
        there = np.flatnonzero(x @ query / block.lengths >= cosine)
        kept = _focused(query, cosine, block)
        assert set(there) <= set(kept) and (cosine < 0.9 or len(kept) < 150)


def test_a_bucket_out_of_reach_is_passed_over(monkeypatch):
    queries = Block(np.array([1]), np.array([1]), np.array([[10, 0]]))
    best = Best(queries, 1, np.array([500]))
    monkeypatch.setattr(best, "_taken", lambda *a: pytest.fail("multiplied"))
    best.search(Block(np.array([2]), np.array([2]), np.array([[0, 49]])))
    monkeypatch.undo()
    best.search(Block(np.array([2, 3]), np.array([2, 3]), np.array([[50, 0], [0, 50]])))
    assert best.ids.tolist() == [2]


def test_packing_is_exact():
    draw = random.Random(3)
    for bits in (6, 14, 30, 62):
        x = np.array([[draw.randrange(-(2**bits), 2**bits) for _ in range(3)] for _ in range(5)])
        block = Block(np.arange(5), np.arange(5), x)
        assert (Block.of(*block.packed(0)[2:]).values == x).all()
