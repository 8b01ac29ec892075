"""Links and components against all cosines, and the pieces they are made of."""

import random

import numpy as np

from contestry.llm.blocks import spanning_edges
from contestry.llm.components import block_pairs, connected_components
from contestry.llm.embedding_neighbors import near_vectors

SCHEMA = "vec_id long, embedding array<float>, _rep int, _leaf string"


def brute(rows, cosine=0.95):
    good = [(i, np.asarray(v, np.float32).astype(float)) for i, v, *_ in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.asarray(v) != 0)]
    links, label = [0] * len(good), list(range(len(good)))
    find = lambda x: x if label[x] == x else find(label[x])
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a] += 1
                links[b] += 1
                label[find(a)] = find(b)
    least = {}
    for a in range(len(good)):
        least[find(a)] = min(least.get(find(a), good[a][0]), good[a][0])
    out = [(good[a][0], links[a], least[find(a)]) for a in range(len(good))]
    known = {id(v) for _, v in good}
    rest = [i for i, v, *_ in rows if not (i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.asarray(v) != 0))]
    return sorted([*out, *((i, 0, i) for i in rest)], key=repr) if known or rest else []


def test_equal_to_all_cosines(spark):
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.12 * draw.standard_normal(16)).tolist(), 0, "x") for i in range(150)]
    rows += [(200 + i, (centres[0] + 0.05 * draw.standard_normal(16)).tolist(), 0, "x") for i in range(120)]
    rows += [(400 + i, centres[1].tolist(), 0, "x") for i in range(50)]
    rows += [(500, None, 0, ""), (501, [0.0] * 16, 0, ""), (502, [float("nan")] * 16, 0, ""), (503, [1.0, None], 0, ""),
             (504, [float("inf"), 1.0], 0, ""), (505, [], 0, ""), (506, [1.0, 2.0], 0, ""), (507, [2.0, 4.0], 0, ""),
             (None, centres[1].tolist(), None, None), (400, centres[1].tolist(), 0, "")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = near_vectors(df, leaf=16, block=40).collect()
    want = brute(rows)
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=repr) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_table_and_no_links(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0, ""), (2, [0.0, 1.0], 0, "")], SCHEMA)
    assert sorted(tuple(r) for r in near_vectors(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert near_vectors(df.limit(0)).count() == 0


def test_components_of_random_graphs_and_paths(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(900, i) for i in range(800, 860)] + [(5, 5), (None, 3)]
    edges += [(draw.randrange(90), draw.randrange(90)) for _ in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_any_two_rows_of_a_group_meet_once(spark):
    df = spark.createDataFrame([(g, i) for g, n in ((1, 3), (2, 25)) for i in range(n)], "g long, k long")
    met = {}
    for r in block_pairs(df, "g", "k", 4).collect():
        met.setdefault((r.g, r._b1, r._b2), []).append((r.k, r._own))
    seen = []
    for (g, b1, b2), members in met.items():
        seen += [(g, *sorted((x, y))) for x, p in members for y, q in members if x < y and (b1 == b2 or p != q)]
    assert sorted(seen) == sorted((g, a, b) for g, n in ((1, 3), (2, 25)) for b in range(n) for a in range(b))


def test_spanning_edges():
    linked = np.zeros((5, 5), bool)
    linked[0, 3] = linked[3, 0] = linked[3, 4] = linked[4, 3] = True
    assert sorted(spanning_edges(linked)) == [(0, 3), (0, 4)]
