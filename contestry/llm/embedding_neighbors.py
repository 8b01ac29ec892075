"""Near-duplicate vectors by a forest of random-projection trees.

A tree splits the space again and again by random directions; vectors near a cut go to both
sides. Vectors are compared within leaves only, exactly and in double precision. The trees are
fitted on a bounded sample; every vector is sent through all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.llm.blocks import link_rows
from contestry.llm.components import block_pairs, connected_components
from contestry.session import cut_lineage

#: Trees; vectors that fit them at most; distance to a cut within which a vector takes both sides.
TREES, SAMPLE, MARGIN = 4, 20_000, 0.02
#: Vectors of a leaf, about; sampled vectors below which a cut goes through their mean instead.
LEAF, LEAST_SAMPLE = 256, 16
#: A cut that would send more than this share to both sides is not made.
MOST_SPILL, TRIES = 0.35, 12
BLOCK = 1024
#: Numbers of trees stay below this, so that leaves of all trees and dimensions differ.
TREES_MOST = 1 << 10


class Tree:
    """Recursive random cuts: arrays of directions, offsets and children by node."""

    def __init__(self, points: np.ndarray, depth: int, draw: np.random.Generator, margin: float):
        self.directions, self.offsets, self.children, self.margin = [], [], [], margin
        self._grow(points, depth, draw)
        self.directions, self.offsets = np.array(self.directions), np.array(self.offsets)

    def _grow(self, points: np.ndarray, depth: int, draw: np.random.Generator) -> int:
        node = len(self.children)
        self.children.append(None)
        self.directions.append(np.zeros(points.shape[1]))
        self.offsets.append(0.0)
        if depth <= 0 or not len(points):
            return node
        best = None
        for _ in range(TRIES):
            direction = draw.standard_normal(points.shape[1])
            direction /= np.linalg.norm(direction)
            along = points @ direction
            shares = [0.35, 0.5, 0.65] if len(points) >= LEAST_SAMPLE else []
            for offset in [*np.quantile(along, shares), along.mean()]:
                spill = float((np.abs(along - offset) <= self.margin).mean())
                side = float((along <= offset).mean())
                # Few on both sides, and no side nearly empty.
                cost = spill + (0.0 if 0.2 <= side <= 0.8 or len(points) < LEAST_SAMPLE else 1.0)
                if best is None or cost < best[0]:
                    best = (cost, direction, offset, along)
        cost, direction, offset, along = best
        if cost > MOST_SPILL and len(points) >= 2:
            return node
        self.directions[node], self.offsets[node] = direction, offset
        left = self._grow(points[along <= offset + self.margin], depth - 1, draw)
        right = self._grow(points[along >= offset - self.margin], depth - 1, draw)
        self.children[node] = (left, right)
        return node

    def leaves(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places of its points) for all points."""
        open_ = [(0, np.arange(len(points)))]
        while open_:
            node, places = open_.pop()
            if not len(places):
                continue
            if self.children[node] is None:
                yield node, places
                continue
            along = points[places] @ self.directions[node] - self.offsets[node]
            left, right = self.children[node]
            open_ += [(left, places[along <= self.margin]), (right, places[along >= -self.margin])]


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite parts and with a length above zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_trees(vectors: DataFrame, count: int, trees: int = TREES, leaf: int = LEAF, seed: int = 1) -> dict[int, list[Tree]]:
    """Trees by dimension from at most about SAMPLE unit vectors, grown so deep that ``count``
    vectors spread evenly would leave ``leaf`` in each leaf."""
    share = min(1.0, SAMPLE / max(count, 1))
    draw_ = F.pmod(F.xxhash64("_rep", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = vectors.where(draw_ < share).select("_vector").toPandas()["_vector"]
    by: dict[int, list[np.ndarray]] = {}
    for v in rows:
        by.setdefault(len(v), []).append(np.asarray(v, float))
    depth = max(0, int(np.ceil(np.log2(max(count, 1) / leaf))))
    out = {}
    for dimension, points in by.items():
        points = np.array(points)
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        draw = np.random.default_rng([seed, dimension])
        out[dimension] = [Tree(points, depth, draw, MARGIN) for _ in range(trees)]
    return out


def _compare(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links between two blocks of a leaf; a link is counted in the first leaf both are in."""
    leaf, two = int(frame["_leaf"].iat[0]), int(frame["_b1"].iat[0]) != int(frame["_b2"].iat[0])
    vectors = np.stack([np.asarray(v, float) for v in frame["_vector"]])
    length = np.linalg.norm(vectors, axis=1)
    linked = (vectors @ vectors.T) / np.outer(length, length) >= cosine
    np.fill_diagonal(linked, False)
    own = frame["_own"].to_numpy()
    if two:  # rows of one block meet in that block's own pair
        linked &= own[:, None] != own[None, :]
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return link_rows(np.array([], np.int64), np.array([]), np.zeros((0, 0)), np.zeros((0, 0), bool))
    linked = linked[np.ix_(some, some)]
    earlier = [[x for x in frame["_leaves"].iat[i] if x < leaf] for i in some]
    number = {x: k for k, x in enumerate(sorted({x for xs in earlier for x in xs}))}
    counted = linked
    if number:
        inside = np.zeros((len(some), len(number)), np.float32)
        for i, xs in enumerate(earlier):
            inside[i, [number[x] for x in xs]] = 1
        counted = linked & ~((inside @ inside.T) > 0)
    ids, weight = frame["_rep"].to_numpy()[some], frame["_copies"].to_numpy()[some].astype(float)
    return link_rows(ids, weight, counted.astype(float), linked)


def near_vectors(
    embeddings: DataFrame,
    cosine: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    leaf: int = LEAF,
    block: int = BLOCK,
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Vectors meet that share a leaf of any tree, so a few links may be missed (the README has
    the recall), but none below ``cosine`` is made. Vectors that are null, zero or hold null or
    non-finite parts link with nothing, and neither do rows with a null id, whose component is
    null. Only vectors of one dimension are compared. Equal vectors are one while comparing
    and count as all their rows in ``n_links``; so do repeated rows. Different vectors
    with one id share their links. An empty table gives no rows; other columns are not read.

    Leaves larger than ``block``, such as a tight group that no cut can split, are compared in
    pairs of blocks; tasks return counts and a spanning forest, never pairs.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_vector"))
    good = rows.where(usable(F.col("_vector")) & F.col("_id").isNotNull())
    reps = cut_lineage(good.groupBy("_vector").agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies")))
    fitted = fit_trees(reps, reps.count(), trees, leaf)
    shared = embeddings.sparkSession.sparkContext.broadcast(fitted)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(0).to_pylist()
            leaves: list[list[int]] = [[] for _ in vectors]
            for dimension in {len(v) for v in vectors}:
                places = np.array([i for i, v in enumerate(vectors) if len(v) == dimension])
                points = np.array([vectors[i] for i in places], float)
                points /= np.linalg.norm(points, axis=1, keepdims=True)
                for t, tree in enumerate(shared.value.get(dimension, ())):
                    for node, found in tree.leaves(points):
                        for i in places[found].tolist():
                            leaves[i].append(((dimension * TREES_MOST) + t << 32) + node)
            whole = [sorted(x) or [-len(v)] for x, v in zip(leaves, vectors, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(whole, pa.list_(pa.int64()))],
                names=["_vector", "_rep", "_copies", "_leaves"],
            )

    schema = "_vector array<double>, _rep long, _copies long, _leaves array<long>"
    placed = reps.select("_vector", "_rep", "_copies").mapInArrow(routed, schema)
    each = placed.withColumn("_leaf", F.explode("_leaves"))
    dealt = block_pairs(each, "_leaf", "_rep", block)
    told = cut_lineage(
        dealt.groupBy("_leaf", "_b1", "_b2").applyInPandas(lambda f: _compare(f, cosine), "id long, to long, n long")
    )
    links = told.where("to IS NULL").groupBy(F.col("id").alias("_rep")).agg(F.sum("n").alias("_links"))
    parts = connected_components(told.where("to IS NOT NULL"), "id", "to")
    groups = reps.join(links, "_rep", "left").join(parts.withColumnRenamed("node", "_rep"), "_rep", "left")
    groups = groups.select("_vector", "_copies", "_links", F.coalesce("component", "_rep").alias("_component"))
    own = F.col("_id").isNotNull() & usable(F.col("_vector"))
    key = F.when(own, F.col("_vector"))
    joined = rows.withColumn("_key", key).join(groups.withColumnRenamed("_vector", "_key"), "_key", "left")
    return joined.select(
        F.col("_id").alias(id_col),
        (F.coalesce("_links", F.lit(0)) + F.coalesce(F.col("_copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("_component", "_id").alias("component_id"),
        F.col("_id").eqNullSafe(F.coalesce("_component", "_id")).alias("kept"),
    )
