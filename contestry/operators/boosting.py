"""Gradient boosting of three-class outcomes on histograms (M2).

All classes share one softmax: a round adds one small tree per class, fitted to the same
gradients. Rows are binned once, those alike in class and all bins become one with a count, and
written; a level of all trees of a round is one grouped sum over (class, node, input, bin), whose
size depends on inputs and bins but not on rows. Tasks sum with numpy, over blocks of rows that are
kept from job to job. A missing value takes the side that gains more, and leaves are shrunk by an L2
penalty. Scoring takes whole columns through the trees with numpy.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from contestry.functions.probability import clip_normalize, keyed_uniform
from contestry.operators.scoring import with_label_index
from contestry.schemas import CLASSES, PROBABILITIES, DataQualityError
from contestry.session import cut_lineage

#: Rounds whose trees are pending before the margins of the blocks include them, and how many times
#: that is done without writing the rows with their margins after the first time.
ROUNDS_A_MOVE, MOVES_A_WRITE = 10, 10
#: A leaf needs so many rows, and a split so much gain.
LEAF_ROWS, LEAST_GAIN = 20, 1e-7
#: Rounds without a better held-out loss after which boosting stops.
PATIENCE = 10
#: Rows that are worth a task, and the tasks whose histograms are added without a shuffle.
ROWS_A_TASK, FEW_TASKS = 20_000, 16
#: The cut of a split that sends no known value to the right.
NO_CUT = float(np.finfo(float).max)


def _walker(depth: int):
    """A function of a tree, the values of each input, and where they are missing (None: nowhere): the
    place among the nodes of a level that each row reaches. Node i has the children 2i + 1 and 2i + 2.

    Nested, so that a worker needs no package.
    """

    def walk(tree: tuple, own: Sequence[np.ndarray], absent: Sequence, levels: int = depth) -> np.ndarray:
        inputs, cuts, missing_right = tree[:3]

        def turns_right(node: int):
            """Whether rows at a node go right; None where no row does."""
            if cuts[node] is None and not missing_right[node]:
                return None
            i = inputs[node]
            right = None if cuts[node] is None else own[i] > cuts[node]
            if missing_right[node] and absent[i] is not None:
                right = absent[i] if right is None else right | absent[i]
            return right

        def below(node: int, after: int):
            """Whether rows at a node go right so many levels later."""
            here = turns[node]
            if not after:
                return here
            left = below(2 * node + 1, after - 1)
            if here is None:
                return left
            right = below(2 * node + 2, after - 1)
            if left is None or right is None:
                return left if right is left else here & right if left is None else left & ~here
            return left ^ (here & (left ^ right))

        turns = [turns_right(node) for node in range(2**levels - 1)]
        place = np.zeros(len(own[0]), np.uint8 if levels < 8 else np.int64)
        for level in range(levels):
            place <<= 1
            right = below(0, level)
            if right is not None:
                place |= right
        return place

    return walk


def _columns_of(tree: dict, cut_of) -> tuple:
    """Inputs, cuts (None: nothing is above), missing goes right, and leaves of a tree."""
    splits = tree["splits"]
    return (
        [x["input"] for x in splits], [cut_of(x) for x in splits],
        [x["missing_right"] for x in splits], np.array(tree["leaves"], float),
    )


def _margins(start: Sequence[float], trees: Sequence[Sequence[dict]], depth: int):
    """The margins of a row, as a function of its inputs; NaN is missing like null."""
    walk = _walker(depth)
    # No cut means no split; where the missing go right NO_CUT stays one, since infinity is above it.
    cut_of = lambda x: None if x["cut"] == NO_CUT and not x["missing_right"] else x["cut"]
    ready = [[_columns_of(tree, cut_of) for tree in own] for own in trees]

    @F.pandas_udf(", ".join(f"m{k} double" for k in range(len(start))))
    def margins(*columns: pd.Series) -> pd.DataFrame:
        own = [c.to_numpy(np.float64) for c in columns]
        absent = [np.isnan(x) for x in own]
        absent = [x if x.any() else None for x in absent]
        out = [np.full(len(own[0]), s) for s in start]
        for total, several in zip(out, ready):
            for tree in several:
                total += tree[3][walk(tree, own, absent)]
        return pd.DataFrame({f"m{k}": total for k, total in enumerate(out)})

    return margins


def _softmax(margins: Sequence[Column]) -> list[Column]:
    top = F.greatest(*margins) if len(margins) > 1 else margins[0]
    parts = [F.exp(m - top) for m in margins]
    return [p / sum(parts[1:], parts[0]) for p in parts]


@dataclass
class BoostedModel:
    """One list of trees for each class that was seen, over shared margins."""

    features: list[str]
    depth: int
    seen: list[int]
    start: list[float]
    trees: list[list[dict]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the three probability columns; a class never seen has none."""
        kept = [c for c in df.columns if c not in PROBABILITIES]
        grown = _margins(self.start, self.trees, self.depth)
        out = df.select(*kept).withColumn("_margins", grown(*[F.col(f"`{f}`").cast("double") for f in self.features]))
        share = dict(zip(self.seen, _softmax([F.col("_margins")[f"m{i}"] for i in range(len(self.seen))])))
        parts = clip_normalize([share.get(k, F.lit(0.0)) for k in range(len(CLASSES))])
        return out.withColumns(dict(zip(PROBABILITIES, parts))).select(*kept, *PROBABILITIES)


def _binned(cuts: Sequence[Sequence[float]], schema: pa.Schema):
    """Rows of ``_x`` with the bin of each input instead: how many cuts lie below it."""
    edges = [np.array(known, float) for known in cuts]

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(c) for c in ("_class", "_held_out")]
            found = np.empty((batch.num_rows, len(edges)), np.int32)
            for i, known in enumerate(edges):
                value = batch.column(f"_v{i}").to_numpy(zero_copy_only=False)  # null reads as NaN
                found[:, i] = np.where(np.isnan(value), -1, np.searchsorted(known, value))
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(edges)
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(offsets, found.ravel())], schema=schema)

    return bins


def _best_split(cells: dict[int, np.ndarray], l2: float) -> tuple | None:
    """(gain, input, bin, missing goes right) of the best split of one node.

    ``cells`` holds for each input the sums (gradient, curvature, rows) by bin, and those of the
    missing values in the last row.
    """
    best = None
    for i, sums in sorted(cells.items()):
        total = sums.sum(axis=0)
        base = total[0] ** 2 / (total[1] + l2)
        below = np.cumsum(sums[:-1], axis=0)
        for right in (False, True):
            if right and not sums[-1][2]:
                continue  # nothing is missing, so both sides are one
            left = below if right else below + sums[-1]
            rest = total - left
            gain = left[:, 0] ** 2 / (left[:, 1] + l2) + rest[:, 0] ** 2 / (rest[:, 1] + l2) - base
            gain[(left[:, 2] < LEAF_ROWS) | (rest[:, 2] < LEAF_ROWS)] = -math.inf
            at = int(gain.argmax())
            if gain[at] > max(LEAST_GAIN, best[0] if best else 0.0):
                best = (float(gain[at]), i, at, right, left[at], rest[at])
    return best


def _reader(cuts: Sequence[Sequence[float]], n_classes: int, depth: int):
    """Functions of rows: the blocks of a batch, and margins with further trees.

    Nested, so that a worker needs no package. A block holds class, held out, count, the bins of
    each input and the margins. A tree splits at a cut, hence between two bins.
    """
    walk = _walker(depth)

    def by_bins(tree: dict) -> tuple:
        def cut_of(split: dict):
            at = bisect_left(cuts[split["input"]], split["cut"])
            return at if at < len(cuts[split["input"]]) else None

        return _columns_of(tree, cut_of)

    def block_of(batch: pa.RecordBatch) -> tuple:
        bins = batch.column("_b").flatten().to_numpy().reshape(batch.num_rows, len(cuts))
        margins = [batch.column(f"_m{k}").to_numpy() for k in range(n_classes)]
        held = batch.column("_held_out").to_numpy(zero_copy_only=False)
        own, many = (batch.column(c).to_numpy() for c in ("_class", "_w"))
        return own, held, many, np.ascontiguousarray(bins.T), np.array(margins)

    def absent_of(bins: np.ndarray) -> list:
        return [x if x.any() else None for x in bins < 0]

    def margins_of(block: tuple, pending: list) -> np.ndarray:
        bins, out = block[3], np.array(block[4])
        absent = absent_of(bins)
        for total, own in zip(out, pending):
            for tree in own:
                total += tree[3][walk(tree, bins, absent)]
        return out

    def places_of(block: tuple, tree: tuple, level: int) -> np.ndarray:
        """Which node of a level a row reaches, counted from 0."""
        return walk(tree, block[3], absent_of(block[3]), level).astype(np.int64)

    return by_bins, block_of, margins_of, places_of


def _blocks(table: DataFrame, reader) -> RDD:
    """The rows as blocks of numpy arrays, kept from job to job.

    The jobs of a fit are many and short: planning a query for each took longer than its sums. A
    block that is lost is made again from the written table.
    """
    _, block_of, _, _ = reader

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block_of(batch))], pa.binary())], ["block"])

    blocks = table.mapInArrow(packed, "block binary").rdd.map(lambda row: pickle.loads(row[0]))
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)


def _advanced(blocks: RDD, reader, trees: Sequence[Sequence[dict]]) -> RDD:
    """The blocks with margins that include the given trees of each class."""
    by_bins, _, margins_of, _ = reader
    pending = [[by_bins(t) for t in own] for own in trees]
    moved = blocks.map(lambda block: (*block[:4], margins_of(block, pending)))
    return moved.persist(StorageLevel.MEMORY_AND_DISK)


def _moved(reader, trees: Sequence[Sequence[dict]], schema: pa.Schema):
    """The rows with margins that include the given trees of each class."""
    by_bins, block_of, margins_of, _ = reader
    pending = [[by_bins(t) for t in own] for own in trees]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = margins_of(block_of(batch), pending)
            kept = [batch.column(c) for c in schema.names[: -len(margins)]]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, margins)], schema=schema)

    return move


def _slopes(reader, trees: Sequence[Sequence[dict]], grown: Sequence[dict], level: int, sizes: Sequence[int]):
    """Sums over the blocks of a task: the held-out loss and its rows, then for each class and input
    gradient, curvature and rows by (node, bin), the missing last; all in one array.

    Gradient and curvature are those of the log loss; a row stands for as many rows alike.
    """
    by_bins, _, margins_of, places_of = reader
    pending, growing = [[by_bins(t) for t in own] for own in trees], [by_bins(t) for t in grown]
    nodes = 2**level

    def total(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
        sums = [[np.zeros((3, nodes * (n + 1))) for n in sizes] for _ in growing]
        loss = np.zeros(2)
        for block in blocks:
            margins = margins_of(block, pending)
            shares = np.exp(margins - margins.max(axis=0))
            shares /= shares.sum(axis=0)
            own, held, many, bins, _ = block
            if level == 0:
                lost = -np.log(np.maximum(shares[own, np.arange(len(own))], 1e-15)) * many
                loss += lost[held].sum(), many[held].sum()
            many = np.where(held, 0.0, many)
            slots = [np.where(b < 0, n, b) for b, n in zip(bins, sizes)]
            for k, tree in enumerate(growing):
                place, p = places_of(block, tree, level), shares[k]
                weights = ((p - (own == k)) * many, p * (1 - p) * many, many)
                for line, slot, n in zip(sums[k], slots, sizes):
                    cell = place * (n + 1) + slot
                    for part, weight in zip(line, weights):
                        part += np.bincount(cell, weight, len(part))
        yield np.concatenate([loss, *[line.ravel() for lines in sums for line in lines]])

    return total


def _blank(depth: int) -> dict:
    """A tree without splits: every row goes left, every leaf adds nothing."""
    split = {"input": 0, "cut": NO_CUT, "missing_right": False}
    return {"splits": [dict(split) for _ in range(2**depth - 1)], "leaves": [0.0] * 2**depth}


def _fill(tree: dict, node: int, depth: int, value: float) -> None:
    """Give every leaf below a node one value."""
    first, last = node, node
    while first < 2**depth - 1:
        first, last = 2 * first + 1, 2 * last + 2
    tree["leaves"][first - 2**depth + 1 : last - 2**depth + 2] = [value] * (last - first + 1)


def fit_boosted(
    train: DataFrame,
    features: Sequence[str],
    max_iter: int = 300,
    max_depth: int = 3,
    step: float = 0.05,
    l2: float = 1.0,
    bins: int = 255,
    seed: int = 42,
) -> BoostedModel:
    """Softmax boosting with early stopping on a tenth of the rows (M2).

    The held-out tenth is chosen by a hash of the row's id, so reruns choose the same rows; trees
    after the round of its least loss are left out. Rows without a label are not used. ``bins``
    bounds the cut points of an input, which are approximate quantiles of all rows.
    """
    rows = with_label_index(train).filter(F.col("label").isNotNull())
    held_out = keyed_uniform(seed, F.col("match_id")) < 0.1
    rows = cut_lineage(rows.select(
        *[F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double")).alias(f"_v{i}") for i, f in enumerate(features)],
        F.col("label").cast("int").alias("label"), F.coalesce(held_out, F.lit(False)).alias("_held_out"),
    ))
    counts = {r.label: r["count"] for r in rows.filter(~F.col("_held_out")).groupBy("label").count().collect()}
    if not counts:
        raise DataQualityError("no labelled rows to train on")
    seen, n = sorted(counts), sum(counts.values())
    start = [math.log(counts[k] / n) for k in seen]
    values = [f"_v{i}" for i in range(len(features))]
    found = rows.approxQuantile(values, [j / (bins + 1) for j in range(1, bins + 1)], 1 / (4 * (bins + 1)))
    cuts = [sorted(set(q)) for q in found]
    index = F.array_position(F.array(*map(F.lit, seen)), F.col("label")).cast("int") - 1
    rows = rows.filter(F.col("label").isin(seen)).select(index.alias("_class"), "_held_out", *values)
    # Trees split between bins only, so rows alike in all bins are one row that counts for many.
    alike = "_class int, _held_out boolean, _b array<int>"
    told = rows.mapInArrow(_binned(cuts, to_arrow_schema(T.StructType.fromDDL(alike))), alike)
    table = cut_lineage(told.groupBy("_class", "_held_out", "_b").agg(F.count(F.lit(1)).alias("_w")).select(
        "*", *[F.lit(s).alias(f"_m{k}") for k, s in enumerate(start)]
    ))
    tasks = -(-max(1, table.count()) // ROWS_A_TASK)
    table = table.coalesce(tasks)
    reader = _reader(cuts, len(seen), max_depth)
    blocks = _blocks(table, reader)
    trees: list[list[dict]] = [[] for _ in seen]
    least, best_round, moved, written, stale = math.inf, 0, 0, 0, None
    for turn in range(max_iter + 1):
        pending = [own[moved:] for own in trees]
        if turn - moved == ROUNDS_A_MOVE:
            stale = blocks
            if moved % (ROUNDS_A_MOVE * MOVES_A_WRITE) == 0:
                move = _moved(reader, [own[written:] for own in trees], to_arrow_schema(table.schema))
                table, written = cut_lineage(table.mapInArrow(move, table.schema)).coalesce(tasks), turn
                blocks = _blocks(table, reader)
            else:
                blocks = _advanced(blocks, reader, pending)
            pending, moved = [[] for _ in seen], turn
        loss, grown = _one_round(blocks, reader, pending, cuts, max_depth, step, l2)
        if stale is not None:
            stale, _ = None, stale.unpersist()
        if loss is not None:
            if loss < least - 1e-7:
                least, best_round = loss, turn
            elif turn - best_round >= PATIENCE:
                break
        else:
            best_round = turn
        if turn == max_iter or grown is None:
            break
        for own, tree in zip(trees, grown):
            own.append(tree)
    blocks.unpersist()
    return BoostedModel(list(features), max_depth, seen, start, [own[:best_round] for own in trees])


def _summed(parts: RDD) -> np.ndarray:
    """The sum of one array a task; the driver adds those of a few tasks."""
    if parts.getNumPartitions() > FEW_TASKS:
        return parts.treeReduce(lambda x, y: x + y)
    return np.sum(parts.collect(), axis=0)


def _one_round(blocks: RDD, reader, pending: Sequence[Sequence[dict]], cuts, depth: int, step: float, l2: float):
    """The held-out loss before the round (None: no such rows) and a tree per class.

    The trees are None where no class has a split left.
    """
    trees, loss, split_any = [_blank(depth) for _ in pending], None, False
    live, sizes = {(k, 0) for k in range(len(pending))}, [len(known) + 1 for known in cuts]
    for level in range(depth):
        found = _summed(blocks.mapPartitions(_slopes(reader, pending, trees, level, sizes)))
        if level == 0 and found[1]:
            loss = float(found[0] / found[1])
        nodes, at = 2**level, 2
        cells: dict[tuple, dict[int, np.ndarray]] = {own: {} for own in sorted(live)}
        for k in range(len(pending)):
            for i, n in enumerate(sizes):
                size = 3 * nodes * (n + 1)
                sums = found[at : at + size].reshape(3, nodes, n + 1)
                at += size
                for node in range(nodes):
                    own = cells.get((k, nodes - 1 + node))
                    if own is not None:
                        own[i] = sums[:, node].T  # the missing bin is the last row
        live = set()
        for (k, node), own in cells.items():
            best = _best_split(own, l2)
            if best is None:
                continue
            _, i, at, right, *sides = best
            cut = cuts[i][at] if at < len(cuts[i]) else NO_CUT
            trees[k]["splits"][node] = {"input": i, "cut": cut, "missing_right": right}
            for child, side in zip((2 * node + 1, 2 * node + 2), sides):
                _fill(trees[k], child, depth, float(-step * side[0] / (side[1] + l2)))
                live.add((k, child))
            split_any = True
        if not live:
            break
    return loss, trees if split_any else None
