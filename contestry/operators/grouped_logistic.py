"""Logistic fits of many groups at once, by Newton steps whose sums Spark groups (M1, M8).

The objective is that of :func:`contestry.operators.models.fit_logistic`: the log loss of a
softmax over standardized features with nulls as 0, plus half the penalty times the squared
weights; intercepts are free. A step is one grouped aggregate over the rows, whatever the number
of groups: loss, gradient and Gram matrices come as arrays, one row per group, and only those
rows are solved. A group with one label learns its share.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.schemas import CLASSES, require_columns
from contestry.session import cut_lineage

# Most Newton steps, and the largest mean gradient that counts as none. A fit takes about eight.
MAX_STEPS = 40
TOLERANCE = 1e-8

_STATE = "loss double, gradient double, weights array<double>, best array<double>"


def _total(parts: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, parts)


def _filled(features: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]


def group_facts(rows: DataFrame, keys: Sequence[str], features: Sequence[str], n_classes: int, standardize: bool = True) -> DataFrame:
    """Rows, label counts, centres and scales of every group; a constant feature has scale 0."""
    filled = _filled(features)
    centre = [F.avg(x) if standardize else F.lit(0.0) for x in filled]
    spread = [F.coalesce(F.stddev_samp(x), F.lit(0.0)) if standardize else F.lit(1.0) for x in filled]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.count_if(F.col("label") == k) for k in range(n_classes)]).alias("counts"),
        F.array(*centre).alias("centre"),
        F.array(*spread).alias("spread"),
    )


def with_softmax(df: DataFrame, features: Sequence[str], n_classes: int, weights: str) -> DataFrame:
    """Add the standardized features ``_x0`` on and the class probabilities ``_p0`` on.

    ``df`` carries the facts of its group and the array ``weights``, class by class, each with its
    intercept last. A class without rows in the group has probability 0; without facts all are null.
    """
    m = len(features) + 1
    scaled = {}
    for i, x in enumerate(_filled(features)):
        scale = F.get("spread", F.lit(i))
        scaled[f"_x{i}"] = F.when(scale > 0, (x - F.get("centre", F.lit(i))) / scale).otherwise(F.lit(0.0))
    inputs = [*[F.col(x) for x in scaled], F.lit(1.0)]
    seen = [F.get("counts", F.lit(k)) > 0 for k in range(n_classes)]
    margins = {
        f"_z{k}": F.when(seen[k], _total([F.get(weights, F.lit(k * m + i)) * x for i, x in enumerate(inputs)]))
        for k in range(n_classes)
    }
    top = F.greatest(*margins)  # skips classes without rows
    powers = {f"_e{k}": F.when(seen[k], F.exp(F.col(z) - top)).otherwise(F.lit(0.0)) for k, z in enumerate(margins)}
    whole = F.when(F.col("n").isNotNull(), _total([F.col(e) for e in powers]))
    shares = {f"_p{k}": F.col(e) / whole for k, e in enumerate(powers)}
    return df.withColumns(scaled).withColumns(margins).withColumns(powers).withColumns(shares).drop(*margins, *powers)


def derivatives(rows: DataFrame, keys: Sequence[str], features: Sequence[str], n_classes: int) -> DataFrame:
    """Loss, gradient and Gram matrices of every group as one grouped aggregate.

    ``rows`` come from :func:`with_softmax`. The Gram part holds, for each two classes and each two
    inputs in order, the sum of their share of the second derivative; no penalty is in any of it.
    """
    inputs = [*[F.col(f"_x{i}") for i in range(len(features))], F.lit(1.0)]
    share = [F.col(f"_p{k}") for k in range(n_classes)]
    hit = [(F.col("label") == k).cast("double") for k in range(n_classes)]
    own = _total([p * y for p, y in zip(share, hit)])
    slope = [F.sum((share[k] - hit[k]) * x) for k in range(n_classes) for x in inputs]
    gram = [
        F.sum((share[k] * (1.0 - share[k]) if k == j else -share[k] * share[j]) * x * y)
        for k in range(n_classes)
        for j in range(k, n_classes)
        for a, x in enumerate(inputs)
        for y in inputs[a:]
    ]
    return rows.groupBy(*keys).agg(
        F.sum(-F.log(F.greatest(own, F.lit(1e-300)))).alias("_loss"),
        F.array(*slope).alias("_slope"),
        F.array(*gram).alias("_gram"),
    )


def _square(gram: np.ndarray, n_classes: int, m: int) -> np.ndarray:
    """The full symmetric matrix of the sums that :func:`derivatives` keeps once."""
    blocks = np.zeros((n_classes, m, n_classes, m))
    upper, size, at = np.triu_indices(m), m * (m + 1) // 2, 0
    for k in range(n_classes):
        for j in range(k, n_classes):
            block = np.zeros((m, m))
            block[upper] = gram[at : at + size]
            block = block + np.triu(block, 1).T
            blocks[k, :, j, :] = blocks[j, :, k, :] = block
            at += size
    return blocks.reshape(n_classes * m, n_classes * m)


def _newton(n_classes: int, m: int, penalty: float):
    """One step of one group: on from weights that lower the objective, else half the way back."""
    ridge = np.tile(np.append(np.full(m - 1, penalty), 0.0), n_classes)

    def move(loss, slope, gram, n, weights, best, best_loss, gradient):
        weights, best = np.asarray(weights), np.asarray(best)
        here = loss + 0.5 * float(ridge @ (weights * weights))
        if here > best_loss + 1e-12 * abs(best_loss):
            return best_loss, gradient, (weights + best) / 2.0, best
        down = np.asarray(slope) + ridge * weights
        full = _square(np.asarray(gram), n_classes, m) + np.diag(ridge)
        # The least step: adding one number to all intercepts changes nothing.
        step = np.linalg.lstsq(full, down, rcond=1e-12)[0]
        return here, float(np.abs(down).max()) / n, weights - step, weights

    @F.pandas_udf(_STATE)
    def solve(
        loss: pd.Series, slope: pd.Series, gram: pd.Series, n: pd.Series,
        weights: pd.Series, best: pd.Series, best_loss: pd.Series, gradient: pd.Series,
    ) -> pd.DataFrame:
        moved = [move(*row) for row in zip(loss, slope, gram, n, weights, best, best_loss, gradient)]
        return pd.DataFrame(moved, columns=["loss", "gradient", "weights", "best"])

    return solve


@dataclass
class GroupedLogistic:
    """One row per group: rows, label counts, centres, scales, weights and the gradient left."""

    table: DataFrame
    keys: list[str]
    features: list[str]
    n_classes: int
    penalty: float = 1.0

    def gradients(self, rows: DataFrame) -> DataFrame:
        """What is left of the penalized mean gradient, per group, class and input.

        ``class`` is the class name of three, else the index; ``n`` counts the group's rows.
        """
        facts = self.table.select(*self.keys, "n", "counts", "centre", "spread", "weights")
        rows = rows.where(F.col("label").isNotNull()).select(*self.keys, *self.features, "label")
        sums = derivatives(
            with_softmax(rows.join(facts, self.keys), self.features, self.n_classes, "weights"),
            self.keys, self.features, self.n_classes,
        ).join(facts, self.keys)
        names, m = [*self.features, "intercept"], len(self.features) + 1
        classes = CLASSES if self.n_classes == len(CLASSES) else [str(k) for k in range(self.n_classes)]
        cells = []
        for k, name in enumerate(classes):
            for i, label in enumerate(names):
                pull = self.penalty * F.get("weights", F.lit(k * m + i)) if i < m - 1 else F.lit(0.0)
                slope = (F.get("_slope", F.lit(k * m + i)) + pull) / F.col("n")
                cells.append(F.struct(F.lit(name).alias("class"), F.lit(label).alias("input"), slope.alias("gradient")))
        return sums.select(*self.keys, "n", F.inline(F.array(*cells)))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``_p0`` on, the class probabilities of each row's group; null without one."""
        facts = self.table.select(*self.keys, "n", "counts", "centre", "spread", "weights")
        scored = with_softmax(df.join(facts, self.keys, "left"), self.features, self.n_classes, "weights")
        return scored.select(*df.columns, *[f"_p{k}" for k in range(self.n_classes)])


def fit_grouped(
    rows: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    n_classes: int = 3,
    penalty: float = 1.0,
    standardize: bool = True,
    steps: int = MAX_STEPS,
) -> GroupedLogistic:
    """Fit every group of ``keys``; ``label`` is the class index, rows without one are not read.

    ``rows`` are read once for the facts and once per step, so a caller that repeats rows for
    several groups hands over the plan that repeats them and stores them once.
    """
    require_columns(rows, (*keys, *features, "label"), "rows")
    keys, features, m = list(keys), list(features), len(features) + 1
    rows = rows.where(F.col("label").isNotNull()).select(*keys, *features, "label")
    zeros = F.array_repeat(F.lit(0.0), n_classes * m)
    state = cut_lineage(
        group_facts(rows, keys, features, n_classes, standardize).select(
            "*", F.lit(float("inf")).alias("loss"), F.lit(float("inf")).alias("gradient"),
            zeros.alias("weights"), zeros.alias("best"),
        )
    )
    solve = _newton(n_classes, m, penalty)
    facts = [*keys, "n", "counts", "centre", "spread"]
    for _ in range(steps):
        here = with_softmax(rows.join(state.select(*facts, "weights"), keys), features, n_classes, "weights")
        sums = derivatives(here, keys, features, n_classes).join(state, keys)
        moved = solve("_loss", "_slope", "_gram", "n", "weights", "best", "loss", "gradient")
        state = cut_lineage(sums.withColumn("_moved", moved).select(*facts, "_moved.*"))
        left = state.agg(F.max("gradient")).first()[0]
        if left is None or left <= TOLERANCE:
            break
    return GroupedLogistic(state.drop("weights").withColumnRenamed("best", "weights"), keys, features, n_classes, penalty)
