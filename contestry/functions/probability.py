"""Probability-vector helpers and keyed draws, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from contestry.schemas import CLASSES, PROBABILITIES, PROBABILITY_FLOOR


def clip_normalize(parts: Sequence[Column], floor: float = PROBABILITY_FLOOR) -> list[Column]:
    """Lift each part to the floor, then divide by the row total."""
    lifted = [F.greatest(p, F.lit(floor)) for p in parts]
    total = reduce(lambda x, y: x + y, lifted)
    return [p / total for p in lifted]


def vector_in_class_order(vector: Column, seen: Sequence[int] = (0, 1, 2)) -> list[Column]:
    """Class probabilities in fixed order; a class the model never saw gets 0.

    ``vector`` is an array indexed by label index, ``seen`` the label indexes it covers.
    """
    return [
        F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0)) if i in seen else F.lit(0.0)
        for i in range(len(CLASSES))
    ]


def top_label(parts: Sequence[Column] | None = None) -> Column:
    """The most likely class; the first class in order wins ties."""
    a, d, b = parts or [F.col(c) for c in PROBABILITIES]
    return (
        F.when((a >= d) & (a >= b), F.lit(CLASSES[0]))
        .when(d >= b, F.lit(CLASSES[1]))
        .otherwise(F.lit(CLASSES[2]))
    )


def advance_probability(p_a: Column, p_draw: Column, p_b: Column) -> Column:
    """Chance that side A goes through when a draw is not possible."""
    bad = (p_a < 0) | (p_draw < 0) | (p_b < 0)
    return (
        F.when(bad, F.raise_error(F.lit("negative probability")))
        .when(p_a + p_b <= 0, F.lit(0.5))
        .otherwise(p_a / (p_a + p_b))
    )


def bin_edges(n_bins: int) -> list[float]:
    """``n_bins + 1`` equally spaced edges from 0 to 1."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def bin_index(p: Column, n_bins: int = 10) -> Column:
    """Index of the ``(lo, hi]`` bin; the last bin has no upper limit, 0 has no bin."""
    above = reduce(lambda x, y: x + y, [(p > e).cast("int") for e in bin_edges(n_bins)[:-1]])
    return F.when(above > 0, above - 1)


def keyed_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends only on the seed and the row's own key.

    Partitioning, retries and engine do not change it, unlike ``rand()``. A null key counts as
    a key of its own.
    """
    named = [F.coalesce(k.cast("string"), F.lit("\\N")) for k in keys]
    text = F.concat_ws("|", F.lit(str(seed)), *named)
    head = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return head / F.lit(4503599627370496.0)


def drawn_class(uniform: Column, parts: Sequence[Column] | None = None) -> Column:
    """One of the three classes, drawn with the given weights."""
    a, d, b = parts or [F.col(c) for c in PROBABILITIES]
    total = a + d + b
    bad = (a < 0) | (d < 0) | (b < 0) | (total <= 0)
    return (
        F.when(bad, F.raise_error(F.lit("weights must be non-negative with a positive sum")))
        .when(uniform < a / total, F.lit(CLASSES[0]))
        .when(uniform < (a + d) / total, F.lit(CLASSES[1]))
        .otherwise(F.lit(CLASSES[2]))
    )


def drawn_winner(uniform: Column, first: Column, second: Column, p_first: Column) -> Column:
    """The first or the second side, the first with probability ``p_first``."""
    bad = (p_first < 0) | (p_first > 1)
    return (
        F.when(bad, F.raise_error(F.lit("win probability outside [0, 1]")))
        .when(uniform < p_first, first)
        .otherwise(second)
    )
