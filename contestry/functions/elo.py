"""Rating arithmetic and strength forecasts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contestry.schemas import (
    ELO_HOME,
    ELO_K,
    ELO_SCALE,
    STRENGTH_DRAW_RATE,
    STRENGTH_EXPONENT_LIMIT,
    STRENGTH_SCALE,
)


def expected_score(rating: Column, opponent: Column, advantage: Column | float = ELO_HOME) -> Column:
    """Win expectancy of the first side (P10)."""
    bonus = advantage if isinstance(advantage, Column) else F.lit(float(advantage))
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (opponent - rating - bonus) / ELO_SCALE))


def updated_rating(rating: Column, expected: Column, actual: Column, k: float = ELO_K) -> Column:
    """Rating after one contest."""
    return rating + F.lit(float(k)) * (actual - expected)


def strength_probabilities(
    strength_a: Column,
    strength_b: Column,
    draw_rate: float = STRENGTH_DRAW_RATE,
    scale: float = STRENGTH_SCALE,
) -> tuple[Column, Column, Column]:
    """Three probabilities from two strengths; an unknown strength counts as 0."""
    if not 0.0 <= draw_rate < 1.0:
        raise ValueError(f"draw_rate must be in [0, 1), got {draw_rate}")
    gap = F.coalesce(strength_a, F.lit(0.0)) - F.coalesce(strength_b, F.lit(0.0))
    limit = F.lit(STRENGTH_EXPONENT_LIMIT)
    exponent = F.least(limit, F.greatest(-limit, -gap / F.lit(float(scale))))
    decided_a = 1.0 / (1.0 + F.pow(F.lit(10.0), exponent))
    decisive = F.lit(1.0 - draw_rate)
    return decisive * decided_a, F.lit(float(draw_rate)), decisive * (1.0 - decided_a)


def uniform_probabilities() -> tuple[Column, Column, Column]:
    """One third each."""
    third = F.lit(1.0 / 3.0)
    return third, third, third
