"""Labels derived from a pair of scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contestry.schemas import CLASSES, DRAW, DRAW_POINTS, TEAM_A_WIN, TEAM_B_WIN, WIN_POINTS


def by_outcome(first: Column, second: Column, win, level, loss) -> Column:
    """One of three values, by comparing two scores. Null if either score is null."""
    return (
        F.when(first > second, F.lit(win))
        .when(first < second, F.lit(loss))
        .when(first == second, F.lit(level))
    )


def result_label(home: Column, away: Column) -> Column:
    """H, D or A from the home side's view (P5)."""
    return by_outcome(home, away, "H", "D", "A")


def team_a_result(a: Column, b: Column) -> Column:
    """win, draw or loss of side A."""
    return by_outcome(a, b, "win", "draw", "loss")


def target_class(a: Column, b: Column) -> Column:
    """The three-class target."""
    return by_outcome(a, b, TEAM_A_WIN, DRAW, TEAM_B_WIN)


def points(scored: Column, conceded: Column) -> Column:
    """League points of the side that scored ``scored``."""
    return by_outcome(scored, conceded, WIN_POINTS, DRAW_POINTS, 0)


def class_index(target: Column) -> Column:
    """0, 1 or 2 in class order; null for any other label."""
    expr = F.lit(None).cast("int")
    for i, name in enumerate(CLASSES):
        expr = F.when(target == name, F.lit(i)).otherwise(expr)
    return expr


def parse_day(text: Column) -> Column:
    """Year-month-day text to DATE, null when it does not parse.

    One-digit months and days are accepted, trailing text is not.
    """
    return F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date")


def parse_flag(value: Column) -> Column:
    """true/false/1/0 in any case and padding to BOOLEAN, null otherwise."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False))
