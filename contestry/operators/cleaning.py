"""Raw results to the cleaned matches table (V6: P1-P5, P7, U2, W4, N4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.labels import parse_day, parse_flag, result_label
from contestry.operators.names import canonicalize
from contestry.operators.ordering import number_all
from contestry.operators.quality import broken, enforce, enforce_matches
from contestry.schemas import MATCHES_COLUMNS, RAW_RESULTS, require_columns

# Text tokens read as missing, and the non-competitive tournament.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
FRIENDLY = "Friendly"

_RAW = tuple(RAW_RESULTS.fieldNames())


def present(text: Column) -> Column:
    """The text, or null where it is a missing-value token."""
    return F.when(~text.isin(*MISSING_TOKENS), text)


def _score(name: str) -> Column:
    return F.expr(f"try_cast(`{name}` AS DOUBLE)")


def raw_problems(raw: DataFrame) -> DataFrame:
    """What would be lost by casting the raw text, as (check, n)."""
    rules = {"unparseable_date": F.count_if(parse_day("date").isNull() & F.col("date").isNotNull())}
    for c in ("home_score", "away_score"):
        value = _score(c)
        rules[f"{c}_not_a_number"] = F.count_if(value.isNull() & F.col(c).isNotNull())
        played = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
        rules[f"{c}_not_integral"] = F.count_if(played & (value % 1 != 0))
        rules[f"{c}_negative"] = F.count_if(played & (value < 0))
    rules["unparseable_neutral"] = F.count_if(played & parse_flag(F.col("neutral")).isNull())
    return broken(raw, rules)


def text_fields(raw: DataFrame) -> DataFrame:
    """The nine raw columns as text, missing tokens as null."""
    require_columns(raw, _RAW, "raw results")
    return raw.select(*[present(F.col(c).cast("string")).alias(c) for c in _RAW])


def typed_fields(raw: DataFrame) -> DataFrame:
    """The nine raw columns with date, scores and flag cast; what does not cast is null."""
    return text_fields(raw).withColumns(
        {
            "date": parse_day("date"),
            "home_score": _score("home_score"),
            "away_score": _score("away_score"),
            "neutral": parse_flag(F.col("neutral")),
        }
    )


def number_matches(raw: DataFrame) -> DataFrame:
    """Drop full-row duplicates and give every remaining row its id.

    Ids count from 0 in (date, home, away) order over played and unplayed rows alike; rows
    equal on that key are told apart by their other columns. Null dates sort last.
    """
    key = ["date", "home_team", "away_team"]
    order = [F.col(c).asc_nulls_last() for c in key + [c for c in _RAW if c not in key]]
    numbered = number_all(typed_fields(raw).dropDuplicates(), order, "match_id")
    return numbered.withColumn("match_id", F.col("match_id") - 1)


def split_unplayed(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Played rows and fixtures without a score."""
    played = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    return numbered.filter(played), numbered.filter(~played)


def typed_matches(played: DataFrame, aliases=None) -> DataFrame:
    """Cast, canonicalize and label numbered, played rows."""
    home, away = F.col("home_score"), F.col("away_score")
    cast = played.select(
        "match_id",
        "date",
        "home_team",
        "away_team",
        home.cast("smallint").alias("home_score"),
        away.cast("smallint").alias("away_score"),
        "neutral",
        F.trim("tournament").alias("tournament"),
        F.col("city").alias("venue_city"),
        F.col("country").alias("venue_country"),
    )
    named = canonicalize(cast, ["home_team", "away_team"], aliases)
    return named.withColumns(
        {
            "is_competitive": F.col("tournament") != FRIENDLY,
            "result": result_label(home, away),
            "home_win": home > away,
            "draw": home == away,
            "away_win": home < away,
            "total_goals": (home + away).cast("smallint"),
            "goal_diff": (home - away).cast("smallint"),
        }
    ).select(*MATCHES_COLUMNS)


def clean_matches(
    raw: DataFrame, *, aliases=None, max_date: str | None = None, strict: bool = True
) -> DataFrame:
    """The cleaned matches table of played rows.

    ``strict`` raises on bad raw values, and with ``max_date`` also runs the full check of
    the result. Without it bad values become null.
    """
    if strict:
        enforce(raw_problems(text_fields(raw)), "raw results")
    played, _ = split_unplayed(number_matches(raw))
    matches = typed_matches(played, aliases)
    if strict and max_date is not None:
        enforce_matches(matches, max_date=max_date, aliases=aliases)
    return matches
