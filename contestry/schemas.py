"""Table schemas, class vocabularies and default parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Class vocabulary in scoring order. Argmax ties resolve to the first class.
TEAM_A_WIN = "team_a_win"
DRAW = "draw"
TEAM_B_WIN = "team_b_win"
CLASSES = (TEAM_A_WIN, DRAW, TEAM_B_WIN)
PROBABILITIES = tuple(f"p_{c}" for c in CLASSES)

# Rating parameters. The forecast scale is not the rating scale.
ELO_BASE = 1500.0
ELO_K = 32.0
ELO_HOME = 65.0
ELO_SCALE = 400.0
STRENGTH_SCALE = 100.0
STRENGTH_DRAW_RATE = 0.22
STRENGTH_EXPONENT_LIMIT = 50.0

# Points per result and the probability floors.
WIN_POINTS = 3
DRAW_POINTS = 1
PROBABILITY_FLOOR = 1e-12
LOG_LOSS_FLOOR = 1e-15

# Fixed value: earliest date a result can carry.
EARLIEST_DATE = "1872-01-01"

# Fixed values, from here to STAGES: names of columns, classes and features that tables and
# stored files share with other tools, in their order.

# Raw results are read as text so that missing-value tokens and bad casts stay visible.
RAW_RESULTS = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "date",
            "home_team",
            "away_team",
            "home_score",
            "away_score",
            "tournament",
            "city",
            "country",
            "neutral",
        )
    ]
)

RAW_RANKINGS = T.StructType(
    [
        T.StructField("team", T.StringType()),
        T.StructField("rank_date", T.StringType()),
        T.StructField("rank", T.StringType()),
        T.StructField("points", T.StringType()),
    ]
)

RAW_ELO = T.StructType(
    [
        T.StructField("team", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("elo", T.StringType()),
    ]
)

STRENGTHS = T.StructType(
    [T.StructField("team", T.StringType()), T.StructField("strength", T.DoubleType())]
)

MATCHES_COLUMNS = (
    "match_id",
    "date",
    "home_team",
    "away_team",
    "home_score",
    "away_score",
    "neutral",
    "tournament",
    "is_competitive",
    "result",
    "home_win",
    "draw",
    "away_win",
    "total_goals",
    "goal_diff",
    "venue_city",
    "venue_country",
)

MATCHES_REQUIRED = (
    "match_id",
    "date",
    "home_team",
    "away_team",
    "home_score",
    "away_score",
    "neutral",
    "result",
)

DATASET_COLUMNS = (
    "match_id",
    "date",
    "team_a",
    "team_b",
    "team_a_score",
    "team_b_score",
    "team_a_result",
    "target_class",
    "is_neutral",
    "is_team_a_home",
    "tournament",
    "host_country",
)

LABEL_COLUMNS = ("team_a_score", "team_b_score", "team_a_result", "target_class")

FORM_WIDTHS = (5, 10)

TEAM_FEATURES = (
    "last_5_points_per_match",
    "last_10_points_per_match",
    "last_5_goals_for_avg",
    "last_10_goals_for_avg",
    "last_5_goals_against_avg",
    "last_10_goals_against_avg",
    "last_5_goal_diff_avg",
    "last_10_goal_diff_avg",
    "days_since_last_match",
    "matches_played_last_365_days",
)

# Difference column -> the per-team feature it subtracts (side a minus side b).
DIFFERENCES = {
    "form_5_diff": "last_5_points_per_match",
    "form_10_diff": "last_10_points_per_match",
    "goals_for_5_diff": "last_5_goals_for_avg",
    "goals_against_5_diff": "last_5_goals_against_avg",
    "goal_diff_10_diff": "last_10_goal_diff_avg",
    "rest_days_diff": "days_since_last_match",
}

FEATURE_CANDIDATES = (
    *DIFFERENCES,
    "elo_diff",
    "fifa_points_diff",
    "fifa_rank_diff",
    "is_team_a_home",
    "is_neutral",
)

NEVER_FEATURES = frozenset(
    {"match_id", "date", "team_a", "team_b", "tournament", "host_country", *LABEL_COLUMNS}
)

# Stage of an outcomes table -> output column, outermost stage first.
STAGES = {
    "win_group": "win_group_probability",
    "reach_round_32": "reach_round_32_probability",
    "reach_round_16": "reach_round_16_probability",
    "reach_quarterfinal": "reach_quarterfinal_probability",
    "reach_semifinal": "reach_semifinal_probability",
    "reach_final": "reach_final_probability",
    "champion": "win_title_probability",
}


class DataQualityError(ValueError):
    """A table breaks one or more rules; the message lists every broken rule."""


class LeakageError(DataQualityError):
    """A feature carries information dated after the contest it describes."""


def require_columns(df: DataFrame, columns, table: str) -> DataFrame:
    """Return ``df`` unchanged, or raise naming every absent column."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise DataQualityError(f"{table}: missing columns {absent}; found {df.columns}")
    return df
