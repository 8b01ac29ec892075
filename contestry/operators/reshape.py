"""From home/away matches to side A / side B rows, and to one row per team."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.functions.labels import points, target_class, team_a_result
from contestry.schemas import DATASET_COLUMNS, require_columns

# The columns of a matches table that the dataset is made from.
_NEEDED = (
    "match_id",
    "date",
    "home_team",
    "away_team",
    "home_score",
    "away_score",
    "neutral",
    "tournament",
)


def model_dataset(matches: DataFrame) -> DataFrame:
    """One A-versus-B row per match, A being the home side."""
    require_columns(matches, _NEEDED, "matches")
    host = next((c for c in ("venue_country", "country") if c in matches.columns), None)
    a, b = F.col("home_score"), F.col("away_score")
    return matches.select(
        "match_id",
        "date",
        F.col("home_team").alias("team_a"),
        F.col("away_team").alias("team_b"),
        a.alias("team_a_score"),
        b.alias("team_b_score"),
        team_a_result(a, b).alias("team_a_result"),
        target_class(a, b).alias("target_class"),
        F.col("neutral").alias("is_neutral"),
        (~F.col("neutral")).alias("is_team_a_home"),
        F.col("tournament").cast("string").alias("tournament"),
        (F.col(host) if host else F.lit(None).cast("string")).alias("host_country"),
    ).select(*DATASET_COLUMNS)


def team_long(dataset: DataFrame, *carried: str) -> DataFrame:
    """Two rows per contest, one per team, from a single scan.

    ``side`` tells which of the two the row is; ``carried`` columns are repeated on both.
    """
    require_columns(
        dataset, ("match_id", "date", "team_a", "team_b", "team_a_score", "team_b_score"), "dataset"
    )

    def row(side: str, scored: str, conceded: str):
        return F.struct(
            F.lit(side).alias("side"),
            F.col(f"team_{side}").alias("team"),
            F.col(scored).cast("int").alias("goals_for"),
            F.col(conceded).cast("int").alias("goals_against"),
        )

    both = F.array(
        row("a", "team_a_score", "team_b_score"), row("b", "team_b_score", "team_a_score")
    )
    scored, conceded = F.col("goals_for"), F.col("goals_against")
    return dataset.select("match_id", "date", *carried, F.inline(both)).select(
        "*",
        (scored - conceded).alias("goal_diff"),
        points(scored, conceded).alias("points"),
    )


def participants(dataset: DataFrame, *keys: str) -> DataFrame:
    """Each team that plays, once per key."""
    both = F.explode(F.array("team_a", "team_b")).alias("team")
    return dataset.select(*keys, both).distinct()
