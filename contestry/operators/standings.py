"""Standings, ranking with tie-breaks, qualifiers and bracket tables.

Covers A12, A13, W6, W7, K2, K3, K6, K7, J7. Every function takes ``keys``, the columns that
tell one competition from another (tournament, replicate), so any number of them is handled
by the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.probability import keyed_uniform
from contestry.operators.ordering import MAX_GROUP_ROWS, number_rows, top_rows
from contestry.operators.reshape import team_long
from contestry.schemas import DRAW_POINTS, WIN_POINTS, DataQualityError

RECORD = ("played", "won", "drawn", "lost", "goals_for", "goals_against")


def _record() -> list[Column]:
    scored, conceded = F.col("goals_for"), F.col("goals_against")
    return [
        F.count(F.lit(1)).alias("played"),
        F.count_if(scored > conceded).alias("won"),
        F.count_if(scored == conceded).alias("drawn"),
        F.count_if(scored < conceded).alias("lost"),
        F.sum(scored).alias("_for"),
        F.sum(conceded).alias("_against"),
    ]


def with_derived(record: DataFrame) -> DataFrame:
    """Add goal difference and points to a six-column record."""
    return record.withColumns(
        {
            "goal_difference": F.col("goals_for") - F.col("goals_against"),
            "points": WIN_POINTS * F.col("won") + DRAW_POINTS * F.col("drawn"),
        }
    )


def standings(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Record of every team that appears in the results, per key.

    The sums combine before the shuffle, so a team with most of the rows costs no more.
    """
    record = team_long(results, *keys).groupBy(*keys, "team").agg(*_record())
    return with_derived(
        record.withColumnsRenamed({"_for": "goals_for", "_against": "goals_against"})
    )


def group_table(members: DataFrame, results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Standings of every group member, zeros for one without a contest.

    ``members`` has the keys, ``group`` and ``team``; results count for the group their team
    is in.
    """
    played = standings(results, keys).drop("goal_difference", "points")
    joined = members.join(played, [*keys, "team"], "left").fillna(0, list(RECORD))
    return with_derived(joined)


def _best_first() -> list[Column]:
    return [F.desc("points"), F.desc("goal_difference"), F.desc("goals_for")]


def _ranking(keys: Sequence[str], seed: int | None) -> list[Column]:
    """Best first; what is still level goes by a lot if there is a seed, then by name."""
    drawn = [] if seed is None else [lot(seed, *keys, "team").asc()]
    return [*_best_first(), *drawn, F.asc("team")]


def lot(seed: int, *keys: str) -> Column:
    """A lot that depends on the seed and the row's own keys only."""
    return keyed_uniform(seed, *[F.col(k) for k in keys])


def rank_groups(
    table: DataFrame,
    keys: Sequence[str] = ("group",),
    seed: int | None = None,
    limit: int = MAX_GROUP_ROWS,
    name: str = "rank",
) -> DataFrame:
    """Rank by points, goal difference, goals for, then team name (W6) or a drawn lot."""
    return number_rows(table, list(keys), _ranking(keys, seed), name, limit)


def top_two(ranked: DataFrame, keys: Sequence[str] = ("group",), strict: bool = False) -> DataFrame:
    """Winner and runner-up of every group (K2); ``strict`` raises on a group of one."""
    chosen = ranked.filter(F.col("rank") <= 2)
    if strict:
        short = chosen.groupBy(*keys).count().filter(F.col("count") < 2).limit(1).collect()
        if short:
            raise DataQualityError(f"group with fewer than 2 teams: {short[0].asDict()}")
    return chosen


def best_thirds(
    ranked: DataFrame,
    keys: Sequence[str] = (),
    n: int = 8,
    seed: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """The best ``n`` third-placed teams across groups, in column ``third_rank`` (K3)."""
    thirds = ranked.filter(F.col("rank") == 3)
    out = top_rows(thirds, list(keys), _ranking(keys, seed), "third_rank", n)
    if strict:
        found = out.groupBy(*keys).count()
        short = found.filter(F.col("count") < n).limit(1).collect()
        if short or found.limit(1).count() == 0:
            raise DataQualityError(f"fewer than {n} third-placed teams")
    return out


def seeds(
    ranked: DataFrame,
    thirds: DataFrame,
    keys: Sequence[str] = (),
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Qualifiers in seeding order from 0: winners, runners-up, best thirds (K6)."""
    firsts = ranked.filter(F.col("rank") <= 2).select(
        *keys, "team", F.col("rank").alias("_tier"), F.col("group").cast("string").alias("_place"),
        F.lit(0).cast("bigint").alias("_n"),
    )
    rest = thirds.select(
        *keys, "team", F.lit(3).cast("bigint").alias("_tier"), F.lit("").alias("_place"),
        F.col("third_rank").alias("_n"),
    )
    order = [F.asc("_tier"), F.asc("_place"), F.asc("_n")]
    numbered = number_rows(firsts.unionByName(rest), list(keys), order, "seed", limit)
    return numbered.select(*keys, "team", (F.col("seed") - 1).alias("seed"))


def bracket_slots(seeded: DataFrame, size: int | None = 32) -> DataFrame:
    """Bracket slot of every seed: seed i meets seed size - 1 - i in pair i (K6).

    A short field leaves slots empty. A seed that ``size`` has no room for is an error when the
    rows are read; without a ``size`` the bracket is the next power of two that holds all.
    """
    if size is None:
        top = seeded.agg(F.max("seed")).first()[0] or 0
        size = 1 << max(1, int(top).bit_length())
    last = size - 1
    seed = F.when(F.col("seed").between(0, last), F.col("seed")).otherwise(
        F.raise_error(F.concat(F.lit(f"no room in a bracket of {size} for seed "), F.col("seed").cast("string")))
        .cast("bigint")
    )
    half = F.least(seed, F.lit(last) - seed)
    return seeded.withColumn("slot", 2 * half + (seed > half).cast("bigint"))


def seeding_problems(seeded: DataFrame, keys: Sequence[str] = (), size: int = 32) -> DataFrame:
    """Competitions whose seeding is not ``size`` different teams (K6)."""
    return (
        seeded.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_seeds"), F.count_distinct("team").alias("n_teams"))
        .filter((F.col("n_seeds") != size) | (F.col("n_teams") != size))
    )


def pairs_of(slots: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per pair of neighbouring slots: (keys, slot, team_a, team_b) (K7).

    The pair's slot is the slot its winner takes in the next round.
    """
    return slots.groupBy(*keys, F.expr("slot div 2").alias("slot")).agg(
        F.max(F.when(F.col("slot") % 2 == 0, F.col("team"))).alias("team_a"),
        F.max(F.when(F.col("slot") % 2 == 1, F.col("team"))).alias("team_b"),
    )


def slot_tokens(ranked: DataFrame, thirds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, token, team): 1X winner and 2X runner-up of group X, 3-n the n-th best third."""
    firsts = ranked.filter(F.col("rank") <= 2).select(
        *keys, F.concat(F.col("rank").cast("string"), F.col("group").cast("string")).alias("token"),
        "team",
    )
    rest = thirds.select(
        *keys, F.concat(F.lit("3-"), F.col("third_rank").cast("string")).alias("token"), "team"
    )
    return firsts.unionByName(rest)


def resolve_pairings(
    pairings: DataFrame, tokens: DataFrame, keys: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """Teams of configured pairings (keys, match, home, away tokens); unknown stays null."""
    out = pairings
    for side in ("home", "away"):
        named = tokens.select(
            *keys, F.col("token").alias(side), F.col("team").alias(f"{side}_team")
        )
        out = out.join(named, [*keys, side], "left")
    if strict:
        unknown = unknown_tokens(pairings, tokens, keys).limit(10).collect()
        if unknown:
            raise DataQualityError(f"unknown slot tokens: {[r.token for r in unknown]}")
    return out


def unknown_tokens(pairings: DataFrame, tokens: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Tokens of the pairings that name no slot."""
    used = pairings.select(*keys, F.explode(F.array("home", "away")).alias("token")).distinct()
    return used.join(tokens, [*keys, "token"], "left_anti")
