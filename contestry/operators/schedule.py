"""Integrity of groups and fixtures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.session import cut_lineage


def check_schedule(
    groups: DataFrame,
    fixtures: DataFrame,
    keys: Sequence[str] = (),
    *,
    n_groups: int = 12,
    group_size: int = 4,
    total_teams: int = 48,
    advance_per_group: int = 2,
    thirds: int = 8,
    qualifiers: int = 32,
) -> DataFrame:
    """Broken rules as (keys, check, subject, n).

    ``groups`` has the keys, group and team; ``fixtures`` the keys, group, home and away. A
    competition without fixtures is only checked for its groups. Both tables are read once, for one
    table of memberships and appearances per (keys, group, team); every rule is a sum over it.
    """

    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    members = groups.select(*keys, "group", "team", one.alias("members"), none.alias("sides"), none.alias("same"))
    same = F.when(F.col("home") == F.col("away"), one).otherwise(none)
    sides = F.array(
        F.struct(F.col("home").alias("team"), same.alias("same")), F.struct(F.col("away").alias("team"), none.alias("same"))
    )
    played = fixtures.select(*keys, "group", F.inline(sides)).withColumns({"members": none, "sides": one})
    cells = members.unionByName(played).groupBy(*keys, "group", "team").agg(
        *[F.sum(c).alias(c) for c in ("members", "sides", "same")]
    )
    cells = cut_lineage(cells)
    stray = F.sum(F.when(F.col("members") == 0, F.col("sides")).otherwise(none))
    marks = cells.groupingSets([[*keys, "group"], [*keys, "team"]], *keys, "group", "team").agg(
        F.grouping("team").alias("of_group"), stray.alias("stray"),
        *[F.sum(c).alias(c) for c in ("members", "sides", "same")],
    )
    group, known = F.col("of_group") == 1, F.col("members") > 0
    in_parts = _broken([
        ("group_size", "group", "members", group & known & (F.col("members") != group_size)),
        ("duplicate_team", "team", "members", ~group & (F.col("members") > 1)),
        ("unknown_team", "team", "sides", ~group & ~known),
        ("identical_sides", "team", "same", ~group & (F.col("same") > 0)),
        ("outside_stated_group", "team", "stray", ~group & known & (F.col("stray") > 0)),
        ("fixture_count", "team", "sides", ~group & known & ~F.col("sides").isin(0, group_size - 1)),
    ])
    totals = marks.where(known).groupBy(*keys).agg(
        F.count_if(group).alias("groups"), F.count_if(~group).alias("teams")
    )
    totals = totals.withColumn("through", F.col("groups") * advance_per_group + thirds)
    in_all = _broken([
        ("group_count", None, "groups", F.col("groups") != n_groups),
        ("team_total", None, "teams", F.col("teams") != total_teams),
        ("qualifier_total", None, "through", F.col("through") != qualifiers),
    ])
    return marks.select(*keys, in_parts).unionByName(totals.select(*keys, in_all))


def _broken(rules: Sequence[tuple[str, str | None, str, Column]]) -> Column:
    """One row (check, subject, n) for every rule that a row breaks; ``*`` stands for the whole."""
    rows = [
        F.when(broken, F.struct(
            F.lit(check).alias("check"),
            (F.col(subject).cast("string") if subject else F.lit("*")).alias("subject"),
            F.col(n).cast("bigint").alias("n"),
        ))
        for check, subject, n, broken in rules
    ]
    return F.inline(F.array_compact(F.array(*rows)))
