import pytest
from pyspark.sql import functions as F

from contestry.functions.elo import strength_probabilities, uniform_probabilities
from contestry.operators.advancement import (
    draw_outcomes,
    drawn_records,
    drawn_table,
    advancement_shares,
    contenders,
    play_round,
    replicate,
    stage_outcomes,
    summarize,
)
from contestry.schemas import PROBABILITIES, STAGES

GROUPS = "ABCDEFGHIJKL"
N = 30


@pytest.fixture(scope="module")
def field(spark):
    teams = [(g, f"{g}{i}", 40.0 * i) for g in GROUPS for i in range(4)]
    members = spark.createDataFrame(teams, "group string, team string, strength double")
    fixtures = [(k, f"{g}{i}", f"{g}{j}") for k, (g, i, j) in enumerate(
        (g, i, j) for g in GROUPS for i in range(4) for j in range(i))]
    return members.cache(), spark.createDataFrame(fixtures, "match_id int, team_a string, team_b string")


def forecast(members, fixtures):
    out = fixtures
    for s in "ab":
        out = out.join(members.select(F.col("team").alias(f"team_{s}"), F.col("strength").alias(s)), f"team_{s}")
    parts = strength_probabilities(F.col("a"), F.col("b"))
    return out.select("match_id", "team_a", "team_b", *[p.alias(n) for p, n in zip(parts, PROBABILITIES)])


@pytest.fixture(scope="module")
def shares(field):
    members, fixtures = field
    outcomes = stage_outcomes(
        members.select("group", "team"), forecast(members, fixtures),
        members.select("team", "strength"), replicates=N, seed=42,
    )
    return advancement_shares(outcomes, N, teams=members).cache()


def test_every_round_is_full(shares):
    totals = shares.agg(*[F.sum(c).alias(c) for c in STAGES.values()]).first()
    assert [round(totals[c], 9) for c in STAGES.values()] == [12, 32, 16, 8, 4, 2, 1]


def test_shares_fall_from_round_to_round(shares):
    assert shares.count() == 48
    for r in shares.collect():
        steps = [r[c] for c in list(STAGES.values())[1:]]
        assert all(0 <= x <= 1 for x in steps)
        assert steps == sorted(steps, reverse=True)
        assert r.win_group_probability <= r.reach_round_32_probability


def test_strength_pays(shares):
    by_level = shares.groupBy(F.substring("team", 2, 1).alias("level")).agg(F.sum("win_group_probability"))
    got = {r.level: r[1] for r in by_level.collect()}
    assert got["3"] > got["2"] > got["0"]


def test_summary_and_contenders(shares):
    s = summarize(shares).first()
    assert (s.n_teams, s.title_probability_total) == (48, 1.0)
    top = contenders(shares, n=5).orderBy("place").collect()
    assert s.contenders.split(",")[:5] == [r.team for r in top]
    assert len(top) == 5 and top[0].team == s.favourite
    titles = [r.win_title_probability for r in top]
    assert titles == sorted(titles, reverse=True)


def test_a_seed_fixes_the_outcome(field):
    members, fixtures = field
    flat = fixtures.select("*", *[p.alias(n) for p, n in zip(uniform_probabilities(), PROBABILITIES)])

    def run(f, seed):
        out = stage_outcomes(members.select("group", "team"), f, members.select("team", "strength"),
                             replicates=3, seed=seed)
        return sorted(tuple(r) for r in out.select("replicate", "team", "stage").collect())

    assert run(flat, 1) == run(flat.repartition(3), 1)
    assert run(flat, 1) != run(flat, 2)


def test_a_member_without_a_contest_stays(spark):
    members = spark.createDataFrame([("A", t, 0) for t in "abcd"], "group string, team string, replicate int")
    drawn = spark.createDataFrame(
        [("a", "b", "team_a_win", 0), ("a", "c", "draw", 0)],
        "team_a string, team_b string, outcome string, replicate int",
    )
    table = {r.team: (r.played, r.points) for r in drawn_table(members, drawn, ["replicate"]).collect()}
    assert table == {"a": (2, 4), "b": (1, 0), "c": (1, 1), "d": (0, 0)}


def test_a_bye_goes_through(spark):
    slots = spark.createDataFrame([(0, "A"), (3, "B")], "slot bigint, team string")
    strengths = spark.createDataFrame([("A", 1.0)], "team string, strength double")
    got = play_round(slots, strengths, [], 1, 0).collect()
    assert sorted((r.slot, r.team) for r in got) == [(0, "A"), (1, "B")]


def test_replicates_must_be_positive(spark):
    with pytest.raises(ValueError):
        replicate(spark.range(1), 0)


def test_records_drawn_at_the_teams_are_those_of_the_drawn_rows(spark, field):
    """Also with a team in pieces, ids of many lengths, and weights that are null or not a number."""
    members, fixtures = field
    f = forecast(members, fixtures).withColumn("match_id", F.pow(F.lit(7.0), F.col("match_id") % 20).cast("bigint") + F.col("match_id"))
    odd = F.when(F.col("team_a") == "A1", F.lit(None)).when(F.col("team_a") == "B1", F.lit(float("nan")))
    f = f.withColumn("p_draw", F.when(F.col("team_a").isin("A1", "B1"), odd).otherwise(F.col("p_draw")))
    f = f.withColumn("match_id", F.when(F.col("team_a") != "C1", F.col("match_id")))
    named = f.withColumn("match_id", F.concat(F.lit("long " * 12), F.col("match_id").cast("string")))
    teams = members.select("group", "team").unionByName(spark.createDataFrame([("A", "none")], "group string, team string"))
    for rows, limit, n in ((f, 10, 120), (f, 2, 11), (named, 10, 12)):
        rows = rows.unionByName(rows.withColumns({"team_a": F.lit("A0"), "team_b": F.lit("B0")}).limit(3))
        drawn = draw_outcomes(replicate(rows, n), 42, "replicate", "match_id")
        want = drawn_table(replicate(teams, n), drawn, ["replicate"])
        got = drawn_records(teams, rows, [], n, 42, limit).select(*want.columns)
        assert got.count() == want.count() == 49 * n
        assert got.exceptAll(want).count() == 0


def test_draws_are_no_rows_of_a_shuffle(spark, field):
    """What goes to the teams grows with the contests, not with contests times replicates."""
    members, fixtures = field
    plan = drawn_records(members.select("group", "team"), forecast(members, fixtures), [], 1000, 1)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text
    assert "Exchange" not in text[: text.index("Generate")]  # the copies come after the last shuffle


def test_a_contest_is_drawn_once(spark, field):
    """Its two sides part after the draws, not before."""
    members, fixtures = field
    plan = drawn_records(members.select("group", "team"), forecast(members, fixtures), [], 9, 1)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInArrow") == 2  # draws, and what the teams count
    assert text.rindex("Generate") < text.rindex("MapInArrow")
