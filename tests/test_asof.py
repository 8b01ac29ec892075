import bisect
import datetime as dt
import random

import pytest
from conftest import CONTEST, day
from pyspark.sql import functions as F

from contestry.operators.asof import (
    add_elo_snapshots,
    add_ranking_snapshots,
    add_rating_features,
    asof_latest,
)
from contestry.operators.names import ALIASES
from contestry.operators.ordering import tasks_for
from contestry.operators.quality import enforce_no_future_ratings, future_ratings
from contestry.schemas import DataQualityError, LeakageError

ELO = "team string, date date, elo double"


def one(spark, date="2020-06-15"):
    return spark.createDataFrame([(1, day(date), "A", "B", 1, 0, True, "cup")], CONTEST)


def elo(spark, *rows):
    return spark.createDataFrame([(t, day(d), float(e)) for t, d, e in rows], ELO)


@pytest.mark.parametrize(
    "snapshots, expected",
    [
        ([("A", "2020-06-15", 1600)], 1600),
        ([("A", "2020-06-16", 1600)], None),
        ([("A", "2020-06-14", 1600)], 1600),
        ([("A", "2019-01-01", 1500), ("A", "2020-01-01", 1550), ("A", "2020-12-01", 1700)], 1550),
        ([("Z", "2020-01-01", 1600)], None),
    ],
)
def test_latest_rating_at_or_before(spark, snapshots, expected):
    got = add_elo_snapshots(one(spark), elo(spark, *snapshots), validate=True).first()
    assert got.team_a_elo == expected
    assert got.elo_diff is None


def test_difference_of_both_sides(spark):
    got = add_elo_snapshots(
        one(spark), elo(spark, ("A", "2020-01-01", 1600), ("B", "2020-02-01", 1500))
    ).first()
    assert (got.team_a_elo, got.team_b_elo, got.elo_diff) == (1600, 1500, 100)


def test_rank_and_points_come_from_one_release(spark):
    rows = [("A", day("2020-01-01"), 5, 1000.0), ("A", day("2020-05-01"), 9, None), ("B", day("2020-01-01"), 7, 900.0)]
    releases = spark.createDataFrame(rows, "team string, rank_date date, rank int, points double")
    got = add_ranking_snapshots(one(spark), releases, validate=True).first()
    assert (got.team_a_fifa_rank, got.team_a_fifa_points) == (9, None)
    assert got.fifa_rank_diff == 2 and got.fifa_points_diff is None


def test_rating_names_are_made_canonical(spark):
    c = spark.createDataFrame([(1, day("2020-06-15"), "United States", "B", 1, 0, True, "cup")], CONTEST)
    got = add_elo_snapshots(c, elo(spark, ("USA", "2020-01-01", 1700)), aliases=ALIASES).first()
    assert got.team_a_elo == 1700


def test_missing_rating_columns(spark):
    with pytest.raises(DataQualityError):
        add_elo_snapshots(one(spark), spark.createDataFrame([("A", 1.0)], "team string, elo double"))


def test_two_ratings_on_a_day_resolve_by_the_given_order(spark):
    rows = [("A", day("2020-01-01"), 1900.0, 1), ("A", day("2020-01-01"), 1400.0, 2)]
    ratings = spark.createDataFrame(rows, ELO + ", revision int")
    events = spark.createDataFrame([("A", day("2020-01-02"))], "team string, date date")
    assert asof_latest(events, ratings, ["elo"], tie=[F.col("revision")]).first().elo == 1400


@pytest.mark.parametrize("limit", [1_000_000, 60, 10])
def test_hot_teams_get_the_same_rating(spark, contests, limit):
    draw = random.Random(9)
    teams = {r.team_a for r in contests.collect()} | {r.team_b for r in contests.collect()}
    rows = [(t, day("2000-03-01") + dt.timedelta(30 * i), float(draw.randrange(1000)))
            for t in teams for i in range(25) if t != "t03"]
    got = add_elo_snapshots(contests, spark.createDataFrame(rows, ELO), limit=limit).collect()
    assert len(got) == 400
    known = {}
    for t, d, e in sorted(rows):
        known.setdefault(t, ([], []))
        known[t][0].append(d)
        known[t][1].append(e)
    for r in got:
        for team, value in ((r.team_a, r.team_a_elo), (r.team_b, r.team_b_elo)):
            dates, values = known.get(team, ([], []))
            i = bisect.bisect_right(dates, r.date)
            assert value == (values[i - 1] if i else None)


def test_the_guard_trips_on_a_later_rating(spark):
    df = spark.createDataFrame([(day("2020-01-01"), day("2020-01-02"), None)], "date date, r1 date, r2 date")
    assert [tuple(r) for r in future_ratings(df, ["r1", "r2"]).collect()] == [("r1", 1)]
    with pytest.raises(LeakageError):
        enforce_no_future_ratings(df, ["r1", "r2"])


def test_a_crowded_day_and_a_team_with_very_many_ratings(spark):
    rows = [(i, day("2020-03-01") if i < 90 else day("2020-01-05"), "H", f"o{i}", 1, 0, True, "cup")
            for i in range(120)]
    c = spark.createDataFrame(rows, CONTEST)
    ratings = [("H", day("2020-01-01") + dt.timedelta(i // 10), float(i)) for i in range(100)]
    ratings += [("o3", day("2020-02-01") + dt.timedelta(i), float(i)) for i in range(40)]
    for limit in (1000, 20):
        got = {r.match_id: r for r in
               add_elo_snapshots(c, spark.createDataFrame(ratings, ELO), limit=limit).collect()}
        assert len(got) == 120
        assert got[0].team_a_elo == 99 and got[100].team_a_elo == 49
        assert got[3].team_b_elo == 29 and got[4].team_b_elo is None


def test_rows_of_a_task_do_not_grow_with_the_table(contests, spark):
    """Sides meet dealt out by a counted number of tasks, not grouped before in a map of every row."""
    ratings = spark.createDataFrame([("hot", day("2000-01-01"), 1.0)], "team string, date date, elo double")
    plan = add_elo_snapshots(contests, ratings)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1].splitlines()
    (deal,) = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(match_id" in line
               and "REPARTITION_BY_NUM" in line]
    assert not any("HashAggregate" in line for line in plan[deal:])
    assert tasks_for(contests, 10) == spark.sparkContext.defaultParallelism
    assert tasks_for(contests, 54_000_000) == 64 and tasks_for(contests, 64_000_000) == 64
    assert tasks_for(contests, 64_000_001) == 128


def test_both_rating_sources_read_the_contests_not_each_other(contests, spark):
    elo = spark.createDataFrame([("hot", day("2000-01-01"), 1.0)], "team string, date date, elo double")
    ranks = spark.createDataFrame(
        [("hot", day("2000-01-01"), 1, 2.0)], "team string, rank_date date, rank int, points double"
    )
    out = add_rating_features(contests, elo, ranks)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 2
