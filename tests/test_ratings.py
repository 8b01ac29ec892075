import pytest
from conftest import CONTEST, day
from pyspark.sql import functions as F

from contestry.functions.elo import expected_score, strength_probabilities, updated_rating
from contestry.operators.ratings import (
    add_elo,
    champion_rank,
    current_elo,
    entering_ratings,
    favourites,
    pair_forecast,
    rating_table,
)


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_rating_arithmetic(spark):
    got = one(
        spark,
        expected_score(F.lit(1500.0), F.lit(1500.0), 0),
        expected_score(F.lit(1900.0), F.lit(1500.0), 0),
        expected_score(F.lit(1500.0), F.lit(1500.0)),
        updated_rating(F.lit(1500.0), F.lit(0.5), F.lit(1.0)),
    )
    assert got.c0 == 0.5 and got.c1 == pytest.approx(10 / 11)
    assert got.c2 == pytest.approx(1 / (1 + 10 ** (-65 / 400))) and got.c3 == 1516


def test_strength_forecast(spark):
    a, d, b = strength_probabilities(F.lit(100.0), F.lit(None).cast("double"))
    big, _, small = strength_probabilities(F.lit(1e9), F.lit(0.0))
    got = one(spark, a, d, b, big, small)
    assert got.c0 == pytest.approx(0.78 * 10 / 11) and got.c1 == 0.22
    assert got.c0 + got.c1 + got.c2 == pytest.approx(1)
    assert got.c3 == pytest.approx(0.78) and got.c4 == pytest.approx(0)
    with pytest.raises(ValueError):
        strength_probabilities(F.lit(1.0), F.lit(1.0), draw_rate=1.0)


def walk(rows, home=True):
    """The rating walk by hand, per tournament."""
    ratings, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.date, r.match_id)):
        ka, kb = (r.tournament, r.team_a), (r.tournament, r.team_b)
        ra, rb = ratings.get(ka, 1500.0), ratings.get(kb, 1500.0)
        out[r.match_id] = (ra, rb)
        bonus = 65.0 if home and not r.is_neutral else 0.0
        e = 1 / (1 + 10 ** ((rb - ra - bonus) / 400))
        s = (r.team_a_score > r.team_b_score) + 0.5 * (r.team_a_score == r.team_b_score)
        ratings[ka] = ra + 32 * (s - e)
        ratings[kb] = rb + 32 * ((1 - s) - (1 - e))
    return out, ratings


@pytest.mark.parametrize("segment_rows, limit", [(1_000_000, 1_000_000), (70, 1_000_000), (70, 50)])
def test_walk_forward_in_one_go_and_in_segments(contests, segment_rows, limit):
    c = contests.withColumn("is_team_a_home", ~F.col("is_neutral"))
    expected, last = walk(contests.collect())
    options = {"segment_rows": segment_rows, "limit": limit}
    rows = add_elo(c, ["tournament"], **options).collect()
    assert len(rows) == 400
    for r in rows:
        assert (r.team_a_elo, r.team_b_elo) == pytest.approx(expected[r.match_id], abs=1e-9)
        assert r.elo_diff == r.team_a_elo - r.team_b_elo
    final = {(r.tournament, r.team): r.elo for r in current_elo(c, ["tournament"], **options).collect()}
    assert final == pytest.approx(last)


def test_without_a_home_flag_there_is_no_bonus(contests):
    one_cup = contests.filter(F.col("tournament") == "cup")
    expected, _ = walk(one_cup.collect(), home=False)
    for r in add_elo(one_cup, ()).collect():
        assert (r.team_a_elo, r.team_b_elo) == pytest.approx(expected[r.match_id])


def test_pools_with_null_and_several_columns(spark, contests):
    c = contests.withColumn("season", F.when(F.col("match_id") % 2 == 0, F.year("date")))
    got = current_elo(c, ["tournament", "season"])
    assert dict(got.dtypes)["season"] == "int"
    assert got.filter(F.col("season").isNull()).count() > 0


def test_an_appended_contest_changes_nothing_earlier(spark, contests):
    more = contests.union(
        spark.createDataFrame([(999, day("2010-01-01"), "hot", "t01", 100, 0, True, "cup")], CONTEST)
    )
    before = {r.match_id: r.team_a_elo for r in add_elo(contests, ["tournament"]).collect()}
    after = {r.match_id: r.team_a_elo for r in add_elo(more, ["tournament"]).collect()}
    assert all(after[i] == v for i, v in before.items())


def test_rating_table_rank_and_percentile(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0), ("d", 0.0)], "team string, elo double")
    got = {r.team: (r["rank"], r.percentile) for r in rating_table(df).collect()}
    assert got == {"c": (1, 100.0), "a": (2, 75.0), "b": (3, 50.0), "d": (4, 25.0)}


def test_entering_ratings_take_the_first_contest(spark):
    rows = [("cup", day("2020-01-02"), 2, "A", "B", 1600.0, 1400.0), ("cup", day("2020-01-01"), 9, "B", "C", 1450.0, 1500.0)]
    df = spark.createDataFrame(
        rows, "tournament string, date date, match_id int, team_a string, team_b string, team_a_elo double, team_b_elo double"
    )
    got = {r.team: r.elo for r in entering_ratings(df, ["tournament"]).collect()}
    assert got == {"A": 1600.0, "B": 1450.0, "C": 1500.0}


def test_champion_rank(spark):
    strengths = spark.createDataFrame(
        [("w", "A", 1700.0), ("w", "B", None), ("w", "C", 1500.0), ("w", "D", 1400.0)],
        "tournament string, team string, elo double",
    )
    ranking = favourites(strengths, ["tournament"])
    assert {r.team: r["rank"] for r in ranking.collect()} == {"A": 1, "B": 2, "C": 3, "D": 4}
    champions = spark.createDataFrame([("w", "D"), ("w", "Z")], "tournament string, champion string")
    got = {r.champion: r for r in champion_rank(ranking, champions).collect()}
    assert (got["D"].predicted_rank, got["D"].in_top_3, got["D"].in_top_5) == (4, False, True)
    assert (got["Z"].predicted_rank, got["Z"].in_top_10, got["Z"].n_participants) == (None, False, 4)


def test_pair_forecast_home_bonus(spark):
    ratings = spark.createDataFrame([("A", 1500.0), ("B", 1500.0)], "team string, elo double")
    pairs = spark.createDataFrame(
        [("A", "B", True), ("A", "B", False), ("Z", "B", False)], "team_a string, team_b string, is_neutral boolean"
    )
    got = {(r.team_a, r.is_neutral): r.p_team_a_win for r in pair_forecast(pairs, ratings).collect()}
    assert got["A", True] == pytest.approx(0.39)
    assert got["A", False] == pytest.approx(0.78 / (1 + 10 ** (-65 / 100)))
    assert got["Z", False] == pytest.approx(got["A", False])


def test_segments_of_whole_days_sort_no_pool(contests, monkeypatch):
    """Contests are numbered, which sorts them all, only where one day is above the limit."""
    from contestry.operators import ratings

    walk_forward = ratings.walk_forward

    numbered = []

    def watched(*args, number=ratings.number_rows):
        numbered.append(args)
        return number(*args)

    monkeypatch.setattr(ratings, "number_rows", watched)
    columns = ["match_id", "a_pre", "b_pre", "a_post", "b_post"]
    one_day = contests.withColumn("date", F.lit("2001-01-01").cast("date"))
    for rows, sorts in ((contests, 0), (one_day, 1)):
        whole = sorted(map(tuple, walk_forward(rows, ["tournament"]).select(*columns).collect()))
        split = walk_forward(rows, ["tournament"], segment_rows=70).select(*columns)
        assert sorted(map(tuple, split.collect())) == whole
        assert len(numbered) == sorts
