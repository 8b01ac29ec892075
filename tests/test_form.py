import pytest
from conftest import CONTEST, day

from contestry.operators.form import add_form, team_form
from contestry.operators.reshape import model_dataset, participants, team_long
from contestry.schemas import DIFFERENCES, TEAM_FEATURES


def contest(i, date, a, b, sa, sb):
    return (i, day(date), a, b, sa, sb, False, "cup")


def by_id(df):
    return {r.match_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        contest(1, "2020-01-01", "A", "B", 3, 1),
        contest(2, "2020-01-11", "A", "C", 0, 0),
        contest(3, "2020-01-11", "B", "A", 2, 4),
        contest(4, "2021-01-10", "A", "C", 1, 2),
        contest(5, "2021-01-11", "A", "B", 1, 0),
    ]
    return spark.createDataFrame(rows, CONTEST)


def test_first_contest_has_no_history(small):
    r = by_id(add_form(small))[1]
    assert r.last_5_points_per_match_a is None and r.days_since_last_match_a is None
    assert r.matches_played_last_365_days_a == 0
    assert r.form_5_diff is None


def test_values_by_hand(small):
    got = by_id(add_form(small))
    # An earlier contest on the same day counts as played before.
    assert got[3].last_5_points_per_match_b == pytest.approx((3 + 1) / 2)
    assert got[3].days_since_last_match_b == 0
    assert got[4].last_5_goals_for_avg_a == pytest.approx((3 + 0 + 4) / 3)
    assert got[4].last_10_goals_against_avg_a == pytest.approx((1 + 0 + 2) / 3)
    assert got[4].days_since_last_match_a == 365
    assert got[5].goals_for_5_diff == pytest.approx((3 + 0 + 4 + 1) / 4 - (1 + 2) / 2)
    assert got[5].rest_days_diff == 1 - 366


def test_a_contest_365_days_back_is_out(small):
    got = by_id(add_form(small))
    assert got[4].matches_played_last_365_days_a == 0  # 2020-01-11 is exactly 365 days (leap year: 365)
    assert got[5].matches_played_last_365_days_a == 1


def test_later_contests_change_nothing_earlier(spark, small):
    before = by_id(add_form(small))
    more = small.union(spark.createDataFrame([contest(6, "2022-01-01", "A", "B", 100, 0)], CONTEST))
    after = by_id(add_form(more))
    assert all(after[i] == before[i] for i in before)


def plain_history(rows):
    """Per-team features by a plain walk, for comparison."""
    out = {}
    per_team = {}
    for r in sorted(rows, key=lambda r: (r.date, r.match_id)):
        for side, team, gf, ga in (
            ("a", r.team_a, r.team_a_score, r.team_b_score),
            ("b", r.team_b, r.team_b_score, r.team_a_score),
        ):
            past = per_team.get(team, [])
            points = [3 if x[1] > x[2] else 1 if x[1] == x[2] else 0 for x in past]
            out[r.match_id, side] = {
                "last_5_points_per_match": sum(points[-5:]) / len(points[-5:]) if past else None,
                "last_10_goals_for_avg": (
                    sum(x[1] for x in past[-10:]) / len(past[-10:]) if past else None
                ),
                "days_since_last_match": (r.date - past[-1][0]).days if past else None,
                "matches_played_last_365_days": sum((r.date - x[0]).days < 365 for x in past),
            }
        for team, gf, ga in (
            (r.team_a, r.team_a_score, r.team_b_score), (r.team_b, r.team_b_score, r.team_a_score)
        ):
            per_team.setdefault(team, []).append((r.date, gf, ga))
    return out


@pytest.mark.parametrize("limit", [1_000_000, 60, 10])
def test_hot_teams_get_the_same_form(contests, limit):
    expected = plain_history(contests.collect())
    got = team_form(team_long(contests), limit).collect()
    assert len(got) == 800
    for r in got:
        for name, value in expected[r.match_id, r.side].items():
            assert r[name] == pytest.approx(value), (r.match_id, r.side, name)


def test_form_columns_and_one_row_per_contest(contests):
    out = add_form(contests, limit=60)
    assert out.count() == 400
    assert set(out.columns) == {
        *contests.columns, *[f"{f}_{s}" for f in TEAM_FEATURES for s in "ab"], *DIFFERENCES
    }


def test_long_form_has_two_opposite_rows(small):
    rows = [r for r in team_long(small).collect() if r.match_id == 1]
    assert {(r.side, r.team, r.goals_for, r.goals_against, r.goal_diff, r.points) for r in rows} == {
        ("a", "A", 3, 1, 2, 3), ("b", "B", 1, 3, -2, 0)
    }


def test_participants(small):
    assert {r.team for r in participants(small).collect()} == {"A", "B", "C"}


def test_model_dataset_targets(spark):
    rows = [(1, "x", "y", 2, 1, False), (2, "x", "y", 1, 1, True), (3, "x", "y", 0, 1, False)]
    m = spark.createDataFrame(
        rows, "match_id int, home_team string, away_team string, home_score int, away_score int, neutral boolean"
    ).selectExpr("*", "DATE'2020-01-01' AS date", "'cup' AS tournament")
    got = by_id(model_dataset(m))
    assert [got[i].target_class for i in (1, 2, 3)] == ["team_a_win", "draw", "team_b_win"]
    assert [got[i].team_a_result for i in (1, 2, 3)] == ["win", "draw", "loss"]
    assert [got[i].is_team_a_home for i in (1, 2, 3)] == [True, False, True]
    assert got[1].host_country is None


def test_a_crowded_day_of_a_hot_team(spark):
    rows = [contest(i, "2020-03-01" if i < 90 else "2020-03-05", "H", f"o{i}", i % 4, i % 3)
            for i in range(120)]
    df = spark.createDataFrame(rows, CONTEST)
    expected = plain_history(df.collect())
    for r in team_form(team_long(df), 20).collect():
        for name, value in expected[r.match_id, r.side].items():
            assert r[name] == pytest.approx(value), (r.match_id, r.side, name)


def test_a_team_is_sorted_once(small):
    plan = team_form(team_long(small))._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Window ") == 2 and plan.count("Sort [") == 1


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_contests_without_a_score_are_skipped(spark, limit):
    rows = [contest(i, f"2020-01-{i:02d}", "A", f"o{i}", i, 1) for i in range(1, 16)]
    for i, (a, b) in {3: (None, 2), 4: (4, None), 5: (None, None)}.items():
        rows[i - 1] = (*rows[i - 1][:4], a, b, *rows[i - 1][6:])
    got = {r.match_id: r for r in team_form(team_long(spark.createDataFrame(rows, CONTEST)), limit)
           .filter("side = 'a'").collect()}
    assert got[4].last_5_points_per_match == (1 + 3) / 2
    assert got[6].last_5_goals_for_avg == (1 + 2 + 4) / 3
    assert got[6].last_5_goals_against_avg == (1 + 1 + 2) / 3
    assert got[6].last_5_goal_diff_avg == (0 + 1) / 2
    assert got[8].last_5_goal_diff_avg == (5 + 6) / 2
    assert got[15].last_10_goals_for_avg == (sum(range(6, 15))) / 9  # contests 5 to 14


def test_averages_over_unplayed_contests_only_are_null(spark):
    rows = [(i, day(f"2020-01-{i:02d}"), "A", "B", None, None, False, "cup") for i in range(1, 4)]
    for r in team_form(team_long(spark.createDataFrame(rows, CONTEST))).collect():
        assert r.last_5_points_per_match is None and r.last_10_goals_for_avg is None


def test_wide_steps_are_compiled(spark, small):
    """Generated methods above HotSpot's limit would be interpreted."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    add_form(small)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_the_split_of_form_rows_reads_no_form(spark, small, monkeypatch):
    """Each of its passes would compute the form anew."""
    from contestry.plans import catalog

    seen = []
    monkeypatch.setattr(catalog.tb, "played", lambda *_: small)
    monkeypatch.setattr(catalog, "temporal_split", lambda df: seen.append(df.columns) or df)
    assert catalog._form_rows(spark, "").count() == 5
    assert not set(seen[0]) & set(DIFFERENCES)
