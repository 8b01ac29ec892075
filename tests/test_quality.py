import pytest
from conftest import day
from pyspark.sql import functions as F

from contestry.operators.form import add_form
from contestry.operators.quality import (
    check_bounds,
    check_features,
    check_matches,
    check_probabilities,
    duplicate_keys,
    enforce,
    enforce_matches,
    null_counts,
    profile,
)
from contestry.operators.reshape import model_dataset
from contestry.schemas import DataQualityError

MATCH = (
    "match_id bigint, date date, home_team string, away_team string, home_score double, "
    "away_score double, neutral boolean, result string, home_win boolean, draw boolean, "
    "away_win boolean"
)
GOOD = [
    (1, day("2020-01-01"), "A", "B", 2.0, 1.0, True, "H", True, False, False),
    (2, day("2020-01-02"), "C", "D", 0.0, 0.0, False, "D", False, True, False),
]


def found(spark, *rows, **options):
    options.setdefault("max_date", "2025-01-01")
    df = spark.createDataFrame(list(rows), MATCH)
    return {r.check: r.n for r in check_matches(df, **options).collect()}


def spoil(**changes):
    names = [f.split()[0] for f in MATCH.split(", ")]
    return tuple(changes.get(n, v) for n, v in zip(names, GOOD[0]))


def test_valid_matches_break_nothing(spark):
    assert found(spark, *GOOD, aliases={"USA": "United States"}) == {}


@pytest.mark.parametrize(
    "changes, rule",
    [
        ({"date": None}, "null_date"),
        ({"date": day("1850-01-01")}, "date_out_of_range"),
        ({"date": day("2030-01-01")}, "date_out_of_range"),
        ({"match_id": 2}, "duplicate_match_id"),
        ({"home_score": -1.0, "result": "A", "home_win": False, "away_win": True}, "home_score_negative"),
        ({"home_score": 2.5}, "home_score_not_integral"),
        ({"home_team": "USA"}, "un_normalized_name"),
        ({"home_team": "A  x"}, "un_normalized_name"),
        ({"away_team": "A"}, "same_team"),
        ({"result": "D"}, "result_mismatch"),
        ({"home_win": False}, "home_win_mismatch"),
        ({"draw": True}, "draw_mismatch"),
        ({"neutral": None}, "null_neutral"),
    ],
)
def test_each_rule(spark, changes, rule):
    assert found(spark, spoil(**changes), GOOD[1], aliases={"USA": "United States"}) == {rule: 1}


def test_types_and_missing_columns(spark):
    df = spark.createDataFrame(GOOD, MATCH)
    text = df.withColumn("neutral", F.lit("true")).withColumn("date", F.col("date").cast("string"))
    rules = {r.check for r in check_matches(text, max_date="2025-01-01").collect()}
    assert rules == {"neutral_type", "date_type"}
    missing = check_matches(df.drop("result"), max_date="2025-01-01").collect()
    assert [r.check for r in missing] == ["missing_result"]


def test_all_problems_come_in_one_error(spark):
    df = spark.createDataFrame([spoil(result="D", away_team="A"), GOOD[1]], MATCH)
    with pytest.raises(DataQualityError) as error:
        enforce_matches(df, max_date="2025-01-01")
    assert "same_team" in str(error.value) and "result_mismatch" in str(error.value)


P = "a double, b double, c double"


@pytest.mark.parametrize(
    "row, rules",
    [
        ((0.2, 0.3, 0.5), set()),
        ((None, 0.5, 0.5), {"null_probability"}),
        ((1.2, -0.2, 0.0), {"outside_unit_interval"}),
        ((0.2, 0.2, 0.2), {"row_sum_not_one"}),
    ],
)
def test_probability_rules(spark, row, rules):
    df = spark.createDataFrame([row], P)
    assert {r.check for r in check_probabilities(df, ["a", "b", "c"]).collect()} == rules


def test_bounds_count_values_and_ignore_sums(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.5), (0.0, 1 + 1e-10, -1.0)], P)
    got = {r.check: r.n for r in check_bounds(df, ["a", "b", "c"]).collect()}
    assert got == {"c": 2}
    with pytest.raises(DataQualityError):
        enforce(check_bounds(df, ["c"]), "bounds")


def test_feature_matrix_rules(spark):
    m = spark.createDataFrame(GOOD, MATCH).withColumn("tournament", F.lit("cup"))
    features = add_form(model_dataset(m))
    assert check_features(features, expected_rows=2).count() == 0
    spoiled = features.union(features.limit(1)).withColumn("target_class", F.lit(None).cast("string"))
    got = {r.check: r.n for r in check_features(spoiled, expected_rows=2).collect()}
    assert got == {"duplicate_match_id": 1, "null_target_class": 3, "row_count": 1}
    with pytest.raises(DataQualityError):
        check_features(features.drop("form_5_diff"))


def test_nulls_duplicates_and_profile(spark):
    df = spark.createDataFrame(
        [("2020-01-01", "x", "y"), ("2020-01-01", "x", "y"), ("bad", "y", None)],
        "date string, home_team string, away_team string",
    )
    assert [tuple(r) for r in null_counts(df).collect()] == [("away_team", 1)]
    assert duplicate_keys(df, *df.columns).first().n_duplicates == 1
    rows = {(r.section, r["item"]): r for r in
            profile(df, ["date"], ["home_team", "away_team"], top=1).collect()}
    assert rows["rows", "*"].n == 3 and rows["duplicate_rows", "*"].n == 1
    assert rows["nulls", "away_team"].share == pytest.approx(1 / 3)
    assert rows["dates", "date"].n == 1 and rows["dates", "date"].high == "2020-01-01"
    assert rows["names", "y"].n == 3 and ("names", "x") not in rows
