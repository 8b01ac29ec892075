import math
import random

import pytest
from pyspark.sql import functions as F

from contestry.functions.probability import (
    advance_probability,
    bin_index,
    clip_normalize,
    drawn_class,
    drawn_winner,
    keyed_uniform,
    top_label,
)
from contestry.operators.scoring import (
    backtest_summary,
    calibration_error,
    class_prior,
    class_report,
    comparison,
    confusion,
    enforce_labels,
    leaderboard,
    prediction_frame,
    reliability,
    score,
)
from contestry.schemas import CLASSES, PROBABILITIES, DataQualityError

SCHEMA = "match_id int, target_class string, p_team_a_win double, p_draw double, p_team_b_win double"


def frame(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def forecasts(spark):
    draw, rows = random.Random(2), []
    for _ in range(200):
        w = [draw.random() + 1e-3 for _ in range(3)]
        p = [x / sum(w) for x in w]
        rows.append((draw.choices(CLASSES, p)[0], *p))
    return frame(spark, *rows).cache()


def test_perfect_and_uniform_scores(spark):
    perfect = score(frame(spark, ("draw", 0.0, 1.0, 0.0), ("team_b_win", 0.0, 0.0, 1.0))).first()
    assert (perfect.log_loss, perfect.brier, perfect.accuracy, perfect.n) == (0, 0, 1, 2)
    third = 1 / 3
    flat = score(frame(spark, ("draw", third, third, third))).first()
    assert flat.log_loss == pytest.approx(math.log(3)) and flat.brier == pytest.approx(2 / 3)
    assert flat.accuracy == 0  # ties go to the first class
    wrong = score(frame(spark, ("draw", 1.0, 0.0, 0.0))).first()
    assert wrong.log_loss == pytest.approx(-math.log(1e-15)) and wrong.brier == 2


def test_only_known_labels_are_scored(spark):
    third = (1 / 3, 1 / 3, 1 / 3)
    got = score(frame(spark, ("draw", *third), (None, *third))).first()
    assert got.n == 1 and got.log_loss == pytest.approx(math.log(3)) and got.accuracy == 0.0
    with pytest.raises(Exception, match="outside the three classes"):
        score(frame(spark, ("draw", *third), ("pending", *third))).collect()


def test_a_null_key_is_a_key(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    drawn = [r[0] for r in df.select(keyed_uniform(1, F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert drawn[0] != drawn[1]


def test_calibration_error_by_hand(spark, forecasts):
    bins = {}
    for r in forecasts.collect():
        p = [r[c] for c in PROBABILITIES]
        top = max(p)
        hit = CLASSES[p.index(top)] == r.target_class
        bins.setdefault(min(9, math.ceil(top * 10 - 1e-9) - 1), []).append((top, hit))
    expected = sum(
        abs(sum(h for _, h in b) / len(b) - sum(t for t, _ in b) / len(b)) * len(b) / 200
        for b in bins.values()
    )
    assert calibration_error(forecasts).first().calibration_error == pytest.approx(expected)


def test_bin_edges_belong_to_the_lower_bin(spark):
    values = [0.0, 0.1, 0.100001, 0.3, 3 * 0.1, 1.0, 1.2]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    assert [r[0] for r in df.select(bin_index(F.col("p"))).collect()] == [None, 0, 1, 2, 2, 9, 9]


def test_reliability_counts_every_positive_probability(forecasts):
    got = reliability(forecasts).collect()
    assert sum(r["count"] for r in got) == 600
    for r in got:
        assert r.bin / 10 <= r.mean_predicted <= r.bin / 10 + 0.1 + 1e-9
        assert 0 <= r.observed_frequency <= 1


def test_confusion_and_class_report(spark):
    df = frame(
        spark, ("team_a_win", 0.8, 0.1, 0.1), ("team_a_win", 0.1, 0.1, 0.8), ("draw", 0.5, 0.3, 0.2)
    )
    table = {r.actual: (r.team_a_win, r.draw, r.team_b_win) for r in confusion(df).collect()}
    assert table == {"team_a_win": (1, 0, 1), "draw": (1, 0, 0), "team_b_win": (0, 0, 0)}
    report = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in class_report(df).collect()}
    assert report == {
        "team_a_win": (0.5, 0.5, 0.5, 2), "draw": (0, 0, 0, 1), "team_b_win": (0, 0, 0, 0)
    }


def test_prior_is_smoothed(spark):
    df = frame(spark, ("draw", 0.0, 0.0, 0.0), ("draw", 0.0, 0.0, 0.0))
    assert tuple(class_prior(df).first()) == pytest.approx((1 / 5, 3 / 5, 1 / 5))


def test_leaderboard_and_comparison(spark, forecasts):
    third = F.lit(1 / 3)
    flat = forecasts.withColumns({p: third for p in PROBABILITIES})
    told = flat.withColumn("model", F.lit("flat")).unionByName(forecasts.withColumn("model", F.lit("good")))
    board = leaderboard(told)
    assert [r.model for r in board.collect()] == ["good", "flat"]
    row = comparison(board, "good", ["flat"]).first()
    assert row.beats_best_baseline and row.best_baseline == "flat"
    assert not comparison(board, "flat", ["good"]).first().beats_best_baseline


def test_labels_and_prediction_frame(spark, forecasts):
    with pytest.raises(DataQualityError, match="lost"):
        enforce_labels(frame(spark, ("lost", 1.0, 0.0, 0.0)))
    assert enforce_labels(forecasts) is forecasts
    assert prediction_frame(forecasts).columns == ["match_id", "target_class", *PROBABILITIES]


def test_backtest_summary(spark):
    rows = [(1.0, 0.5, 0.6, 0.1, True), (0.8, 0.4, 0.5, 0.2, False)]
    df = spark.createDataFrame(
        rows, "log_loss double, brier double, accuracy double, calibration_error double, champion_in_top_5 boolean"
    )
    got = backtest_summary(df).first()
    assert (got.mean_log_loss, got.n_tournaments, got.champion_top_5_rate) == (0.9, 2, 0.5)


def test_vector_helpers(spark):
    df = frame(spark, ("draw", 0.4, 0.4, 0.2))
    parts = [F.lit(x) for x in (0.0, 0.5, 0.5)]
    got = df.select(
        top_label().alias("t"), *[c.alias(f"c{i}") for i, c in enumerate(clip_normalize(parts))],
        advance_probability(*[F.col(p) for p in PROBABILITIES]).alias("q"),
        advance_probability(F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("even"),
    ).first()
    assert got.t == "team_a_win" and got.c0 > 0 and got.c0 + got.c1 + got.c2 == pytest.approx(1)
    assert got.q == pytest.approx(2 / 3) and got.even == 0.5


@pytest.mark.parametrize("weights", [(-0.1, 0.5, 0.6), (0.0, 0.0, 0.0)])
def test_bad_weights_raise(spark, weights):
    expr = drawn_class(F.lit(0.5), [F.lit(w) + F.rand() * 0 for w in weights])
    with pytest.raises(Exception, match="weights"):
        spark.range(1).select(expr).collect()


def test_keyed_draws_follow_their_weights_and_their_key(spark):
    u = keyed_uniform(7, F.col("id"))
    weights = [F.lit(0.2), F.lit(0.3), F.lit(0.5)]
    df = spark.range(20_000)
    drawn = df.select("id", drawn_class(u, weights).alias("c"))
    share = {r.c: r["count"] / 20_000 for r in drawn.groupBy("c").count().collect()}
    assert share["team_a_win"] == pytest.approx(0.2, abs=0.02)
    assert share["team_b_win"] == pytest.approx(0.5, abs=0.02)
    again = df.repartition(7).select("id", drawn_class(u, weights).alias("c"))
    assert drawn.exceptAll(again).count() == 0
    sure = df.select(drawn_winner(u, F.lit("x"), F.lit("y"), F.lit(1.0)).alias("w")).distinct()
    assert [r.w for r in sure.collect()] == ["x"]
