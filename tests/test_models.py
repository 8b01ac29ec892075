import math
import random

import pytest
from conftest import day
from pyspark.sql import functions as F

from contestry.operators.grouped_logistic import fit_grouped
from contestry.operators.models import (
    EnsembleModel,
    FeatureUnavailableError,
    calibrate,
    evaluate,
    fit_baselines,
    fit_boosted,
    fit_logistic,
    fit_prior,
    check_features_of,
    optimality,
    score_together,
    uniform_model,
)
from contestry.operators.scoring import leaderboard, score, with_label_index
from contestry.plans.training import Tournament, backtest, feature_matrix, fit_before, train
from contestry.sources.stored_models import read_model, write_model
from contestry.schemas import CLASSES, DIFFERENCES, PROBABILITIES, DataQualityError

FORM = list(DIFFERENCES)


@pytest.fixture(scope="module")
def features(spark):
    """The rating difference decides the outcome, form is noise."""
    import datetime as dt

    draw, rows = random.Random(4), []
    for i in range(900):
        diff = draw.gauss(0, 150)
        a, b = math.exp(diff / 120), math.exp(-diff / 120)
        c = draw.choices(CLASSES, [a, 0.8, b])[0]
        form = [None if draw.random() < 0.05 else draw.gauss(0, 1) for _ in FORM]
        rows.append((i, day("2010-01-01") + dt.timedelta(3 * i), f"t{i % 8}", f"t{8 + i % 7}", c,
                     diff, i % 2 == 0, "cup" if i % 5 == 0 else "league", 1500 + diff, 1500.0, *form))
    schema = ("match_id int, date date, team_a string, team_b string, target_class string, "
              "elo_diff double, is_team_a_home boolean, tournament string, team_a_elo double, "
              "team_b_elo double, " + ", ".join(f"{f} double" for f in FORM))
    return spark.createDataFrame(rows, schema).cache()


def sums(df):
    total = F.col(PROBABILITIES[0]) + F.col(PROBABILITIES[1]) + F.col(PROBABILITIES[2])
    r = df.select(total.alias("t")).agg(F.min("t"), F.max("t"), F.count("t")).first()
    return r[0], r[1], r[2]


def assert_distribution(df, n):
    low, high, count = sums(df)
    assert low == pytest.approx(1) and high == pytest.approx(1) and count == n


def log_loss(df):
    return score(df).first().log_loss


@pytest.mark.parametrize("kind", ["prior", "logistic", "boosted", "ensemble", "isotonic", "sigmoid"])
def test_a_stored_model_scores_as_before(spark, features, tmp_path, kind):
    logistic = fit_logistic(features, ["elo_diff"])
    model = {
        "prior": lambda: fit_prior(features),
        "logistic": lambda: logistic,
        "boosted": lambda: fit_boosted(features, ["elo_diff"], max_iter=2),
        "ensemble": lambda: EnsembleModel([uniform_model(), logistic], [1.0, 3.0]),
        "isotonic": lambda: calibrate(logistic, features),
        "sigmoid": lambda: calibrate(logistic, features, "sigmoid"),
    }[kind]()
    write_model(fit_prior(features), str(tmp_path / "m"))
    again = read_model(spark, write_model(model, str(tmp_path / "m")))
    one, two = (sorted(m.transform(features).select("match_id", *PROBABILITIES).collect()) for m in (model, again))
    assert one == two
    with pytest.raises(TypeError):
        write_model("no model", str(tmp_path / "n"))


def test_logistic_learns_the_signal(features):
    model = fit_logistic(features, ["elo_diff"])
    out = model.transform(features)
    assert_distribution(out, 900)
    assert log_loss(out) < math.log(3) - 0.1
    assert set(out.columns) == {*features.columns, *PROBABILITIES}
    assert evaluate(model, features).first().n == 900
    with pytest.raises(FeatureUnavailableError):
        model.transform(features.drop("elo_diff"))
    with pytest.raises(FeatureUnavailableError):
        fit_logistic(features, ["fifa_points_diff"])


def test_a_class_not_seen_in_training_gets_almost_nothing(features):
    two = features.filter(F.col("target_class") != "team_b_win")
    out = fit_logistic(two, ["elo_diff"]).transform(features)
    assert_distribution(out, 900)
    assert out.agg(F.max("p_team_b_win")).first()[0] < 1e-6
    late = features.filter(F.col("target_class") != "team_a_win")
    assert fit_logistic(late, ["elo_diff"]).transform(features).agg(F.max("p_team_a_win")).first()[0] < 1e-6


def test_prior_uniform_and_ensemble(features):
    prior, flat = fit_prior(features), uniform_model()
    blend = EnsembleModel([prior, flat], [3.0, 1.0]).transform(features)
    assert_distribution(blend, 900)
    p, b = prior.transform(features).first(), blend.first()
    for c in PROBABILITIES:
        assert b[c] == pytest.approx(0.75 * p[c] + 0.25 / 3)
    with pytest.raises(ValueError):
        EnsembleModel([]).transform(features)
    with pytest.raises(ValueError):
        EnsembleModel([prior], [1.0, 2.0]).transform(features)


def test_baselines_follow_the_columns(features):
    assert list(fit_baselines(features)) == [
        "uniform_random", "class_frequency", "elo_logistic", "recent_form_logistic", "weighted_ensemble"
    ]
    bare = features.select("match_id", "target_class")
    assert list(fit_baselines(bare)) == ["uniform_random", "class_frequency"]


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration(features, method):
    early, late = features.filter("match_id < 500"), features.filter("match_id >= 500")
    model = calibrate(fit_logistic(early, ["elo_diff"]), late, method)
    out = model.transform(features)
    assert_distribution(out, 900)
    if method == "sigmoid":
        assert log_loss(out) < math.log(3)
    # Calibrated forecasts rise with raw ones.
    top = out.orderBy("elo_diff").select("p_team_a_win").collect()
    assert top[0][0] < top[-1][0]


def test_calibration_edge_cases(features):
    model = fit_logistic(features, ["elo_diff"])
    assert calibrate(model, features, "none") is model
    with pytest.raises(ValueError):
        calibrate(model, features, "magic")
    one_class = features.filter(F.col("target_class") == "draw")
    out = calibrate(model, one_class).transform(features)
    assert out.agg(F.min("p_draw")).first()[0] == pytest.approx(1)


def test_calibration_maps_are_fitted_on_all_rows(spark):
    """With one score for all rows a map is the share of its class, to the last row."""
    n = 260_000
    rows = spark.range(n).select(
        F.col("id").alias("match_id"),
        F.when(F.col("id") < 90_001, CLASSES[0]).when(F.col("id") < 150_004, CLASSES[1]).otherwise(CLASSES[2])
        .alias("target_class"),
    )
    told = calibrate(uniform_model(), rows).transform(rows.limit(1)).first()
    for p, hits in zip(PROBABILITIES, (90_001, 60_003, n - 150_004)):
        assert told[p] == pytest.approx(hits / n, abs=1e-9)


def test_training_calibrates_on_the_whole_validation_part(spark):
    """An isotonic map keeps the mean of the rows it was fitted on, so it tells which those were."""
    draws = [F.pmod(F.hash("id", F.lit(i)), F.lit(1000)) for i in range(2)]
    label = F.when(draws[1] < 300 + draws[0] / 4, CLASSES[0]).when(draws[1] < 700, CLASSES[1]).otherwise(CLASSES[2])
    rows = spark.range(300_000).select(
        F.col("id").alias("match_id"), F.date_from_unix_date((F.col("id") % 5000).cast("int")).alias("date"),
        label.alias("target_class"), draws[0].cast("double").alias("elo_diff"),
    )
    run = train(rows, candidates=["elo_diff"], val_fraction=0.8, test_fraction=0.1)
    late = rows.filter("date > date_from_unix_date(499) AND date <= date_from_unix_date(4499)")
    scored = run.base.transform(late)
    for p, name, fitted in zip(PROBABILITIES, CLASSES, run.model.maps):
        told = fitted.apply(scored, p, "_told").agg(
            F.avg("_told"), F.avg((F.col("target_class") == name).cast("double")), F.count(F.lit(1))
        ).first()
        assert told[2] == 240_000 and told[0] == pytest.approx(told[1], abs=1e-9)


def test_boosting(features):
    out = fit_boosted(features, ["elo_diff", "form_5_diff"], max_iter=5).transform(features)
    assert_distribution(out, 900)
    assert log_loss(out) < math.log(3)


def test_feature_check(spark):
    df = spark.createDataFrame([(1, 2.0, 3)], "form_5_diff int, elo_diff double, team_a_score int")
    found = check_features_of(df, ["form_5_diff", "elo_diff", "team_a_score", "y"])
    assert found.present == ("form_5_diff", "elo_diff")
    assert found.refused == ("team_a_score",) and found.absent == ("y",)
    with pytest.raises(DataQualityError):
        found.demanded()
    with pytest.raises(DataQualityError):
        check_features_of(df, ["y"]).demanded()
    assert check_features_of(df, ["elo_diff", "y"]).demanded() == ["elo_diff"]


def test_training_run(features):
    extra = features.unionByName(features.limit(1).withColumn("target_class", F.lit(None).cast("string")))
    run = train(extra)
    board = {r.model: r for r in run.board.collect()}
    assert {r.n for r in board.values()} == {135}
    assert board["main_model (uncalibrated)"].log_loss < board["uniform_random"].log_loss
    assert board["uniform_random"].log_loss == pytest.approx(math.log(3))
    assert run.predictions.count() == 135 and run.features[-1] == "is_team_a_home"
    assert {r.model: r.n for r in run.validation.collect()} == {"calibrated": 135, "uncalibrated": 135}
    assert {r.model for r in run.calibration.collect()} == {"calibrated", "uncalibrated"}
    row = run.comparison.first()
    assert row.beats_best_baseline == (row.main_log_loss < row.best_baseline_log_loss)
    with pytest.raises(DataQualityError):
        train(features.drop("target_class"))


def test_backtest_uses_earlier_rows_only(features):
    cup = Tournament("cup 2016", "2016-01-01", "2016-12-31", "t0", "cup")
    absent = Tournament("cup 2015", "2015-01-01", "2015-12-31", "nobody", "cup")
    rows, predictions = backtest(features, [cup, absent])
    got = {r.tournament: r for r in rows.collect()}
    before = features.filter("date < DATE'2016-01-01'").count()
    assert got["cup 2016"].n_train == before and got["cup 2016"].log_loss < math.log(3)
    assert got["cup 2015"].champion_predicted_rank is None
    assert not got["cup 2015"].champion_in_top_10
    assert predictions.count() == sum(r.n_test for r in got.values())
    for bad in (
        Tournament("early", "1900-01-01", "1900-12-31", "x", "cup"),
        Tournament("none", "2016-01-01", "2016-12-31", "x", "shield"),
    ):
        with pytest.raises(DataQualityError):
            backtest(features, [bad])


def test_models_score_together_as_alone_in_one_scan(spark, features, tmp_path):
    features.write.parquet(str(tmp_path / "f"))
    rows = spark.read.parquet(str(tmp_path / "f"))
    logistic, prior = fit_logistic(features, ["elo_diff"]), fit_prior(features)
    models = {
        "calibrated": calibrate(logistic, features, "sigmoid"), "raw": logistic, "prior": prior,
        "blend": EnsembleModel([prior, logistic], [1.0, 3.0]), "prior again": prior,
    }
    told = score_together(rows, models, ["match_id"])
    assert told.columns == ["match_id", "target_class", "model", *PROBABILITIES]
    for name, model in models.items():
        near(told.filter(F.col("model") == name), model.transform(features), tolerance=1e-9)
    board = leaderboard(told)
    assert {r.n for r in board.collect()} == {900}
    plan = board._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    with pytest.raises(ValueError):
        score_together(rows, {"none": EnsembleModel([])})


def test_optimality_tells_a_fit_from_another(features):
    wanted = ["elo_diff", "is_team_a_home"]
    model = fit_logistic(features, wanted)
    own = {(r["class"], r.input): r for r in optimality(model, features).collect()}
    assert len(own) == 9 and max(abs(r.gradient) for r in own.values()) < 1e-3
    assert sum(r.n for key, r in own.items() if key[1] == "intercept") == 900
    other = optimality(model, features.filter("team_a < 't3'")).collect()
    assert max(abs(r.gradient) for r in other) > 1e-3
    grouped = fit_grouped(with_label_index(features), ["tournament"], wanted)
    left = grouped.gradients(with_label_index(features)).collect()
    assert len(left) == 18 and max(abs(r.gradient) for r in left) < 1e-7


def near(one, two, names=PROBABILITIES, tolerance=1e-4):
    one, two = ({r.match_id: r for r in df.collect()} for df in (one, two))
    assert one.keys() == two.keys() and one
    for i, r in one.items():
        assert [r[p] for p in names] == pytest.approx([two[i][p] for p in names], abs=tolerance)


def test_grouped_fits_equal_single_ones(features):
    wanted = ["elo_diff", "form_5_diff", "is_team_a_home"]
    constant = with_label_index(features).withColumn("form_5_diff", F.when(F.col("tournament") == "cup", F.col("form_5_diff")))
    grouped = fit_grouped(constant, ["tournament"], wanted)
    assert grouped.table.agg(F.max("gradient")).first()[0] <= 1e-8
    scored = grouped.transform(constant).withColumnsRenamed({f"_p{i}": p for i, p in enumerate(PROBABILITIES)})
    for name in ("cup", "league"):
        part = constant.filter(F.col("tournament") == name)
        near(scored.filter(F.col("tournament") == name), fit_logistic(part, wanted).transform(part))
    assert grouped.transform(constant.withColumn("tournament", F.lit("none"))).filter("_p0 IS NOT NULL").count() == 0


def test_grouped_fits_of_few_classes_and_no_rows(features):
    rows = with_label_index(features.filter("target_class <> 'draw' OR tournament = 'cup'"))
    one = rows.filter("target_class = 'draw'").withColumn("tournament", F.lit("one class"))
    out = fit_grouped(rows.unionByName(one), ["tournament"], ["elo_diff"]).transform(rows.unionByName(one))
    top = {r.tournament: r for r in out.groupBy("tournament").agg(F.max("_p1").alias("p"), F.min("_p1").alias("q")).collect()}
    assert top["league"].p == 0.0 and 0 < top["cup"].p < 1 and top["one class"].q == 1.0
    unlabelled = rows.withColumn("label", F.lit(None).cast("double"))
    for empty in (rows.limit(0), unlabelled):
        fitted = fit_grouped(empty, ["tournament"], ["elo_diff"])
        assert fitted.table.count() == 0 and fitted.transform(rows).filter("_p0 IS NOT NULL").count() == 0


@pytest.mark.parametrize("calibration", ["sigmoid", "none"])
def test_backtest_forecasts_equal_single_fits(features, calibration):
    cups = [Tournament(f"cup {y}", f"{y}-01-01", f"{y}-12-31", "t0", "cup") for y in (2012, 2015, 2016)]
    rows, told = backtest(features, cups, candidates=["elo_diff", "form_5_diff"], calibration=calibration)
    flags = {r.tournament: r.calibrated for r in rows.collect()}
    assert flags == {"cup 2012": False, "cup 2015": calibration != "none", "cup 2016": calibration != "none"}
    for t in cups:
        model = fit_before(features.filter(F.col("date") < t.start), ["elo_diff", "form_5_diff"], calibration)
        window = features.filter((F.col("tournament") == "cup") & F.col("date").between(t.start, t.end))
        near(told.filter(F.col("backtest") == t.name), model.transform(window))


def jobs_of(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_backtest_jobs_do_not_grow_with_tournaments(spark, features):
    cups = [Tournament(f"cup {y}", f"{y}-01-01", f"{y}-12-31", "t0", "cup") for y in range(2011, 2017)]
    one = jobs_of(spark, "one", lambda: backtest(features, cups[-1:], candidates=["elo_diff"]))
    six = jobs_of(spark, "six", lambda: backtest(features, cups, candidates=["elo_diff"]))
    assert 0 < six <= one + 20  # a step or two more at most


def test_backtest_of_other_kinds(features):
    cup = Tournament("cup 2016", "2016-01-01", "2016-12-31", "t0", "cup")
    rows, told = backtest(features, [cup], candidates=["elo_diff"], calibration="isotonic")
    assert rows.first().calibrated and told.count() == rows.first().n_test


def test_a_short_window_is_not_calibrated(features):
    short = fit_before(features.filter("match_id < 400"), ["elo_diff"])
    long = fit_before(features, ["elo_diff"])
    assert type(short).__name__ == "FittedModel" and type(long).__name__ == "CalibratedModel"


def test_feature_matrix_end_to_end(spark, contests):
    m = contests.selectExpr(
        "match_id", "date", "team_a AS home_team", "team_b AS away_team", "team_a_score AS home_score",
        "team_b_score AS away_score", "is_neutral AS neutral", "tournament",
    )
    elo = spark.createDataFrame([("hot", "2000-02-01", 1600.0)], "team string, date string, elo double")
    elo = elo.withColumn("date", F.to_date("date"))
    walked = feature_matrix(m, walk=True, pool=())
    given = feature_matrix(m, elo=elo, walk=True, pool=(), validate=True)
    assert walked.count() == given.count() == 400
    assert walked.filter(F.col("elo_diff").isNull()).count() == 0
    assert given.filter(F.col("team_a_elo") == 1600).count() > 0
