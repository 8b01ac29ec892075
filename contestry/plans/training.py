"""Feature matrix, training and backtest jobs (V7, M7-M9)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.operators.asof import add_rating_features
from contestry.operators.form import add_form
from contestry.functions.probability import clip_normalize
from contestry.operators.grouped_logistic import fit_grouped
from contestry.operators.models import (
    CalibratedModel,
    calibrate,
    check_features_of,
    fit_baselines,
    fit_main,
    score_together,
    set_probabilities,
)
from contestry.operators.ordering import temporal_split
from contestry.operators.ratings import add_elo, champion_rank, entering_ratings, favourites
from contestry.operators.reshape import model_dataset
from contestry.operators.scoring import (
    TARGET,
    calibration_error,
    comparison,
    leaderboard,
    prediction_frame,
    score,
    with_label_index,
)
from contestry.schemas import FEATURE_CANDIDATES, PROBABILITIES, DataQualityError, require_columns
from contestry.session import cut_lineage
from contestry.sources.results import labelled

# Calibration tail of a backtest window, and the rows below which there is none.
TAIL_FRACTION = 0.15
MIN_ROWS_FOR_TAIL = 500


def feature_matrix(
    matches: DataFrame,
    *,
    elo: DataFrame | None = None,
    rankings: DataFrame | None = None,
    walk: bool = False,
    pool: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """Cleaned matches to the feature table (V7).

    ``walk`` attaches the walk-forward rating, for use where no rating source is given; it asks
    for the columns of its ``pool``, whose contests one task walks in order.
    """
    if walk and pool is None:
        raise ValueError("walk needs a pool; () walks the whole table in one task")
    contests = model_dataset(matches)
    features = add_rating_features(add_form(contests), elo, rankings, contests, **options)
    return add_elo(features, pool) if walk and elo is None else features


@dataclass
class TrainingRun:
    """What one training run yields; ``validation`` scores the rows that the maps were fitted on."""

    model: object
    base: object
    features: list[str]
    board: DataFrame
    comparison: DataFrame
    calibration: DataFrame
    predictions: DataFrame
    validation: DataFrame


def train(
    features: DataFrame,
    *,
    candidates: Sequence[str] = FEATURE_CANDIDATES,
    kind: str = "logistic",
    calibration: str = "isotonic",
    val_fraction: float = 0.15,
    test_fraction: float = 0.15,
    **options,
) -> TrainingRun:
    """Train on the earliest rows, calibrate on the next, score on the last (M7)."""
    require_columns(features, (TARGET, "date", "match_id"), "features")
    rows = labelled(features)
    chosen = check_features_of(rows, candidates).demanded()
    needed = ["match_id", "date", "team_a", "team_b", TARGET, *chosen]
    split = cut_lineage(temporal_split(
        rows.select(*[c for c in needed if c in rows.columns]),
        val_fraction=val_fraction, test_fraction=test_fraction,
    ))
    part = {name: split.filter(F.col("split") == name).drop("split")
            for name in ("train", "val", "test")}
    base = fit_main(part["train"], chosen, kind, **options)
    model = calibrate(base, part["val"], calibration)
    baselines = fit_baselines(part["train"])
    models = {
        "main_model (calibrated)": model,
        "main_model (uncalibrated)": base,
        **baselines,
    }
    ids = [i for i in ("match_id", "date", "team_a", "team_b") if i in split.columns]
    told = cut_lineage(score_together(part["test"], models, ids))
    mains = {"calibrated": model, "uncalibrated": base}
    board = leaderboard(told)
    main = F.regexp_extract("model", r"^main_model \((.*)\)$", 1)
    return TrainingRun(
        model,
        base,
        chosen,
        board,
        comparison(board, "main_model (calibrated)", list(baselines)),
        calibration_error(told.withColumn("model", main).filter("model <> ''"), ["model"]),
        prediction_frame(told.filter(F.col("model") == "main_model (calibrated)")),
        leaderboard(score_together(part["val"], mains)),
    )


def tail_cut(train_rows: DataFrame, fraction: float = TAIL_FRACTION):
    """Day number at the interpolated ``1 - fraction`` quantile of the dates.

    The exact percentile keeps one count per distinct day, which the calendar bounds.
    """
    return train_rows.agg(
        F.percentile(F.unix_date("date"), F.lit(1.0 - fraction)).alias("cut")
    )


def tail_parts(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame] | None:
    """Rows up to the tail and the tail, or None where a map cannot be fitted on it.

    That takes ``least`` rows in all, rows on both sides, and two outcomes in the tail.
    """
    day, cut = F.unix_date("date"), tail_cut(rows).first().cut
    if cut is None:
        return None
    late = day > F.lit(cut)
    seen = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~late).alias("early"),
        F.count_distinct(F.when(late, F.col(TARGET))).alias("outcomes"),
    ).first()
    fit = seen.n >= least and seen.early > 0 and seen.outcomes > 1
    return (rows.filter(~late), rows.filter(late)) if fit else None


def fit_before(
    train_rows: DataFrame, features: Sequence[str], calibration: str = "sigmoid",
    kind: str = "logistic", min_rows: int = MIN_ROWS_FOR_TAIL, **options,
):
    """A model of the rows before a tournament (M8).

    It is calibrated on their tail where :func:`tail_parts` finds one; ``backtest`` says in its
    rows whether it was.
    """
    parts = None if calibration == "none" else tail_parts(train_rows, min_rows)
    base = fit_main(parts[0] if parts else train_rows, features, kind, **options)
    return calibrate(base, parts[1], calibration) if parts else base


BACKTEST_ROW = (
    "tournament string, n_train bigint, n_test bigint, log_loss double, brier double, "
    "accuracy double, calibration_error double, champion string, "
    "champion_predicted_rank bigint, n_participants bigint, champion_in_top_3 boolean, "
    "champion_in_top_5 boolean, champion_in_top_10 boolean, calibrated boolean"
)


@dataclass(frozen=True)
class Tournament:
    """A past tournament: its window and its champion."""

    name: str
    start: str
    end: str
    champion: object
    tournament: str


def window_counts(features: DataFrame, tournaments: Sequence[Tournament]) -> dict[str, tuple[int, int]]:
    """Rows before each tournament and rows inside its window, all counted in one pass."""
    day = F.col("date")
    counts = [
        column
        for t in tournaments
        for column in (F.count_if(day < F.lit(t.start).cast("date")), F.count_if(in_window(t.start, t.end, t.tournament)))
    ]
    got = list(features.agg(*counts).first()) if counts else []
    return {t.name: (got[2 * i], got[2 * i + 1]) for i, t in enumerate(tournaments)}


# Calibrations that are fitted for all tournaments together.
GROUPED = ("sigmoid", "none")


def named_where(tournaments: Sequence[Tournament], holds) -> Column:
    """The names of the tournaments for which ``holds`` is true of a row."""
    return F.array_compact(F.array(*[F.when(holds(t), F.lit(t.name)) for t in tournaments]))


def calibrated_tails(training: DataFrame, least: int) -> DataFrame:
    """Per tournament the day its tail starts after, and whether a map can be fitted on that tail.

    The rules are those of :func:`tail_parts`, for all tournaments in two grouped passes.
    """
    day, late = F.unix_date("date"), F.unix_date("date") > F.col("cut")
    cuts = training.groupBy("backtest").agg(F.percentile(day, F.lit(1.0 - TAIL_FRACTION)).alias("cut"))
    seen = training.join(cuts, "backtest").groupBy("backtest").agg(
        F.first("cut").alias("cut"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(~late).alias("early"),
        (F.min(F.when(late, F.col("label"))) < F.max(F.when(late, F.col("label")))).alias("differ"),
    )
    fit = (F.col("n") >= least) & (F.col("early") > 0) & F.coalesce("differ", F.lit(False))
    return cut_lineage(seen.select("backtest", "cut", fit.alias("calibrated")))


def sigmoid_lines(scored: DataFrame) -> DataFrame:
    """Per tournament a struct ``line0`` on for each class: slope, intercept, or a constant share.

    The map of a class is a logistic of its probability with half the squared slope as penalty,
    which as a softmax of two classes is a penalty of 2.
    """
    per_class = F.array(*[
        F.struct(F.lit(i).alias("class"), F.col(p).alias("p"), (F.col("label") == i).cast("int").alias("label"))
        for i, p in enumerate(PROBABILITIES)
    ])
    binary = cut_lineage(scored.select("backtest", F.inline(per_class)))
    fitted = fit_grouped(binary, ["backtest", "class"], ["p"], n_classes=2, penalty=2.0, standardize=False)
    w = [F.get("weights", F.lit(i)) for i in range(4)]
    no, yes = F.get("counts", F.lit(0)), F.get("counts", F.lit(1))
    line = F.struct(
        (w[2] - w[0]).alias("slope"), (w[3] - w[1]).alias("intercept"),
        F.when(yes == 0, F.lit(0.0)).when(no == 0, F.lit(1.0)).alias("share"),
    )
    return fitted.table.groupBy("backtest").agg(
        *[F.max(F.when(F.col("class") == i, line)).alias(f"line{i}") for i in range(len(PROBABILITIES))]
    )


def forecasts_together(
    features: DataFrame, tournaments: Sequence[Tournament], wanted: Sequence[str], *,
    calibration: str = "sigmoid", min_rows: int = MIN_ROWS_FOR_TAIL, c: float = 1.0, kind: str = "logistic", **options,
) -> tuple[DataFrame, DataFrame]:
    """Forecasts of all windows, and which tournaments were calibrated, as :func:`fit_before` does.

    The rows are stored once, with the tournaments that learn from them and those that they belong
    to; each step of a fit repeats them in passing, so jobs do not grow with the tournaments.
    """
    steps = {"steps": options["max_iter"]} if "max_iter" in options else {}
    before = named_where(tournaments, lambda t: F.col("date") < F.lit(t.start).cast("date"))
    inside = named_where(tournaments, lambda t: in_window(t.start, t.end, t.tournament))
    ids = [i for i in ("match_id", "date", "team_a", "team_b") if i in features.columns]
    kept = list(dict.fromkeys([*ids, TARGET, *wanted]))
    base = labelled(features).select(*kept, before.alias("_before"), inside.alias("_inside"))
    base = cut_lineage(with_label_index(base).where((F.size("_before") > 0) | (F.size("_inside") > 0)))
    training = base.select(F.explode("_before").alias("backtest"), "date", "label", *[w for w in wanted if w != "date"])
    if calibration == "none":
        tails = training.select("backtest").distinct()
        tails = cut_lineage(tails.withColumns({"cut": F.lit(0.0), "calibrated": F.lit(False)}))
    else:
        tails = calibrated_tails(training, min_rows)
    parted = training.join(tails, "backtest")
    held = F.col("calibrated") & (F.unix_date("date") > F.col("cut"))
    model = fit_grouped(parted.where(~held), ["backtest"], wanted, penalty=1.0 / c, **steps)

    def forecast(rows: DataFrame) -> DataFrame:
        parts = clip_normalize([F.col(f"_p{k}") for k in range(len(PROBABILITIES))])
        out = set_probabilities(model.transform(rows), parts)
        return out.drop(*[f"_p{k}" for k in range(len(PROBABILITIES))])

    told = forecast(base.select(F.explode("_inside").alias("backtest"), *kept))
    if calibration != "none":
        lines = sigmoid_lines(forecast(parted.where(held)))
        told, mapped = told.join(lines, "backtest", "left"), []
        for i, p in enumerate(PROBABILITIES):
            line = F.col(f"line{i}")
            curve = 1.0 / (1.0 + F.exp(-(line["slope"] * F.col(p) + line["intercept"])))
            mapped.append(F.coalesce(line["share"], curve))
        fitted = F.col("line0").isNotNull()
        parts = [F.when(fitted, q).otherwise(F.col(p)) for p, q in zip(PROBABILITIES, clip_normalize(mapped))]
        told = set_probabilities(told, parts)
    return cut_lineage(told.select("backtest", *kept, *PROBABILITIES)), tails.select("backtest", "calibrated")


def forecasts_apart(
    features: DataFrame, tournaments: Sequence[Tournament], wanted: Sequence[str], **options
) -> tuple[DataFrame, DataFrame]:
    """The same by one fit after the other, for kinds and maps that have no grouped form."""
    parts, calibrated = [], []
    for t in tournaments:
        model = fit_before(labelled(features.filter(F.col("date") < F.lit(t.start).cast("date"))), wanted, **options)
        window = labelled(features.filter(in_window(t.start, t.end, t.tournament)))
        parts.append(model.transform(window).withColumn("backtest", F.lit(t.name)))
        calibrated.append((t.name, isinstance(model, CalibratedModel)))
    facts = features.sparkSession.createDataFrame(calibrated, "backtest string, calibrated boolean")
    return cut_lineage(reduce(DataFrame.unionByName, parts)), facts


def backtest(
    features: DataFrame,
    tournaments: Sequence[Tournament],
    *,
    candidates: Sequence[str] = FEATURE_CANDIDATES,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Per tournament: fit on earlier rows only, score its contests, place its champion (M9).

    Returns (one row per tournament, all predictions). ``features`` must carry the ratings.
    Tournaments are a key: windows are counted in one pass, and the forecasts of all of them are
    one table, from which scores, errors and places come by grouping. Logistic fits of all
    tournaments go together, step by step; other kinds follow one another.
    """
    require_columns(features, ("team_a_elo", "team_b_elo", "elo_diff"), "features")
    counts = window_counts(features, tournaments)
    empty = [f"{name} ({before} before, {inside} inside)" for name, (before, inside) in counts.items() if not (before and inside)]
    if empty or not counts:
        raise DataQualityError(f"tournaments without contests to learn from or to score: {empty}")
    wanted = check_features_of(features, candidates).demanded()
    together = options.get("kind", "logistic") == "logistic" and options.get("calibration", "sigmoid") in GROUPED
    told, calibrated = (forecasts_together if together else forecasts_apart)(features, tournaments, wanted, **options)
    spark, key = features.sparkSession, ["backtest"]
    facts = spark.createDataFrame([(t.name, counts[t.name][0]) for t in tournaments], "backtest string, n_train bigint")
    facts = facts.join(calibrated, key, "left").withColumn("calibrated", F.coalesce("calibrated", F.lit(False)))
    team = features.schema["team_a"].dataType
    champions = spark.createDataFrame([(t.name, str(t.champion)) for t in tournaments], "backtest string, champion string")
    champions = champions.withColumn("champion", F.col("champion").try_cast(team))
    windows = [
        features.filter(in_window(t.start, t.end, t.tournament)).withColumn("backtest", F.lit(t.name)) for t in tournaments
    ]
    strongest = favourites(entering_ratings(reduce(DataFrame.unionByName, windows), key), key)
    placed = champion_rank(strongest, champions, "backtest").withColumnsRenamed(
        {"predicted_rank": "champion_predicted_rank", **{f"in_top_{n}": f"champion_in_top_{n}" for n in (3, 5, 10)}}
    )
    rows = facts.join(placed, key).join(score(told, key), key, "left").join(calibration_error(told, key), key, "left")
    rows = rows.withColumns(
        {"n_test": F.coalesce("n", F.lit(0)), "champion": F.col("champion").cast("string"), "tournament": F.col("backtest")}
    )
    names = [field.split()[0] for field in BACKTEST_ROW.split(", ")]
    return rows.select(*names), prediction_frame(told, ("backtest", "match_id", "date", "team_a", "team_b"))


def in_window(start: str, end: str, tournament: str):
    """True for rows of one tournament inside its window, both ends included."""
    day = F.col("date")
    inside = day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return inside & (F.col("tournament") == tournament)


def window_filter(features: DataFrame, start: str, end: str, tournament: str) -> DataFrame:
    """Rows of one tournament inside its window."""
    return features.filter(in_window(start, end, tournament))
