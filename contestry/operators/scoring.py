"""Scoring and calibration tables over probability columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.labels import class_index
from contestry.functions.probability import bin_index, top_label
from contestry.schemas import (
    CLASSES,
    LOG_LOSS_FLOOR,
    PROBABILITIES,
    DataQualityError,
    require_columns,
)

TARGET = "target_class"


def class_prior(df: DataFrame, alpha: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Smoothed class frequencies as one row of probabilities per key (A3)."""
    counts = [F.count_if(F.col(TARGET) == c) + F.lit(float(alpha)) for c in CLASSES]
    total = reduce(lambda x, y: x + y, counts)
    return df.groupBy(*keys).agg(*[(n / total).alias(p) for n, p in zip(counts, PROBABILITIES)])


def prediction_frame(df: DataFrame, ids: Sequence[str] = ("match_id", "date", "team_a", "team_b")):
    """Ids that exist, the target if known, and the probabilities."""
    kept = [c for c in (*ids, TARGET) if c in df.columns]
    return df.select(*kept, *PROBABILITIES)


def unexpected_labels(df: DataFrame) -> DataFrame:
    """Distinct labels outside the three classes (U4)."""
    return df.filter(~F.coalesce(F.col(TARGET).isin(*CLASSES), F.lit(False))).select(TARGET).distinct()


def _true_probability():
    return reduce(
        lambda rest, pair: F.when(F.col(TARGET) == pair[0], F.col(pair[1])).otherwise(rest),
        zip(CLASSES, PROBABILITIES),
        F.lit(None).cast("double"),
    )


def _score_columns():
    hit = _true_probability()
    squares = [
        F.pow(F.col(p) - (F.col(TARGET) == c).cast("double"), F.lit(2.0))
        for c, p in zip(CLASSES, PROBABILITIES)
    ]
    # greatest() skips nulls, so a row without a label would score as the worst one.
    clipped = F.when(hit.isNotNull(), F.least(F.greatest(hit, F.lit(LOG_LOSS_FLOOR)), F.lit(1.0)))
    return [
        F.avg(-F.log(clipped)).alias("log_loss"),
        F.avg(reduce(lambda x, y: x + y, squares)).alias("brier"),
        F.avg((top_label() == F.col(TARGET)).cast("double")).alias("accuracy"),
        F.count(TARGET).alias("n"),
    ]


def known_label() -> Column:
    """The target itself; a label outside the three classes is an error when it is read."""
    odd = F.concat(F.lit("label outside the three classes: "), F.col(TARGET))
    known = F.col(TARGET).isNull() | F.col(TARGET).isin(*CLASSES)
    return F.when(known, F.col(TARGET)).otherwise(F.raise_error(odd).cast("string"))


def score(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Log loss, Brier score (0 to 2), accuracy and scored rows per key (A4).

    Rows without a label are not scored and not counted; unknown labels are refused.
    """
    require_columns(df, (TARGET, *PROBABILITIES), "predictions")
    return df.withColumn(TARGET, known_label()).groupBy(*keys).agg(*_score_columns())


def enforce_labels(df: DataFrame) -> DataFrame:
    """The frame itself, or an error naming labels outside the three classes."""
    odd = [r[0] for r in unexpected_labels(df).limit(10).collect()]
    if odd:
        raise DataQualityError(f"labels outside {CLASSES}: {odd}")
    return df


def calibration_error(df: DataFrame, keys: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """Top-label expected calibration error per key (A5)."""
    confidence = F.greatest(*[F.col(p) for p in PROBABILITIES])
    binned = df.select(
        *keys,
        confidence.alias("_conf"),
        (top_label() == F.col(TARGET)).cast("double").alias("_hit"),
        bin_index(confidence, n_bins).alias("_bin"),
    )
    per_bin = binned.groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_hit").alias("_acc"), F.avg("_conf").alias("_mean")
    )
    gap = F.when(
        F.col("_bin").isNotNull(), F.col("_n") * F.abs(F.col("_acc") - F.col("_mean"))
    ).otherwise(0.0)
    return per_bin.groupBy(*keys).agg((F.sum(gap) / F.sum("_n")).alias("calibration_error"))


def reliability(df: DataFrame, keys: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """Mean forecast, observed frequency and count per class and bin."""
    per_class = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.col(p).alias("_p"),
                (F.col(TARGET) == c).cast("double").alias("_hit"),
            )
            for c, p in zip(CLASSES, PROBABILITIES)
        ]
    )
    return (
        df.select(*keys, F.inline(per_class))
        .withColumn("bin", bin_index(F.col("_p"), n_bins))
        .filter(F.col("bin").isNotNull())
        .groupBy(*keys, "class", "bin")
        .agg(
            F.avg("_p").alias("mean_predicted"),
            F.avg("_hit").alias("observed_frequency"),
            F.count(F.lit(1)).alias("count"),
        )
    )


def confusion(df: DataFrame) -> DataFrame:
    """Counts per actual class, one column per predicted class, zeros included."""
    said = top_label()
    cells = [
        F.count_if((F.col(TARGET) == actual) & (said == predicted)).alias(f"{actual}>{predicted}")
        for actual in CLASSES
        for predicted in CLASSES
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(actual).alias("actual"),
                *[F.col(f"`{actual}>{predicted}`").alias(predicted) for predicted in CLASSES],
            )
            for actual in CLASSES
        ]
    )
    return df.agg(*cells).select(F.inline(rows))


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives 0."""
    said = top_label()
    counts = []
    for c in CLASSES:
        counts += [
            F.count_if((F.col(TARGET) == c) & (said == c)).alias(f"{c}_tp"),
            F.count_if(said == c).alias(f"{c}_said"),
            F.count_if(F.col(TARGET) == c).alias(f"{c}_real"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.col(f"{c}_tp").alias("_tp"),
                F.col(f"{c}_said").alias("_said"),
                F.col(f"{c}_real").alias("support"),
            )
            for c in CLASSES
        ]
    )
    tp, guesses, real = F.col("_tp"), F.col("_said"), F.col("support")

    def ratio(top, bottom):
        return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)

    return (
        df.agg(*counts)
        .select(F.inline(rows))
        .select(
            "class",
            ratio(tp, guesses).alias("precision"),
            ratio(tp, real).alias("recall"),
            ratio(2 * tp, guesses + real).alias("f1"),
            "support",
        )
    )


def leaderboard(told: DataFrame) -> DataFrame:
    """One row of scores per ``model`` of a frame of all models' forecasts, best log loss first.

    Such a frame comes from :func:`contestry.operators.models.score_together`; one aggregate reads it.
    """
    return score(told, ["model"]).orderBy("log_loss", "model")


def comparison(board: DataFrame, main: str, baselines: Sequence[str]) -> DataFrame:
    """The main model against the best baseline (A10)."""
    mine = F.max(F.when(F.col("model") == main, F.col("log_loss")))
    others = F.when(F.col("model").isin(*baselines), F.col("log_loss"))
    best = F.min(others)
    return board.agg(
        mine.alias("main_log_loss"),
        best.alias("best_baseline_log_loss"),
        F.min_by("model", others).alias("best_baseline"),
        F.coalesce(mine < best, F.lit(False)).alias("beats_best_baseline"),
    )


def backtest_summary(rows: DataFrame) -> DataFrame:
    """Mean scores over tournaments and how often the champion was a top-five favourite."""
    means = [
        F.round(F.avg(c), 4).alias(f"mean_{c}")
        for c in ("log_loss", "brier", "accuracy", "calibration_error")
    ]
    return rows.agg(
        *means,
        F.count(F.lit(1)).alias("n_tournaments"),
        F.round(F.avg(F.col("champion_in_top_5").cast("double")), 4).alias("champion_top_5_rate"),
    )


def with_label_index(df: DataFrame, name: str = "label") -> DataFrame:
    """The target as 0.0, 1.0 or 2.0 in class order."""
    return df.withColumn(name, class_index(F.col(TARGET)).cast("double"))
