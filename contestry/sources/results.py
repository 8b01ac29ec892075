"""Readers with explicit schemas."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.functions.labels import parse_flag
from contestry.operators.cleaning import present, text_fields
from contestry.operators.ordering import earliest
from contestry.schemas import (
    CLASSES,
    RAW_ELO,
    RAW_RANKINGS,
    RAW_RESULTS,
    STRENGTHS,
    DataQualityError,
    require_columns,
)

log = logging.getLogger(__name__)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system its scheme names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def csv_with_columns(spark: SparkSession, path: str, schema, label: str) -> DataFrame:
    """Read a CSV by header name: every schema column must be there, others are ignored."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{label} not found: {path}")
    found = spark.read.option("header", True).csv(path)  # header only; all columns are text
    # With the names given and held against the header of every file, a file whose columns come
    # in another order is an error and not read by position.
    found = spark.read.option("header", True).option("enforceSchema", False).schema(found.schema).csv(path)
    names = {c.lower(): c for c in found.columns}
    absent = [c for c in schema.fieldNames() if c.lower() not in names]
    if absent:
        raise DataQualityError(f"{label}: missing columns {absent}; found {found.columns}")
    return found.select(
        *[F.col(f"`{names[f.name.lower()]}`").cast(f.dataType).alias(f.name) for f in schema]
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Raw results as text, missing tokens as null."""
    return text_fields(csv_with_columns(spark, path, RAW_RESULTS, "raw results"))


def number(column: str, kind: str = "double") -> Column:
    """A number from text: missing tokens are null, anything else that is none is an error.

    Whole numbers may be written with a point, as in ``2.0``.
    """
    text = present(F.trim(column))
    value = text.try_cast("double")
    if kind != "double":
        value = F.when(value == F.floor(value), value)
    bad = F.raise_error(F.concat(F.lit(f"{column}: not a number: "), text)).cast(kind)
    return F.when(text.isNull(), F.lit(None).cast(kind)).when(value.isNull(), bad).otherwise(value.cast(kind))


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    """Ranking releases."""
    raw = csv_with_columns(spark, path, RAW_RANKINGS, "rankings")
    return raw.select(
        "team",
        F.to_date("rank_date").alias("rank_date"),
        number("rank", "int").alias("rank"),
        number("points").alias("points"),
    )


def read_elo(spark: SparkSession, path: str) -> DataFrame:
    """Rating snapshots."""
    raw = csv_with_columns(spark, path, RAW_ELO, "ratings")
    return raw.select("team", F.to_date("date").alias("date"), number("elo").alias("elo"))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned matches from Parquet, or from CSV where the path ends so (S3)."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"matches not found: {path}")
    if path.rstrip("/").endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
    else:
        df = spark.read.parquet(path)
    require_columns(
        df,
        ("match_id", "date", "home_team", "away_team", "home_score", "away_score", "neutral",
         "tournament"),
        "matches",
    )
    flag = F.col("neutral")
    if dict(df.dtypes)["neutral"] != "boolean":
        bad = df.filter(parse_flag(flag).isNull()).select("neutral").limit(5).collect()
        if bad:
            raise DataQualityError(f"unparseable flags: {[r.neutral for r in bad]}")
        flag = parse_flag(flag)
    return df.withColumns(
        {
            "match_id": F.col("match_id").cast("bigint"),
            "date": F.to_date("date"),
            "neutral": flag,
            "home_score": F.col("home_score").cast("bigint"),
            "away_score": F.col("away_score").cast("bigint"),
        }
    )


def read_optional(spark: SparkSession, path: str | None, reader, label: str) -> DataFrame | None:
    """A rating source, or None with a warning when it is absent.

    A file that is there but malformed is an error.
    """
    if path is None or not path_exists(spark, path):
        log.warning("no %s at %s; its features are skipped", label, path)
        return None
    return reader(spark, path)


def read_strengths(spark: SparkSession, path: str) -> DataFrame:
    """(team, strength); header case does not matter."""
    return csv_with_columns(spark, path, STRENGTHS, "strengths")


def labelled(features: DataFrame, sample: int | None = None) -> DataFrame:
    """Rows whose label is one of the three classes, optionally the earliest few."""
    require_columns(features, ("target_class",), "features")
    rows = features.filter(F.col("target_class").isin(*CLASSES))
    return rows if sample is None else earliest(rows, sample)


def read_features(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """The stored feature table, ready for training."""
    return labelled(spark.read.parquet(path), sample)
