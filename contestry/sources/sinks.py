"""Writers (S5-S7, K1). Each overwrites its path and returns it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_matches(df: DataFrame, path: str) -> str:
    """Cleaned matches as Parquet."""
    df.write.mode("overwrite").parquet(path)
    return path


def write_features(df: DataFrame, path: str, fmt: str = "parquet", ordered: bool = True) -> str:
    """The feature table, by default in match_id order across its files.

    The order is a range partition plus a sort per file: no task sees the whole table.
    """
    out = df.repartitionByRange("match_id").sortWithinPartitions("match_id") if ordered else df
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_metrics(df: DataFrame, path: str) -> str:
    """A few rows of metrics as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Predictions, CSV with a header by default."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def _rounded(x: Column, digits: int) -> Column:
    """``round(x, digits)`` without its way over decimal text where that is not needed.

    A scaled value clear of a tie has one nearest integer, which a double holds, and dividing that
    by the scale is the double nearest to the decimal that ``round`` finds. Near ties, large
    values, NaN and infinities go to ``round``.
    """
    scale = F.lit(float(10**digits))
    scaled = x * scale
    clear = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-4)
    return F.when(clear, F.floor(scaled + 0.5) / scale).otherwise(F.round(x, digits))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every DOUBLE column rounded, for reports."""
    return df.select(
        *[
            _rounded(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )
