"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# What this Python worker keeps from task to task, by its key.
_kept: dict[Hashable, Any] = {}


def keep(key: Hashable, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, kept in a Python worker from task to task, one thing at a time.

    Spark hands a worker on to whatever job comes next. Tasks that keep nothing themselves call
    ``let_go``, so that an operator does not pay for the memory of another one.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def let_go() -> None:
    """Drop what the worker keeps."""
    _kept.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """``_id`` and ``_text``, with null text as the empty text, and maybe ``_carried``.

    Selecting them first keeps any other column of ``docs`` out of the way, whatever its name;
    those named in ``carry`` travel as one struct.
    """
    extra = [F.struct(*(F.col(c) for c in carry)).alias("_carried")] if carry else []
    return docs.select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *extra
    )


#: What tells documents apart: whether the id is null, the id, and a hash of the text.
DOCUMENT = ["_null", "_key", "_hash"]


def document_key(id_: Column, text: Column) -> list[Column]:
    """The columns of ``DOCUMENT``; in their order null ids come last."""
    whole = id_.cast("long")
    key = F.coalesce(whole, F.lit(0).cast("long"))
    return [whole.isNull().alias("_null"), key.alias("_key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hash")]


def carried(carry: Sequence[str]) -> list[Column]:
    """The columns of ``carry`` under their own names again."""
    return [F.col("_carried").getField(c).alias(c) for c in carry]


def id_remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)
