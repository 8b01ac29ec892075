"""Data-quality checks.

Each check returns a small table ``(check, n)`` with one row per broken rule; the matching
``enforce_*`` function raises with all of them at once. A whole check is one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.labels import result_label
from contestry.operators.names import ALIASES, alias_hits, clean_name, distinct_names, is_text
from contestry.schemas import (
    DATASET_COLUMNS,
    DIFFERENCES,
    EARLIEST_DATE,
    LABEL_COLUMNS,
    MATCHES_REQUIRED,
    TEAM_FEATURES,
    DataQualityError,
    LeakageError,
    require_columns,
)


def as_rows(one_row: DataFrame, key: str = "check", value: str = "n") -> DataFrame:
    """Turn a one-row frame of BIGINT counts into (key, value) rows."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias(key), F.col(f"`{c}`").cast("bigint").alias(value))
            for c in one_row.columns
        ]
    )
    return one_row.select(F.inline(pairs))


def broken(df: DataFrame, rules: dict[str, Column], keep_zero: bool = False) -> DataFrame:
    """(check, n) from one aggregation; rules nothing breaks are left out."""
    rows = as_rows(df.agg(*[F.coalesce(c, F.lit(0)).alias(name) for name, c in rules.items()]))
    return rows if keep_zero else rows.filter(F.col("n") > 0)


def enforce(violations: DataFrame, label: str, error: type[DataQualityError] = DataQualityError):
    """Raise listing every violation row, if there is any."""
    found = [f"{r['check']}: {r['n']}" for r in violations.orderBy("check").collect()]
    if found:
        raise error("\n".join([f"{len(found)} problem(s) in {label}:", *found]))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with nulls and how many, as (column, n) (A1)."""
    columns = list(columns or df.columns)
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    return as_rows(one, "column", "n").filter(F.col("n") > 0)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """How many rows repeat a key already seen, as one row (A2)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def _repeats(key: str) -> Column:
    return F.count(key) - F.count_distinct(key) + F.greatest(
        F.count_if(F.col(key).isNull()) - 1, F.lit(0)
    )


def check_matches(
    df: DataFrame,
    *,
    max_date: str,
    min_date: str = EARLIEST_DATE,
    aliases=None,
    keep_zero: bool = False,
) -> DataFrame:
    """Every rule of the cleaned matches table (V1).

    ``max_date`` is a parameter, not the clock, so that a rerun gives the same answer. Names
    are held against ``aliases``, by default the built-in map.
    """
    absent = [c for c in MATCHES_REQUIRED if c not in df.columns]
    spark = df.sparkSession
    if absent:
        return spark.createDataFrame([(f"missing_{c}", 1) for c in absent], "check string, n bigint")
    types = dict(df.dtypes)
    day, home, away = F.col("date"), F.col("home_score"), F.col("away_score")
    rules = {f"null_{c}": F.count_if(F.col(c).isNull()) for c in MATCHES_REQUIRED}
    if types["date"] in ("date", "timestamp", "timestamp_ntz"):
        low, high = F.lit(min_date).cast("date"), F.lit(max_date).cast("date")
        rules["date_out_of_range"] = F.count_if((day < low) | (day > high))
    else:
        rules["date_type"] = F.lit(1)
    rules["duplicate_match_id"] = _repeats("match_id")
    for c in ("home_score", "away_score"):
        rules[f"{c}_not_integral"] = F.count_if(F.col(c) % 1 != 0)
        rules[f"{c}_negative"] = F.count_if(F.col(c) < 0)
    rules["same_team"] = F.count_if(F.col("home_team") == F.col("away_team"))
    if types["neutral"] != "boolean":
        rules["neutral_type"] = F.lit(1)
    if "is_competitive" in types:
        # A null tournament would otherwise pass silently as a null flag.
        rules["null_is_competitive"] = F.count_if(F.col("is_competitive").isNull())
    label = result_label(home, away)
    rules["result_mismatch"] = F.count_if(label.isNotNull() & ~F.col("result").eqNullSafe(label))
    for c, expected in {"home_win": home > away, "draw": home == away, "away_win": home < away}.items():
        if c in types:
            rules[f"{c}_mismatch"] = F.count_if(
                expected.isNotNull() & ~F.coalesce(F.col(c), F.lit(True)).eqNullSafe(expected)
            )
    raw = F.explode(F.array("home_team", "away_team")).alias("raw")
    names = df.select(raw).filter(F.col("raw").isNotNull()).distinct()
    uneven = names.filter(F.col("raw") != clean_name(F.col("raw"))).select("raw")
    if is_text(df, "home_team") and is_text(df, "away_team"):
        hits = alias_hits(distinct_names(df, ["home_team", "away_team"]), ALIASES if aliases is None else aliases)
        uneven = uneven.unionByName(hits.select(F.col("name").alias("raw"))).distinct()
    odd_names = uneven.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("un_normalized_name").alias("check"), "n"
    )
    rows = broken(df, rules, keep_zero=True).unionByName(odd_names)
    return rows if keep_zero else rows.filter(F.col("n") > 0)


def enforce_matches(df: DataFrame, **options) -> DataFrame:
    """The frame itself, once :func:`check_matches` finds nothing."""
    enforce(check_matches(df, **options), "matches")
    return df


def future_ratings(df: DataFrame, rating_dates: Sequence[str], date: str = "date") -> DataFrame:
    """How many ratings are dated after their contest, per rating-date column (V2).

    A null rating date means no rating was known, which is not leakage.
    """
    require_columns(df, [date, *rating_dates], "rating features")
    return broken(df, {c: F.count_if(F.col(c) > F.col(date)) for c in rating_dates})


def enforce_no_future_ratings(df: DataFrame, rating_dates: Sequence[str], date: str = "date"):
    """Raise if any rating is dated after its contest."""
    enforce(future_ratings(df, rating_dates, date), "ratings dated after the contest", LeakageError)


def check_probabilities(
    df: DataFrame, columns: Sequence[str], tolerance: float = 1e-6, keep_zero: bool = False
) -> DataFrame:
    """A distribution per row: no nulls, each in [0, 1], sum 1 (V3)."""
    require_columns(df, columns, "probabilities")
    parts = [F.col(c) for c in columns]
    total = reduce(lambda x, y: x + y, [F.coalesce(p, F.lit(0.0)) for p in parts])

    def any_of(tests):
        return F.count_if(reduce(lambda x, y: x | y, tests))

    rules = {
        "null_probability": any_of([p.isNull() | F.isnan(p) for p in parts]),
        "outside_unit_interval": any_of(
            [F.coalesce((p < -tolerance) | (p > 1 + tolerance), F.lit(False)) for p in parts]
        ),
        "row_sum_not_one": F.count_if(F.abs(total - 1.0) > tolerance),
    }
    return broken(df, rules, keep_zero)


def check_bounds(
    df: DataFrame,
    columns: Sequence[str],
    lower: float = 0.0,
    upper: float = 1.0,
    tolerance: float = 1e-9,
    keep_zero: bool = False,
) -> DataFrame:
    """How many values of each column lie outside [lower, upper] (V4)."""
    require_columns(df, columns, "bounds")
    rules = {
        c: F.count_if((F.col(c) < lower - tolerance) | (F.col(c) > upper + tolerance))
        for c in columns
    }
    return broken(df, rules, keep_zero)


def check_features(
    df: DataFrame, expected_rows: int | None = None, keep_zero: bool = False
) -> DataFrame:
    """The feature matrix: unique ids, no null keys or labels, the expected row count (V5).

    Features themselves may be null. Row order is not checked: a DataFrame has none.
    """
    needed = [*DATASET_COLUMNS, *[f"{f}_{s}" for s in "ab" for f in TEAM_FEATURES], *DIFFERENCES]
    require_columns(df, needed, "feature matrix")
    rules = {"duplicate_match_id": _repeats("match_id")}
    for c in ("match_id", "date", "team_a", "team_b", *LABEL_COLUMNS):
        rules[f"null_{c}"] = F.count_if(F.col(c).isNull())
    if expected_rows is not None:
        rules["row_count"] = F.abs(F.count(F.lit(1)) - F.lit(expected_rows))
    return broken(df, rules, keep_zero)


def profile(
    df: DataFrame,
    date_columns: Sequence[str] = (),
    name_columns: Sequence[str] = (),
    top: int = 20,
) -> DataFrame:
    """Profile of a table as (section, item, n, share, low, high) rows.

    Sections: ``rows``, ``nulls`` per column with any, ``duplicate_rows``, ``dates`` with the
    range and the number that do not parse, ``names`` with the most frequent values over all
    name columns together.
    """
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def parsed(c: str) -> Column:
        if dict(df.dtypes)[c] == "string":
            return F.try_to_timestamp(F.col(c)).cast("date")
        return F.col(c).cast("date")

    n_rows = F.count(F.lit(1))
    one = df.agg(
        n_rows.alias("rows"),
        F.array(
            *[
                F.struct(F.lit(c).alias("item"), F.count_if(F.col(f"`{c}`").isNull()).alias("n"))
                for c in df.columns
            ]
        ).alias("nulls"),
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("item"),
                    F.count_if(parsed(c).isNull() & F.col(c).isNotNull()).alias("n"),
                    F.min(parsed(c)).cast("string").alias("low"),
                    F.max(parsed(c)).cast("string").alias("high"),
                )
                for c in date_columns
            ]
        ).alias("dates")
        if date_columns
        else F.lit(None).alias("dates"),
    )
    rows = one.select(
        F.lit("rows").alias("section"), F.lit("*").alias("item"), F.col("rows").alias("n"),
        none.alias("share"), text.alias("low"), text.alias("high"),
    )
    nulls = one.select("rows", F.inline("nulls")).filter(F.col("n") > 0).select(
        F.lit("nulls").alias("section"), "item", "n",
        (F.col("n") / F.col("rows")).alias("share"), text.alias("low"), text.alias("high"),
    )
    repeats = duplicate_keys(df, *df.columns).select(
        F.lit("duplicate_rows").alias("section"), F.lit("*").alias("item"),
        F.col("n_duplicates").alias("n"), none.alias("share"), text.alias("low"), text.alias("high"),
    )
    out = rows.unionByName(nulls).unionByName(repeats)
    if date_columns:
        out = out.unionByName(
            one.select(F.inline("dates")).select(
                F.lit("dates").alias("section"), "item", "n", none.alias("share"), "low", "high"
            )
        )
    if name_columns:
        names = F.explode(F.array(*[F.col(c).cast("string") for c in name_columns])).alias("item")
        counted = (
            df.select(names).filter(F.col("item").isNotNull()).groupBy("item")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(top)
        )
        out = out.unionByName(
            counted.select(
                F.lit("names").alias("section"), "item", "n",
                none.alias("share"), text.alias("low"), text.alias("high"),
            )
        )
    return out
