"""Backward as-of joins: the latest rating dated at or before each contest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.operators.form import sides_to_columns
from contestry.operators.names import canonicalize, is_text
from contestry.operators.ordering import MAX_GROUP_ROWS, counted_groups, pieces_needed, split_hot, tasks_for
from contestry.operators.quality import enforce_no_future_ratings
from contestry.schemas import require_columns


def _carried_forward(events: DataFrame, ratings: DataFrame, tasks: int) -> DataFrame:
    """Union both tables on one time line per team and carry the last snapshot forward."""
    width = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns
             if c not in ("team", "_day")]
    line = events.withColumns(
        {"_snap": F.lit(None).cast(ratings.schema["_snap"].dataType), "_kind": F.lit(1)}
    ).unionByName(ratings.select("team", "_day", *width, "_snap", F.lit(0).alias("_kind")))
    # Ratings sort before contests of the same day, so a same-day rating is used, and of two
    # on one day the larger snapshot comes last. Undated contests sort last but have no "before".
    upto = (
        Window.partitionBy("team")
        .orderBy(F.asc_nulls_last("_day"), "_kind", "_snap")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    latest = F.last("_snap", ignorenulls=True).over(upto)
    return (
        line.repartition(tasks, "team")
        .withColumn("_snap", F.when(F.col("_day").isNotNull(), latest))
        .filter(F.col("_kind") == 1)
        .drop("_kind")
    )


def _one_per_day(ratings: DataFrame) -> DataFrame:
    """One snapshot per (team, day): the last by the tie-break carried first in the struct."""
    return ratings.groupBy("team", "_day").agg(F.max("_snap").alias("_snap"))


def _looked_up(events: DataFrame, snaps: DataFrame, limit: int, tasks: int) -> DataFrame:
    """The as-of join of hot teams: answered once per distinct day, then looked up.

    A day with more events than the limit is dealt into pieces.
    """
    per_day = events.groupBy("team", "_day").agg(F.count(F.lit(1)).alias("_n"))
    pieces = pieces_needed(per_day, "_n", limit)
    answers = _carried_forward(per_day.select("team", "_day"), snaps, tasks)
    copies = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("_salt")
    piece = F.pmod(F.xxhash64(*events.columns), F.lit(pieces)).cast("int")
    found = answers.select(F.col("team").alias("_t"), F.col("_day").alias("_d"), "_snap", copies)
    same = (
        F.col("team").eqNullSafe(F.col("_t"))
        & F.col("_day").eqNullSafe(F.col("_d"))
        & (F.col("_piece") == F.col("_salt"))
    )
    return events.withColumn("_piece", piece).join(found, same, "left").select(*events.columns, "_snap")


def asof_latest(
    events: DataFrame,
    ratings: DataFrame,
    values: Sequence[str],
    *,
    date: str = "date",
    rating_date: str = "date",
    tie: Sequence[Column] = (),
    snapshot_date: str = "snapshot_date",
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add to each event its team's latest rating values and their date, null if none.

    Two ratings of a team on one day resolve to the largest by ``tie``, then by values.
    One shuffle by team serves both tables. For a team too big for one task the time line is
    built over its distinct days only, which the calendar bounds, and every event of a day
    then looks its day up.
    An undated event has no latest rating.
    """
    return _counted_latest(events, ratings, values, date, rating_date, tie, snapshot_date, limit)[0]


def _counted_latest(
    events: DataFrame, ratings: DataFrame, values: Sequence[str], date: str, rating_date: str,
    tie: Sequence[Column], snapshot_date: str, limit: int,
) -> tuple[DataFrame, int]:
    """The as-of join, and the number of tasks that suits its rows."""
    days = events.withColumn("_day", F.unix_date(date))
    snaps = ratings.filter(F.col(rating_date).isNotNull()).select(
        "team",
        F.unix_date(rating_date).alias("_day"),
        F.struct(
            *[t.alias(f"_tie{i}") for i, t in enumerate(tie)],
            *[F.col(v).alias(v) for v in values],
            F.col(rating_date).alias("_rated"),
        ).alias("_snap"),
    )
    both = events.select("team").unionByName(snaps.select("team"))
    hot, total = counted_groups(both, ["team"], limit)
    tasks = tasks_for(events, total)
    if hot is None:
        found = _carried_forward(days, snaps, tasks)
    else:
        cold_events, hot_events = split_hot(days, hot, ["team"])
        cold_snaps, hot_snaps = split_hot(snaps, hot, ["team"])
        found = _carried_forward(cold_events, cold_snaps, tasks).unionByName(
            _looked_up(hot_events, _one_per_day(hot_snaps), limit, tasks)
        )
    found = found.select(
        *events.columns,
        *[F.col(f"_snap.{v}").alias(v) for v in values],
        F.col("_snap._rated").alias(snapshot_date),
    )
    return found, tasks


def _both_sides(dataset: DataFrame) -> DataFrame:
    """One (match, side, team) row per side: all the as-of join has to carry."""
    sides = F.array(
        *[F.struct(F.lit(s).alias("side"), F.col(f"team_{s}").alias("team")) for s in "ab"]
    )
    return dataset.select("match_id", "date", F.inline(sides))


def prepare_ratings(ratings: DataFrame, required: Sequence[str], aliases=None) -> DataFrame:
    """Project a ratings table and bring its team names to canonical form.

    ``aliases`` means what it means everywhere: None is the built-in map, an empty map only
    tidies. Numeric team keys have no spelling and stay.
    """
    slim = require_columns(ratings, required, "ratings").select(*required)
    return canonicalize(slim, ["team"], aliases) if is_text(slim, "team") else slim


def _join_snapshots(
    dataset: DataFrame, ratings: DataFrame, values: dict[str, str], rating_date: str,
    tag: str, validate: bool, tie: Sequence[Column], limit: int, contests: DataFrame | None,
) -> DataFrame:
    sides = _both_sides(dataset if contests is None else contests)
    found, tasks = _counted_latest(
        sides, ratings, list(values), "date", rating_date, tie, "_rated_on", limit
    )
    names = {v: (f"team_a_{out}", f"team_b_{out}") for v, out in values.items()}
    names["_rated_on"] = (f"team_a_{tag}_date", f"team_b_{tag}_date")
    out = dataset.join(sides_to_columns(found, names, tasks), "match_id", "left")
    if validate:
        enforce_no_future_ratings(out, list(names["_rated_on"]))
    return out.drop(*names["_rated_on"])


def add_elo_snapshots(
    dataset: DataFrame, elo: DataFrame, *, aliases=None, validate: bool = False,
    tie: Sequence[Column] = (), limit: int = MAX_GROUP_ROWS, contests: DataFrame | None = None,
) -> DataFrame:
    """Both sides' latest rating and the difference.

    ``contests`` are the dataset's rows as they were before other features were joined to them.
    The sides are read from there, so that those joins are not computed once more for them.
    """
    ratings = prepare_ratings(elo, ("team", "date", "elo"), aliases)
    out = _join_snapshots(dataset, ratings, {"elo": "elo"}, "date", "elo", validate, tie, limit, contests)
    return out.withColumn("elo_diff", F.col("team_a_elo") - F.col("team_b_elo"))


def add_ranking_snapshots(
    dataset: DataFrame, rankings: DataFrame, *, aliases=None, validate: bool = False,
    tie: Sequence[Column] = (), limit: int = MAX_GROUP_ROWS, contests: DataFrame | None = None,
) -> DataFrame:
    """Both sides' latest rank and points from one snapshot, and the differences."""
    ratings = prepare_ratings(rankings, ("team", "rank_date", "rank", "points"), aliases)
    out = _join_snapshots(
        dataset, ratings, {"rank": "fifa_rank", "points": "fifa_points"},
        "rank_date", "fifa", validate, tie, limit, contests,
    )
    return out.withColumns(
        {
            "fifa_rank_diff": F.col("team_a_fifa_rank") - F.col("team_b_fifa_rank"),
            "fifa_points_diff": F.col("team_a_fifa_points") - F.col("team_b_fifa_points"),
        }
    )


def add_rating_features(
    dataset: DataFrame, elo: DataFrame | None = None, rankings: DataFrame | None = None,
    contests: DataFrame | None = None, **options,
) -> DataFrame:
    """Attach whichever rating sources are given; ``validate`` runs the leakage guard."""
    require_columns(dataset, ("match_id", "date", "team_a", "team_b"), "dataset")
    options["contests"] = dataset if contests is None else contests
    if elo is not None:
        dataset = add_elo_snapshots(dataset, elo, **options)
    if rankings is not None:
        dataset = add_ranking_snapshots(dataset, rankings, **options)
    return dataset
