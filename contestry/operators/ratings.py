"""Walk-forward ratings (E1, E2) and the tables read off them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contestry.functions.elo import strength_probabilities
from contestry.operators.ordering import MAX_GROUP_ROWS, day_number, number_rows
from contestry.schemas import (
    ELO_BASE,
    ELO_HOME,
    ELO_K,
    ELO_SCALE,
    PROBABILITIES,
    require_columns,
)
from contestry.session import cut_lineage, scratch_table

# A pool is folded in segments of this many contests, so no task grows with the pool.
SEGMENT_ROWS = 5_000_000


def _fold(base: float, k: float, home: float, scale: float):
    """The rating walk over rows sorted by (day, match_id), whatever pools they are of.

    Only the ratings of the pools at hand are held. A row of kind 0 brings in a team's rating
    from an earlier segment, comes before all contests and yields nothing.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools: dict[str, dict] = {}
        for batch in batches:
            read = {c: batch.column(c).to_pandas().tolist() for c in ("team_a", "team_b", "_actual")}
            kinds = batch.column("_kind").to_numpy()
            bonus = np.where(batch.column("_bonus").to_numpy(zero_copy_only=False), home, 0.0).tolist()
            named = batch.column("_pool").dictionary_encode()
            held = [pools.setdefault(p, {}) for p in named.dictionary.to_pylist()]
            own = map(held.__getitem__, named.indices.to_numpy().tolist())
            rows = zip(own, read["team_a"], read["team_b"], read["_actual"], bonus)
            seeds = int((kinds == 0).sum())  # they are first
            for ratings, a, _, actual, _ in islice(rows, seeds):
                ratings[a] = actual
            a_pre, b_pre, a_post, b_post = told = [], [], [], []
            for ratings, a, b, actual, extra in rows:
                ra, rb = ratings.get(a, base), ratings.get(b, base)
                expected = 1.0 / (1.0 + 10.0 ** ((rb - ra - extra) / scale))
                na = ra + k * (actual - expected)
                nb = rb + k * ((1.0 - actual) - (1.0 - expected))
                ratings[a] = na
                ratings[b] = nb
                a_pre.append(ra)
                b_pre.append(rb)
                a_post.append(na)
                b_post.append(nb)
            kept = batch.slice(seeds).select(["_pool", "match_id", "_day", "team_a", "team_b"])
            names = [*kept.schema.names, "a_pre", "b_pre", "a_post", "b_post"]
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(x, pa.float64()) for x in told]], names)

    return walk


def _walked_schema(slim: DataFrame) -> T.StructType:
    kept = [slim.schema[c] for c in ("_pool", "match_id", "_day", "team_a", "team_b")]
    return T.StructType(
        kept + [T.StructField(c, T.DoubleType()) for c in ("a_pre", "b_pre", "a_post", "b_post")]
    )


def _walk(rows: DataFrame, fold) -> DataFrame:
    schema = _walked_schema(rows)
    # Sorted by numbers alone: a task that has several pools walks them side by side.
    order = F.when(F.col("_kind") == 0, F.lit(-(2**31)).cast("int")).otherwise(F.col("_day"))
    return rows.repartition("_pool").sortWithinPartitions(order, "match_id").mapInArrow(fold, schema)


def _latest(walked: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Rating of each team of a pool after its last contest."""
    sides = F.array(
        F.struct(F.col("team_a").alias("team"), F.col("a_post").alias("elo")),
        F.struct(F.col("team_b").alias("team"), F.col("b_post").alias("elo")),
    )
    seen = walked.select("_pool", "_day", "match_id", F.inline(sides))
    if carried is not None:
        first = F.lit(-(2**31)).cast("int").alias("_day")
        seen = seen.unionByName(
            carried.select("_pool", first, F.lit(0).cast("bigint").alias("match_id"), "team", "elo")
        )
    return seen.groupBy("_pool", "team").agg(
        F.max_by("elo", F.struct("_day", "match_id")).alias("elo")
    )


def walk_forward(
    contests: DataFrame,
    pool: Sequence[str],
    *,
    base: float = ELO_BASE,
    k: float = ELO_K,
    home: float = ELO_HOME,
    scale: float = ELO_SCALE,
    segment_rows: int = SEGMENT_ROWS,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Both ratings before and after every contest, in (date, match_id) order per pool.

    A pool is a set of teams that never meets another set; pools run in parallel. Within one
    pool each rating needs the one before, so its contests must be walked in order: a pool
    above ``segment_rows`` goes in segments, each a job that starts from the ratings the
    previous one wrote. A lost executor repeats one segment of one pool at most.

    Undated contests come after all dated ones. ``pool`` may be empty only on purpose.

    Returns match_id, the pool columns, teams, and ``a_pre, b_pre, a_post, b_post``.
    """
    require_columns(
        contests,
        ("date", "match_id", "team_a", "team_b", "team_a_score", "team_b_score", *pool),
        "contests",
    )
    at_home = (
        F.coalesce(F.col("is_team_a_home"), F.lit(False))
        if "is_team_a_home" in contests.columns
        else F.lit(False)
    )
    a, b = F.col("team_a_score"), F.col("team_b_score")
    # Pools are told apart by one text key; a null part of the key is a value of its own.
    key = F.to_json(F.struct(*[F.col(c) for c in pool])) if pool else F.lit("")
    slim = contests.select(
        key.alias("_pool"),
        F.lit(1).alias("_kind"),
        day_number("date").alias("_day"),
        F.col("match_id").cast("bigint").alias("match_id"),
        "team_a",
        "team_b",
        F.when(a > b, 1.0).when(a < b, 0.0).otherwise(0.5).alias("_actual"),
        at_home.alias("_bonus"),
    )
    fold = _fold(base, k, home, scale)
    per_day = slim.groupBy("_pool", "_day").agg(F.count(F.lit(1)).alias("_n"))
    per_day = cut_lineage(per_day)
    largest = per_day.groupBy("_pool").agg(F.sum("_n").alias("_n")).agg(F.max("_n")).first()[0] or 0
    if largest <= segment_rows:
        # Walked once and written: every reader of the result would walk again.
        walked = cut_lineage(_walk(slim, fold))
    else:
        placed = _in_segments(slim, per_day, segment_rows, limit)
        walked = _walk_segments(slim, placed, fold, segment_rows, largest)
    return walked.select("match_id", *_pool_columns(contests, pool), "_pool", "_day", "team_a",
                         "team_b", "a_pre", "b_pre", "a_post", "b_post")


def _pool_columns(contests: DataFrame, pool: Sequence[str]) -> list[Column]:
    """The pool columns, read back from the text key."""
    whole = F.from_json("_pool", T.StructType([contests.schema[c] for c in pool]))
    return [whole.getField(c).alias(c) for c in pool]


def _in_segments(slim: DataFrame, per_day: DataFrame, segment_rows: int, limit: int) -> DataFrame:
    """The rows with their ``_segment``: whole days, found from the counts of days alone.

    A segment has less than ``segment_rows`` contests before its last day. Only where one day of
    a pool has more than that are the contests numbered, which sorts them all.
    """
    if per_day.agg(F.max("_n")).first()[0] > segment_rows:
        placed = number_rows(slim, ["_pool"], [F.col("_day"), F.col("match_id")], "_pos", limit)
        return placed.withColumn("_segment", F.floor((F.col("_pos") - 1) / segment_rows).cast("int")).drop("_pos")
    # Pools of more than one segment are few, and their days as many as the calendar has.
    large = per_day.groupBy("_pool").agg(F.sum("_n").alias("_all")).filter(F.col("_all") > segment_rows)
    earlier = Window.partitionBy("_pool").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = per_day.join(large.select("_pool"), "_pool", "left_semi").select(
        "_pool", "_day", F.floor(F.coalesce(F.sum("_n").over(earlier), F.lit(0)) / segment_rows).cast("int").alias("_segment")
    )
    placed = slim.join(F.broadcast(days), ["_pool", "_day"], "left")
    return placed.select(*slim.columns, F.coalesce("_segment", F.lit(0)).alias("_segment"))


def _walk_segments(slim, placed, fold, segment_rows: int, largest: int) -> DataFrame:
    spark = slim.sparkSession
    staged, walked_path = scratch_table(spark, "walk-in"), scratch_table(spark, "walk-out")
    placed.write.partitionBy("_segment").parquet(staged)
    rows = spark.read.schema(
        T.StructType([*slim.schema.fields, T.StructField("_segment", T.IntegerType())])
    ).parquet(staged)
    state = None
    for segment in range(-(-largest // segment_rows)):
        part = rows.filter(F.col("_segment") == segment).drop("_segment")
        # Only pools that go on need their ratings; the rest are finished.
        if state is not None:
            going_on = part.select("_pool").distinct()
            seeds = state.join(going_on, "_pool", "left_semi").select(
                "_pool",
                F.lit(0).alias("_kind"),
                F.lit(0).alias("_day"),
                F.lit(0).cast("bigint").alias("match_id"),
                F.col("team").alias("team_a"),
                F.col("team").alias("team_b"),
                F.col("elo").alias("_actual"),
                F.lit(False).alias("_bonus"),
            )
            part = part.unionByName(seeds)
        here = f"{walked_path}/_part={segment}"
        _walk(part, fold).write.parquet(here)
        done = spark.read.schema(_walked_schema(slim)).parquet(here)
        carried = state
        state_path = scratch_table(spark, "walk-state")
        _latest(done, carried).write.parquet(state_path)
        state = spark.read.parquet(state_path)
    return spark.read.schema(_walked_schema(slim)).parquet(walked_path)


def add_elo(contests: DataFrame, pool: Sequence[str], **options) -> DataFrame:
    """The contests with ``team_a_elo``, ``team_b_elo`` and ``elo_diff`` before each."""
    walked = walk_forward(contests, pool, **options).select(
        "match_id",
        F.col("a_pre").alias("team_a_elo"),
        F.col("b_pre").alias("team_b_elo"),
        (F.col("a_pre") - F.col("b_pre")).alias("elo_diff"),
    )
    return contests.join(walked, "match_id")


def current_elo(contests: DataFrame, pool: Sequence[str], **options) -> DataFrame:
    """(pool columns, team, elo) after each team's last contest."""
    walked = walk_forward(contests, pool, **options)
    return _latest(walked).select(*_pool_columns(contests, pool), "team", "elo")


def rating_table(ratings: DataFrame, pool: Sequence[str] = (), limit: int = MAX_GROUP_ROWS):
    """Ratings with rank and percentile within the pool, best first, ties by name."""
    ranked = number_rows(ratings, list(pool), [F.desc("elo"), F.asc("team")], "rank", limit)
    if pool:
        sizes = ratings.groupBy(*pool).agg(F.count(F.lit(1)).alias("_n"))
        ranked = ranked.join(sizes, list(pool))
    else:
        ranked = ranked.withColumn("_n", F.lit(ratings.count()))
    share = 100.0 * (1.0 - (F.col("rank") - 1) / F.col("_n"))
    return ranked.withColumn("percentile", share).drop("_n")


def entering_ratings(rated: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each team's rating before its first contest of the given rows."""
    sides = F.array(
        *[
            F.struct(
                F.lit(s).alias("side"),
                F.col(f"team_{s}").alias("team"),
                F.col(f"team_{s}_elo").alias("elo"),
            )
            for s in "ab"
        ]
    )
    first = F.struct(day_number("date"), "match_id", "side")
    return (
        rated.select(*keys, "date", "match_id", F.inline(sides))
        .groupBy(*keys, "team")
        .agg(F.min_by("elo", first).alias("elo"))
    )


def favourites(
    strengths: DataFrame, keys: Sequence[str] = (), base: float = ELO_BASE,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Participants by strength, strongest first, ties by name; no rating counts as base."""
    filled = strengths.withColumn("elo", F.coalesce("elo", F.lit(base)))
    return number_rows(filled, list(keys), [F.desc("elo"), F.asc("team")], "rank", limit)


def champion_rank(ranking: DataFrame, champions: DataFrame, key: str = "tournament") -> DataFrame:
    """Where each tournament's champion stood among the favourites.

    A champion who did not take part has a null rank and false flags.
    """
    sizes = ranking.groupBy(key).agg(F.count(F.lit(1)).alias("n_participants"))
    placed = ranking.select(
        key, F.col("team").alias("champion"), F.col("rank").alias("predicted_rank")
    )
    rank = F.col("predicted_rank")
    return (
        champions.join(sizes, key, "left")
        .join(placed, [key, "champion"], "left")
        .select(
            key,
            "champion",
            "predicted_rank",
            F.coalesce("n_participants", F.lit(0)).alias("n_participants"),
            *[F.coalesce(rank <= n, F.lit(False)).alias(f"in_top_{n}") for n in (3, 5, 10)],
        )
    )


def pair_forecast(
    pairs: DataFrame, ratings: DataFrame, *, base: float = ELO_BASE, home: float = ELO_HOME,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Three probabilities for each (team_a, team_b, is_neutral) row.

    A home side that is not on neutral ground gets the home bonus; with no rating it starts
    from the base for that, while an unrated side otherwise counts as 0.
    """
    sides = [
        ratings.select(*keys, F.col("team").alias(f"team_{s}"), F.col("elo").alias(f"_{s}"))
        for s in "ab"
    ]
    joined = pairs
    for s, side in zip("ab", sides):
        joined = joined.join(side, [*keys, f"team_{s}"], "left")
    strength_a = F.when(
        ~F.col("is_neutral"), F.coalesce(F.col("_a"), F.lit(base)) + F.lit(home)
    ).otherwise(F.col("_a"))
    values = strength_probabilities(strength_a, F.col("_b"))
    return joined.withColumns(dict(zip(PROBABILITIES, values))).drop("_a", "_b")
