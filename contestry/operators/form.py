"""Rolling form known before each contest (W1-W3), joined back to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.operators.ordering import (
    MAX_GROUP_ROWS,
    counted_groups,
    number_hot,
    pieces_needed,
    split_hot,
    tasks_for,
)
from contestry.operators.reshape import team_long
from contestry.schemas import DIFFERENCES, FORM_WIDTHS, TEAM_FEATURES
from contestry.session import compile_all

RECENT_DAYS = 365


def _prior_columns(window: Window) -> dict:
    """Averages over the previous rows and the gap to the last one, current row excluded.

    An average is the difference of two running sums: whole numbers, so nothing is lost, and a
    row is added once per sum. A frame that slides would add all its rows again at every row.
    """

    def upto(last: int, total: Column) -> Column:
        return total.over(window.rowsBetween(Window.unboundedPreceding, last))

    out = {}
    for n in FORM_WIDTHS:
        for measure in ("points", "goals_for", "goals_against", "goal_diff"):
            whole = F.sum(F.coalesce(F.col(measure).cast("bigint"), F.lit(0)))
            # Points and difference are there where both scores are.
            seen = F.count("goal_diff" if measure == "points" else measure)
            total = upto(-1, whole) - F.coalesce(upto(-n - 1, whole), F.lit(0))
            count = upto(-1, seen) - upto(-n - 1, seen)
            name = f"last_{n}_points_per_match" if measure == "points" else f"last_{n}_{measure}_avg"
            out[name] = F.when(count > 0, total.cast("double") / count)
    out["days_since_last_match"] = F.col("_day") - F.lag("_day").over(window)
    return out


def _window_form(rows: DataFrame) -> DataFrame:
    """Form by one window pass per team. Both frames share the sort by (team, day, match_id):
    the longer order is asked for first, as the other way round each would sort.

    Undated contests come after all dated ones and have no count of recent days.
    """
    day = F.asc_nulls_last("_day")
    history = Window.partitionBy("team").orderBy(day, "match_id")
    old = (
        Window.partitionBy("team").orderBy(day).rangeBetween(Window.unboundedPreceding, -RECENT_DAYS)
    )
    before = F.row_number().over(history) - 1
    recent = F.col("_before") - F.count(F.lit(1)).over(old)
    recent = F.when(F.col("_day").isNotNull(), recent.cast("bigint"))
    return (
        rows.withColumns({**_prior_columns(history), "_before": before})
        .withColumn("matches_played_last_365_days", recent)
        .drop("_before")
    )


def _chunked_form(rows: DataFrame, chunk: int, tasks: int) -> DataFrame:
    """Form of teams too big for one task: fixed-size chunks that overlap by the frame.

    A row takes part in its own chunk, and the last rows of a chunk also lead into the next,
    which is all the history the row frames reach back to. The day count needs only how many
    contests the team had per day, a table as long as the calendar.
    """
    reach = max(FORM_WIDTHS)
    chunk = max(chunk, reach)
    placed = number_hot(rows, ["team"], [F.asc_nulls_last("_day"), F.col("match_id")], "_pos")
    placed = _with_older(rows, placed, chunk)  # while the rows are narrow
    own = F.floor((F.col("_pos") - 1) / chunk)
    leads = (F.col("_pos") - 1) % chunk >= chunk - reach
    here = F.struct(own.alias("_chunk"), F.lit(True).alias("_kept"))
    there = F.struct((own + 1).alias("_chunk"), F.lit(False).alias("_kept"))
    spread = placed.select(
        "*", F.inline(F.when(leads, F.array(here, there)).otherwise(F.array(here)))
    )
    within = Window.partitionBy("team", "_chunk").orderBy("_pos")
    return (
        spread.repartition(tasks, "team", "_chunk")
        .withColumns(_prior_columns(within))
        .filter("_kept")
        .withColumn(
            "matches_played_last_365_days", (F.col("_pos") - 1 - F.col("_older")).cast("bigint")
        )
        .drop("_chunk", "_kept", "_pos", "_older")
    )


def _with_older(rows: DataFrame, placed: DataFrame, chunk: int) -> DataFrame:
    """Add to placed rows how many contests of the team were 365 days before or earlier."""
    dated = rows.filter(F.col("_day").isNotNull())
    per_day = dated.groupBy("team", "_day").agg(F.count(F.lit(1)).alias("_n"))
    old = (
        Window.partitionBy("team")
        .orderBy("_day")
        .rangeBetween(Window.unboundedPreceding, -RECENT_DAYS)
    )
    older = per_day.select(
        F.col("team").alias("_t"),
        F.col("_day").alias("_d"),
        F.coalesce(F.sum("_n").over(old), F.lit(0)).alias("_older"),
    )
    # A day above the limit is dealt into pieces. The copies are a step of their own: in one
    # projection they would be made before the running sum.
    pieces = pieces_needed(per_day, "_n", chunk)
    older = older.select("*", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("_salt"))
    salted = placed.withColumn("_piece", F.pmod(F.col("_pos"), F.lit(pieces)).cast("int"))
    same = (
        F.col("team").eqNullSafe(F.col("_t"))
        & (F.col("_day") == F.col("_d"))
        & (F.col("_piece") == F.col("_salt"))
    )
    # An undated contest finds no day, keeps its row, and has no count.
    return salted.join(older, same, "left").drop("_piece", "_salt", "_t", "_d")


def team_form(long: DataFrame, limit: int = MAX_GROUP_ROWS) -> DataFrame:
    """Add the ten per-team features to a :func:`team_long` table."""
    return _counted_form(long, limit)[0]


def _counted_form(long: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The form, and the number of tasks that suits the rows."""
    rows = long.withColumn("_day", F.unix_date("date"))
    hot, total = counted_groups(long, ["team"], limit)
    tasks = tasks_for(long, total)
    if hot is None:
        return _window_form(rows.repartition(tasks, "team")).drop("_day"), tasks
    cold_rows, hot_rows = split_hot(rows, hot, ["team"])
    formed = _window_form(cold_rows.repartition(tasks, "team")).unionByName(
        _chunked_form(hot_rows, min(limit, MAX_GROUP_ROWS), tasks)
    )
    return formed.drop("_day"), tasks


def sides_to_columns(long: DataFrame, names: dict[str, tuple[str, str]], tasks: int) -> DataFrame:
    """Fold the two side rows of a contest into one row keyed by match_id.

    ``names`` maps a per-team column to its (side a, side b) output names. Each contest has
    two rows, so the grouping cannot be skewed. Both lie in different tasks, so rows are dealt
    out before the grouping: grouping them earlier would only hold every row in memory.
    """
    picks = [
        F.max(F.when(F.col("side") == side, F.col(column))).alias(out)
        for i, side in enumerate("ab")
        for column, outs in names.items()
        for out in (outs[i],)
    ]
    return long.repartition(tasks, "match_id").groupBy("match_id").agg(*picks)


def add_differences(df: DataFrame) -> DataFrame:
    """Side a minus side b, null if either is null."""
    return df.withColumns(
        {out: F.col(f"{feature}_a") - F.col(f"{feature}_b") for out, feature in DIFFERENCES.items()}
    )


def add_form(dataset: DataFrame, limit: int = MAX_GROUP_ROWS) -> DataFrame:
    """The dataset with both sides' form and the differences."""
    compile_all(dataset.sparkSession)  # the two sides and their differences are wide rows
    formed, tasks = _counted_form(team_long(dataset), limit)
    sides = sides_to_columns(formed, {f: (f"{f}_a", f"{f}_b") for f in TEAM_FEATURES}, tasks)
    return add_differences(dataset.join(sides, "match_id", "left"))
