"""Exact row numbers, ranks and order cuts that hold up when one group is huge.

A window over a group sorts that group inside one task. That is the right plan while every
group is small, which one cheap count per key proves. Groups above the limit are numbered by
a range shuffle instead: the range boundaries fall inside the group, so its rows spread over
many tasks, and each row number is the row's place in its slice plus the size of the slices
before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.session import cut_lineage

# A group above this many rows is not sorted in one task.
MAX_GROUP_ROWS = 2_000_000
# Bound on the table of hot keys, which is broadcast.
MAX_HOT_GROUPS = 100_000
# Rows meant for one task of a shuffle whose rows are counted.
TASK_ROWS = 1_000_000
# Bound on one histogram read by the driver.
MAX_BUCKETS = 65_536


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int = MAX_GROUP_ROWS) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None when there are none.

    At most ``MAX_HOT_GROUPS`` keys come back: the limit rises to ``rows / MAX_HOT_GROUPS``
    where needed, so the result may be broadcast whatever the input holds.
    """
    return counted_groups(df, keys, limit)[0]


def counted_groups(
    df: DataFrame, keys: Sequence[str], limit: int = MAX_GROUP_ROWS
) -> tuple[DataFrame | None, int]:
    """The keys of :func:`hot_groups`, and the number of rows of the whole table."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    seen = counts.agg(F.max("_rows").alias("top"), F.sum("_rows").alias("total")).first()
    if seen.top is None:
        return None, 0
    least = max(limit, seen.total // MAX_HOT_GROUPS)
    if seen.top <= least:
        return None, seen.total
    return cut_lineage(counts.filter(F.col("_rows") > least).select(*keys)), seen.total


def tasks_for(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> int:
    """Into how many tasks to deal counted rows, so that a task's memory does not grow with them.

    Bytes of a shuffle do not tell: narrow rows are packed tightly there and unpacked in the task.
    One per core at least; a power of two above that, so that tables of like size meet in a join
    without another shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores, 1 << max(0, -(-rows // task_rows) - 1).bit_length())


def split_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows outside and inside the hot groups; a null key is a key like any other."""
    marked = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    match = reduce(
        lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    )
    marked = F.broadcast(marked)
    return df.join(marked, match, "left_anti"), df.join(marked, match, "left_semi")


def number_all(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1-based row number over the whole table, without a single-task sort.

    ``order`` must be total: rows equal on it may come in any order. The numbered rows are
    checkpointed, because the slice a row falls in is fixed by one run only.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    fixed = cut_lineage(placed)
    # The upper bits hold the slice, the lower 33 the place in it.
    slice_of = F.shiftright("_at", 33)
    sizes = fixed.groupBy(slice_of.alias("_slice")).agg(F.count(F.lit(1)).alias("_rows"))
    before, offsets = 0, []
    for row in sizes.orderBy("_slice").collect():  # one row per shuffle partition
        offsets.append((row["_slice"], before))
        before += row["_rows"]
    if not offsets:
        return fixed.withColumn(name, F.lit(0).cast("bigint")).drop("_at")
    table = df.sparkSession.createDataFrame(offsets, "_slice bigint, _before bigint")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        fixed.withColumn("_slice", slice_of)
        .join(F.broadcast(table), "_slice")
        .withColumn(name, F.col("_before") + place + 1)
        .drop("_at", "_slice", "_before")
    )


def number_hot(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Row number within each of a bounded number of groups, by one range shuffle."""
    everywhere = number_all(df, [*[F.col(k) for k in keys], *order], "_everywhere")
    starts = everywhere.groupBy(*[F.col(k).alias(f"_start_{k}") for k in keys]).agg(
        F.min("_everywhere").alias("_first")
    )
    match = reduce(
        lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_start_{k}")) for k in keys]
    )
    return (
        everywhere.join(F.broadcast(starts), match)
        .withColumn(name, F.col("_everywhere") - F.col("_first") + 1)
        .drop("_everywhere", "_first", *[f"_start_{k}" for k in keys])
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """1-based row number within each group; small groups by window, hot ones by range."""
    if not keys:
        return number_all(df, order, name)
    window = Window.partitionBy(*keys).orderBy(*order)
    hot = hot_groups(df, keys, limit)
    if hot is None:
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))
    cold_rows, hot_rows = split_hot(df, hot, keys)
    cold = cold_rows.withColumn(name, F.row_number().over(window).cast("bigint"))
    return cold.unionByName(number_hot(hot_rows, keys, order, name))


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, k: int
) -> DataFrame:
    """The first ``k`` rows of each group with their number.

    Each task keeps its own first ``k`` per group before the shuffle, so for a small ``k``
    no group needs splitting, whatever its size.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn(name, F.row_number().over(window))
    return numbered.filter(F.col(name) <= k).withColumn(name, F.col(name).cast("bigint"))


def pieces_needed(per_key: DataFrame, count: str, limit: int) -> int:
    """Into how many pieces the largest key must be dealt to stay within the limit."""
    largest = per_key.agg(F.max(count)).first()[0] or 0
    return max(1, -(-largest // limit))


def kth_values(df: DataFrame, value: Column, ks: Sequence[int]) -> list[tuple[int, int, int]]:
    """For each ``k`` the k-th smallest (1-based) of an integer column, the number of rows
    below it and the number equal to it.

    Histograms narrow the range step by step, so no rows are sorted and the driver reads at
    most ``MAX_BUCKETS`` counts per step. Nulls are not counted.
    """
    numbers = df.select(value.cast("bigint").alias("_v")).filter(F.col("_v").isNotNull())
    least, most, total = numbers.agg(F.min("_v"), F.max("_v"), F.count("_v")).first()

    def histogram(low: int, high: int) -> tuple[int, list[tuple[int, int]]]:
        width = (high - low) // MAX_BUCKETS + 1
        counted = (
            numbers.filter(F.col("_v").between(low, high))
            .groupBy(F.expr(f"(_v - ({low}L)) div {width}L").alias("_bucket"))
            .count()
        )
        return width, sorted((r["_bucket"], r["count"]) for r in counted.collect())

    found, whole = [], None
    for k in ks:
        if not 1 <= k <= total:
            raise ValueError(f"asked for value {k} of {total}")
        low, high, below, equal = least, most, 0, total
        while low < high:
            if (low, high) == (least, most):
                whole = whole or histogram(low, high)
                width, counts = whole
            else:
                width, counts = histogram(low, high)
            for bucket, equal in counts:
                if below + equal >= k:
                    break
                below += equal
            low, high = low + bucket * width, min(high, low + (bucket + 1) * width - 1)
        found.append((low, below, equal))
    return found


def order_cuts(df: DataFrame, date: str, key: str, rows: Sequence[int]) -> list[tuple[int, int]]:
    """Day number and key of the given rows in (date, key) order; null dates come last."""
    day = day_number(date)
    cuts = []
    for row, (cut_day, before, equal) in zip(rows, kth_values(df, day, rows)):
        of_day = df.filter(day == cut_day)
        if equal <= MAX_BUCKETS:
            keys = sorted(r[0] for r in of_day.select(key).collect())
            cuts.append((cut_day, keys[row - before - 1]))
        else:
            ((cut_key, _, _),) = kth_values(of_day, F.col(key), [row - before])
            cuts.append((cut_day, cut_key))
    return cuts


def day_number(date: str) -> Column:
    """Days since 1970-01-01, with null dates after every real one."""
    return F.coalesce(F.unix_date(F.col(date)), F.lit(2**31 - 1))


def at_or_before(date: str, key: str, cut: tuple[int, int]) -> Column:
    """Whether a row is at or before a cut in (date, key) order."""
    day = day_number(date)
    return (day < cut[0]) | ((day == cut[0]) & (F.col(key) <= cut[1]))


def part_sizes(rows: int, later: Sequence[float]) -> list[int]:
    """Row counts of consecutive parts: each later one has its share of all rows, rounded half
    to even, and the first has what they leave, at least one row."""
    counts = [round(rows * share) for share in later]
    first = rows - sum(counts)
    if first < 1 or any(share <= 0 for share in later) or sum(later) >= 1:
        raise ValueError(f"shares {list(later)} of {rows} rows make parts of {[first, *counts]}")
    return [first, *counts]


def temporal_split(
    df: DataFrame,
    date: str = "date",
    key: str = "match_id",
    val_fraction: float = 0.15,
    test_fraction: float = 0.15,
    name: str = "split",
) -> DataFrame:
    """Mark each row train, val or test by its place in (date, key) order.

    Sizes go by row count with half-to-even rounding; ``key`` must be unique. The two cut
    points come from histograms, after which the split is a plain row filter.
    """
    train, val, _ = part_sizes(df.count(), [val_fraction, test_fraction])
    ends = order_cuts(df.select(date, key), date, key, [train, train + val])
    in_train, in_val = (at_or_before(date, key, end) for end in ends)
    return df.withColumn(
        name, F.when(in_train, "train").when(in_val, "val").otherwise("test")
    )


def earliest(df: DataFrame, n: int, date: str = "date", key: str = "match_id") -> DataFrame:
    """The ``n`` earliest rows in (date, key) order (K5), kept by a filter, not a sort."""
    if n <= 0:
        return df.limit(0)
    slim = df.select(date, key)
    if slim.count() <= n:
        return df
    (cut,) = order_cuts(slim, date, key, [n])
    return df.filter(at_or_before(date, key, cut))
