import random

import pytest
from pyspark.sql import functions as F

from contestry.operators.ordering import (
    earliest,
    hot_groups,
    kth_values,
    number_all,
    number_rows,
    order_cuts,
    temporal_split,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, a null group among the rest."""
    draw = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else draw.choice(["x", "y", None]), draw.randrange(40))
            for i in range(900)]
    return spark.createDataFrame(rows, "id int, g string, v int").repartition(5).cache()


def numbers(df, name):
    return {r.id: r[name] for r in df.collect()}


def test_number_all_is_the_global_order(skewed):
    got = numbers(number_all(skewed, [F.desc("v"), F.asc("id")], "n"), "n")
    rows = sorted(skewed.collect(), key=lambda r: (-r.v, r.id))
    assert got == {r.id: i + 1 for i, r in enumerate(rows)}


def test_number_all_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id int, v int")
    assert number_all(empty, [F.col("v")], "n").count() == 0


@pytest.mark.parametrize("limit", [10_000, 250, 20])
def test_number_rows_is_the_same_by_window_and_by_range(skewed, limit):
    got = numbers(number_rows(skewed, ["g"], [F.asc("v"), F.asc("id")], "n", limit), "n")
    expected = {}
    for g in {r.g for r in skewed.collect()}:
        rows = sorted((r for r in skewed.collect() if r.g == g), key=lambda r: (r.v, r.id))
        expected.update({r.id: i + 1 for i, r in enumerate(rows)})
    assert got == expected


def test_hot_groups_names_only_the_big_ones(skewed):
    assert hot_groups(skewed, ["g"], 10_000) is None
    assert [r.g for r in hot_groups(skewed, ["g"], 250).collect()] == ["hot"]


def test_kth_values_narrow_down_by_histogram(spark, monkeypatch):
    monkeypatch.setattr("contestry.operators.ordering.MAX_BUCKETS", 7)
    draw = random.Random(5)
    values = [draw.randrange(-10_000, 10_000) for _ in range(500)] + [77] * 100
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    ordered = sorted(values)
    for k, (value, below, equal) in zip((1, 300, 600), kth_values(df, F.col("v"), [1, 300, 600])):
        assert value == ordered[k - 1]
        assert below == sum(v < value for v in values)
        assert equal == values.count(value)
    with pytest.raises(ValueError):
        kth_values(df, F.col("v"), [601])


def test_a_hot_day_is_cut_inside(spark, monkeypatch):
    rows = [(i, "2001-01-01") for i in range(50)] + [(i, "2001-01-02") for i in range(50, 250)]
    df = spark.createDataFrame(rows, "match_id int, date string").withColumn(
        "date", F.to_date("date")
    )
    direct = order_cuts(df, "date", "match_id", [60, 200])
    monkeypatch.setattr("contestry.operators.ordering.MAX_BUCKETS", 5)
    assert order_cuts(df, "date", "match_id", [60, 200]) == direct
    assert [key for _, key in direct] == [59, 199]


def test_temporal_split_by_row_count(contests):
    split = temporal_split(contests)
    rows = sorted(split.collect(), key=lambda r: (r.date, r.match_id))
    assert [r.split for r in rows] == ["train"] * 280 + ["val"] * 60 + ["test"] * 60


def test_split_sizes_round_half_to_even(spark):
    df = spark.range(10).select(
        F.col("id").alias("match_id"), F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int"))
        .alias("date")
    )
    got = temporal_split(df, val_fraction=0.25, test_fraction=0.25).groupBy("split").count()
    assert {r.split: r["count"] for r in got.collect()} == {"train": 6, "val": 2, "test": 2}


@pytest.mark.parametrize("val, test", [(0, 0.1), (0.6, 0.4), (0.1, 1.0)])
def test_bad_fractions(contests, val, test):
    with pytest.raises(ValueError):
        temporal_split(contests, val_fraction=val, test_fraction=test)


def test_earliest_keeps_exactly_the_first(contests):
    rows = sorted(contests.collect(), key=lambda r: (r.date, r.match_id))[:37]
    assert {r.match_id for r in earliest(contests, 37).collect()} == {r.match_id for r in rows}
    assert earliest(contests, 10_000).count() == 400
    assert earliest(contests, 0).count() == 0
