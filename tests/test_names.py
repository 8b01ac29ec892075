import random

import pytest
from pyspark.sql import functions as F

from contestry.operators.names import (
    UnknownNameError,
    canonicalize,
    clean_name,
    nearest_names,
    unknown_names,
)


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


@pytest.mark.parametrize(
    "given, expected",
    [
        ("USA", "United States"),
        ("usa", "United States"),
        ("  Korea   Republic ", "South Korea"),
        ("Côte d’Ivoire", "Ivory Coast"),
        ("COTE D`IVOIRE", "Ivory Coast"),
        ("united states", "United States"),
        ("Türkiye", "Turkey"),
        ("Scotland", "Scotland"),
        ("Wales", "Wales"),
        ("Some  Club", "Some Club"),
        ("São Paulo", "São Paulo"),
        ("a \tb", "a b"),
    ],
)
def test_canonical_form(spark, given, expected):
    assert canonicalize(names(spark, given), ["name"]).first().name == expected


def test_cleaning_keeps_case_and_accents(spark):
    got = names(spark, " Ça  va ", "ʼx‘", "").select(clean_name(F.col("name")).alias("n"))
    assert [r.n for r in got.collect()] == ["Ça va", "'x'", ""]


def test_several_columns_and_nulls(spark):
    df = spark.createDataFrame([("USA", None), ("x", "Eire")], "a string, b string")
    got = canonicalize(df, ["a", "b"])
    assert sorted((r.a, r.b) for r in got.collect() if r.b) == [("x", "Republic of Ireland")]
    assert got.columns == ["a", "b"] and got.count() == 2


def test_strict_and_known(spark):
    with pytest.raises(UnknownNameError):
        canonicalize(names(spark, "A", "  "), ["name"], strict=True)
    with pytest.raises(UnknownNameError, match="Bolivai"):
        canonicalize(names(spark, "Bolivai"), ["name"], known=names(spark, "Bolivia"))
    canonicalize(names(spark, "USA"), ["name"], known=names(spark, "United States"))
    with pytest.raises(KeyError):
        canonicalize(names(spark, "A"), ["other"])


def test_unknown_names_are_distinct_and_canonical(spark):
    got = unknown_names(names(spark, "USA", "usa", "Peru", " Peru", "X"), ["name"],
                        names(spark, "United States"))
    assert sorted(r.name for r in got.collect()) == ["Peru", "X"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("cutoff", [0.6, 0.75])
def test_nearest_names_against_every_pair(spark, cutoff):
    draw = random.Random(11)
    words = {"".join(draw.choice("abé") for _ in range(draw.randrange(1, 12))) for _ in range(160)}
    words |= {"aaaaaaaa", "abababab", "aaaaaaa"}
    words = sorted(words)
    unknown, known = words[::2], words[1::2]
    expected = {}
    for u in unknown:
        best = min((-(1 - edits(u, k) / max(len(u), len(k))), k) for k in known)
        if -best[0] >= cutoff - 1e-12:
            expected[u] = (best[1], -best[0])
    got = nearest_names(names(spark, *unknown), names(spark, *known), cutoff).collect()
    assert {r.name: r.nearest for r in got} == {u: k for u, (k, _) in expected.items()}
    for r in got:
        assert r.similarity == pytest.approx(expected[r.name][1])


def test_typo_finds_its_name(spark):
    got = nearest_names(names(spark, "Brasil", "Qqqq"), names(spark, "Brazil", "Basel", "Britain"))
    assert [(r.name, r.nearest) for r in got.collect()] == [("Brasil", "Brazil")]
