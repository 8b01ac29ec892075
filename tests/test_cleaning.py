import pytest

from contestry.operators.cleaning import clean_matches, number_matches
from contestry.operators.names import ALIASES
from contestry.schemas import MATCHES_COLUMNS, RAW_RESULTS, DataQualityError
from contestry.sources.results import (
    labelled,
    read_elo,
    read_rankings,
    read_matches,
    read_optional,
    read_results,
    read_strengths,
)
from contestry.sources.sinks import write_features, write_matches, write_metrics

HEADER = "date,home_team,away_team,home_score,away_score,tournament,city,country,neutral"
LINES = [
    HEADER,
    "2019-06-14,Norway,Saudi,5,0,Open Cup,Oslo,Norway,False",
    "2019-06-15,IR Iran,Peru,1,0,Open Cup,Bergen,Norway,TRUE",
    "2011-8-1,Holland,Türkiye,1,1,Friendly ,Utrecht,Netherlands,0",
    "2015-07-13,Germany,Argentina,1,0,Open Cup,Lima,Peru,1",
    "2027-06-13,Brazil,Peru,NA,,Open Cup,Quito,Ecuador,true",
    "2019-06-14,Norway,Saudi,5.0,0,Open Cup,Oslo,Norway,false",
]


@pytest.fixture
def results_csv(tmp_path):
    path = tmp_path / "results.csv"
    path.write_text("\n".join(LINES), encoding="utf-8")
    return str(path)


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW_RESULTS)


def row(date="2020-01-01", home="A", away="B", hs="1", as_="0", cup="Cup", neutral="false"):
    return (date, home, away, hs, as_, cup, "X", "Y", neutral)


def test_cleaning_the_sample(spark, results_csv):
    m = clean_matches(read_results(spark, results_csv), aliases=ALIASES, max_date="2026-01-01")
    assert m.columns == list(MATCHES_COLUMNS)
    rows = sorted(m.collect(), key=lambda r: r.match_id)
    assert [r.match_id for r in rows] == [0, 1, 2, 3]
    assert [(r.home_team, r.away_team) for r in rows] == [
        ("Netherlands", "Turkey"), ("Germany", "Argentina"), ("Norway", "Saudi Arabia"), ("Iran", "Peru"),
    ]
    friendly, final = rows[0], rows[1]
    assert friendly.tournament == "Friendly" and not friendly.is_competitive and friendly.result == "D"
    assert final.neutral is True and final.home_win and final.goal_diff == 1 and final.total_goals == 1
    assert dict(m.dtypes)["home_score"] == "smallint" and dict(m.dtypes)["neutral"] == "boolean"


def test_ids_count_unplayed_rows_too(spark):
    rows = [row(home="A", hs=None, as_=None), row(home="B", away="C")]
    assert clean_matches(raw(spark, *rows)).first().match_id == 1


def test_same_day_rematch_is_kept(spark):
    numbered = number_matches(raw(spark, row(hs="1"), row(hs="2"), row(hs="2")))
    assert sorted((r.home_score, r.match_id) for r in numbered.collect()) == [(1.0, 0), (2.0, 1)]


@pytest.mark.parametrize(
    "bad, word",
    [
        (row(date="14/06/2018"), "unparseable_date"),
        (row(date="2018-06-14 extra"), "unparseable_date"),
        (row(hs="1.5"), "home_score_not_integral"),
        (row(as_="-1"), "away_score_negative"),
        (row(hs="two"), "home_score_not_a_number"),
        (row(neutral="perhaps"), "unparseable_neutral"),
    ],
)
def test_bad_raw_values_are_named(spark, bad, word):
    with pytest.raises(DataQualityError, match=word):
        clean_matches(raw(spark, bad, row()))


def test_the_final_check_sees_a_null_tournament(spark):
    with pytest.raises(DataQualityError, match="null_is_competitive"):
        clean_matches(raw(spark, row(cup=None)), max_date="2026-01-01", aliases={})


def test_missing_column_and_missing_file(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("date,home_team\n2020-01-01,A\n")
    with pytest.raises(DataQualityError, match="away_team"):
        read_results(spark, str(path))
    with pytest.raises(FileNotFoundError):
        read_results(spark, str(tmp_path / "none.csv"))


def test_optional_source(spark, tmp_path):
    assert read_optional(spark, None, read_elo, "ratings") is None
    assert read_optional(spark, str(tmp_path / "none.csv"), read_elo, "ratings") is None
    bad = tmp_path / "bad.csv"
    bad.write_text("team,elo\nA,1\n")
    with pytest.raises(DataQualityError):
        read_optional(spark, str(bad), read_elo, "ratings")


def test_numbers_are_read_or_refused(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("team,rank_date,rank,points\nA,2020-01-01,2.0,NA\nB,2020-01-01,,7.5\n")
    rows = {r.team: (r["rank"], r.points) for r in read_rankings(spark, str(path)).collect()}
    assert rows == {"A": (2, None), "B": (None, 7.5)}
    for bad in ("abc,1", "1.5,1", "1,oops"):
        path.write_text(f"team,rank_date,rank,points\nA,2020-01-01,{bad}\n")
        with pytest.raises(Exception, match="not a number"):
            read_rankings(spark, str(path)).collect()


def test_files_with_another_column_order_are_refused(spark, tmp_path):
    folder = tmp_path / "elo"
    folder.mkdir()
    (folder / "a.csv").write_text("team,date,elo\nA,2020-01-01,1500\n")
    (folder / "b.csv").write_text("elo,team,date\n1600,B,2020-01-01\n")
    with pytest.raises(Exception):
        read_elo(spark, str(folder)).collect()


def test_strengths_header_in_any_case(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("Team,STRENGTH\nA,12.5\n")
    assert tuple(read_strengths(spark, str(path)).first()) == ("A", 12.5)


def test_matches_round_trip(spark, results_csv, tmp_path):
    m = clean_matches(read_results(spark, results_csv), aliases=ALIASES)
    path = write_matches(m, str(tmp_path / "matches"))
    again = read_matches(spark, path)
    assert again.count() == 4 and dict(again.dtypes)["home_score"] == "bigint"
    csv = str(tmp_path / "matches.csv")
    m.write.option("header", True).csv(csv)
    assert {r.neutral for r in read_matches(spark, csv).collect()} == {True, False}


def test_features_are_written_in_id_order(spark, tmp_path):
    df = spark.range(500).selectExpr("pmod(id * 7919, 500) AS match_id", "'draw' AS target_class")
    path = write_features(df, str(tmp_path / "f"))
    files = sorted((tmp_path / "f").glob("*.parquet"))
    ids = [r.match_id for f in files for r in spark.read.parquet(str(f)).collect()]
    assert path and ids == sorted(ids) and len(ids) == 500
    write_metrics(df.limit(1), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1


def test_labelled_drops_other_labels(spark):
    df = spark.createDataFrame([("draw",), ("?",), (None,)], "target_class string")
    assert labelled(df).count() == 1
