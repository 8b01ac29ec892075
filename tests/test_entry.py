"""The registered queries: one contract, and the same answers as their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracles

SF = "/root/testdata/sf0.001"
QUICK = [
    "clean_contests", "form_features", "asof_rating", "canonical_names", "quality_contests",
    "temporal_split_rows", "elo_pre", "score_forecast", "bracket_seeding", "advancement",
]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in check_oracles.TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_every_query_but_fitted_models_has_sql():
    without = set(entry.queries()) - set(entry.oracle_sql()) - set(entry.TEXT_QUERIES)
    assert without == {
        "logistic_scores", "ensemble_scores", "calibrated_scores", "boosted_scores",
        "training_leaderboard", "backtest_rows",
    }
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_same_answer_as_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    mine, columns = check_oracles.rows_of(df.columns, df.collect())
    rel = con.execute(entry.oracle_sql()[name])
    theirs, other = check_oracles.rows_of([d[0] for d in rel.description], rel.fetchall())
    assert columns == other and mine == theirs
