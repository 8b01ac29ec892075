"""Shared session and small contest tables."""

from __future__ import annotations

import datetime as dt
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from contestry.session import local_session  # noqa: E402

CONTEST = (
    "match_id bigint, date date, team_a string, team_b string, team_a_score int, "
    "team_b_score int, is_neutral boolean, tournament string"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def random_contests(n: int, hot: str | None = None, seed: int = 1, days: int = 900):
    """Rows of random contests; a hot team plays in about half of them."""
    draw = random.Random(seed)
    teams = [f"t{i:02d}" for i in range(12)]
    rows = []
    for i in range(n):
        a, b = draw.sample(teams, 2)
        if hot and i % 2 == 0:
            a = hot
        rows.append(
            (
                i, day("2000-01-01") + dt.timedelta(draw.randrange(days)), a, b,
                draw.randrange(5), draw.randrange(5), draw.random() < 0.3,
                draw.choice(["cup", "league"]),
            )
        )
    return rows


@pytest.fixture(scope="session")
def contests(spark):
    return spark.createDataFrame(random_contests(400, hot="hot"), CONTEST).cache()
