"""Contest tables derived from the order tables the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestry.functions.elo import strength_probabilities
from contestry.functions.labels import target_class
from contestry.operators.asof import add_elo_snapshots
from contestry.operators.reshape import participants
from contestry.schemas import PROBABILITIES
from contestry.session import cut_lineage, spread

# Names for the canonicalization queries.
NAME_ALIASES = {
    "für": "Fuer",
    "étre": "Être",
    "THE": "the",
    "src0": "Source Zero",
    "SRC 1": "Source One",
    "SRC2": "Source Two",
    "de la": "Dela",
    "que": "QUÉ",
}
RAW_ALIASES = {"Side 1": "Side One", "SÏDE 2": "Side Two"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contest between each two neighbouring suppliers of an order, in order of their keys.

    Quantities combine per (order, supplier) before the second grouping, so an order with
    very many lines arrives there as a few rows. A contest's number is the order's times 64
    plus its place in the order, from 1.
    """
    per_side = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_suppkey")
        .agg(F.floor(F.sum("l_quantity") / 10).cast("int").alias("g"))
    )
    in_order = Window.partitionBy("l_orderkey").orderBy("l_suppkey")
    pairs = (
        per_side.select(
            "l_orderkey",
            F.row_number().over(in_order).alias("_no"),
            F.col("l_suppkey").alias("team_a"),
            F.col("g").alias("team_a_score"),
            F.lead(F.struct("l_suppkey", "g")).over(in_order).alias("_b"),
        )
        .filter(F.col("_b").isNotNull())
        .select(
            "l_orderkey",
            (F.col("l_orderkey") * 64 + F.col("_no")).alias("match_id"),
            "team_a",
            F.col("_b.l_suppkey").alias("team_b"),
            "team_a_score",
            F.col("_b.g").alias("team_b_score"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderpriority").alias("tournament"),
        F.col("o_orderstatus").alias("status"),
    )
    return pairs.join(orders, "l_orderkey").select(
        "match_id",
        "date",
        "team_a",
        "team_b",
        "team_a_score",
        "team_b_score",
        (F.col("l_orderkey") % 3 == 0).alias("is_neutral"),
        "tournament",
        "status",
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests with target and home flag, for queries that read them once."""
    return contests(spark, sf_dir).drop("status").withColumns(
        {
            "target_class": target_class(F.col("team_a_score"), F.col("team_b_score")),
            "is_team_a_home": ~F.col("is_neutral"),
        }
    )


def played(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results written once per query: they stand for a stored table, and most operators
    read such a table more than once, a few columns at a time."""
    return cut_lineage(results(spark, sf_dir))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests as a home/away matches table, hosted by the home side's nation."""
    home = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("home_team"), F.col("s_nationkey").alias("n_nationkey")
    )
    nation = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.col("n_name").alias("venue_country")
    )
    return (
        contests(spark, sf_dir)
        .select(
            "match_id",
            "date",
            F.col("team_a").alias("home_team"),
            F.col("team_b").alias("away_team"),
            F.col("team_a_score").alias("home_score"),
            F.col("team_b_score").alias("away_score"),
            F.col("is_neutral").alias("neutral"),
            "tournament",
        )
        .join(home, "home_team", "left")
        .join(nation, "n_nationkey", "left")
        .drop("n_nationkey")
    )


def stored_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches table written once, for queries that read it more than once."""
    return cut_lineage(matches(spark, sf_dir))


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests as an untidy text table: aliases, padding, duplicates, unplayed rows."""
    c = contests(spark, sf_dir)

    def name(side: str):
        plain = F.concat(F.lit("Side "), F.col(side).cast("string"))
        untidy = F.concat(F.lit("  Side  "), F.col(side).cast("string"), F.lit(" "))
        return F.when(F.col("match_id") % 7 == 0, untidy).otherwise(plain)

    def goals(side: str):
        text = F.col(f"{side}_score").cast("string")
        return F.when(F.col("status") == "P", "NA").otherwise(text)

    flag = F.when(F.col("match_id") % 2 == 0, F.upper(F.col("is_neutral").cast("string"))).otherwise(
        F.col("is_neutral").cast("int").cast("string")
    )
    rows = c.select(
        F.col("date").cast("string").alias("date"),
        name("team_a").alias("home_team"),
        name("team_b").alias("away_team"),
        goals("team_a").alias("home_score"),
        goals("team_b").alias("away_score"),
        F.when(F.col("tournament") == "5-LOW", "Friendly ").otherwise(F.col("tournament"))
        .alias("tournament"),
        F.concat(F.lit("City "), (F.col("match_id") % 100).cast("string")).alias("city"),
        F.lit(None).cast("string").alias("country"),
        flag.alias("neutral"),
        # Every fiftieth row is entered twice.
        F.explode(
            F.sequence(F.lit(0), F.when(F.col("match_id") % 50 == 0, 1).otherwise(0))
        ).alias("_copy"),
    )
    return cut_lineage(rows.drop("_copy"))  # stands for a stored file


def side_name(team):
    """The name of a team key as the alias map would have it."""
    plain = F.concat(F.lit("Side "), team.cast("string"))
    return F.when(team == 1, "Side One").when(team == 2, "Side Two").otherwise(plain)


def rating_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(team, date, elo): monthly activity of a supplier, as a stored table."""
    return cut_lineage(
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("team"),
            F.trunc("l_shipdate", "month").alias("date"),
        )
        .agg((F.lit(1000) + F.count(F.lit(1))).cast("double").alias("elo"))
    )


def ranking_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(team, rank_date, rank, points): monthly volume of a supplier, as a stored table."""
    return cut_lineage(
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("team"),
            F.trunc("l_shipdate", "month").alias("rank_date"),
        )
        .agg(
            F.count(F.lit(1)).cast("int").alias("rank"),
            F.sum("l_quantity").cast("double").alias("points"),
        )
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests with a deterministic forecast from the as-of ratings.

    One contest more a month counts twenty rating points, to spread the forecasts.
    """
    rated = add_elo_snapshots(played(spark, sf_dir), rating_snapshots(spark, sf_dir))
    parts = strength_probabilities(20 * F.col("team_a_elo"), 20 * F.col("team_b_elo"))
    return rated.withColumns(dict(zip(PROBABILITIES, parts)))


def members(spark: SparkSession, sf_dir: str, played: DataFrame | None = None) -> DataFrame:
    """(tournament, group, team): participants in twelve groups, by nation of the supplier.

    ``played`` saves deriving the contests once more.
    """
    group = F.char(F.lit(65) + F.col("s_nationkey") % 12)
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("team"), group.alias("group")
    )
    return cut_lineage(
        participants(contests(spark, sf_dir) if played is None else played, "tournament")
        .join(supplier, "team")
        .select("tournament", "group", "team")
    )


def strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(team, strength): supplier balance scaled to rating points."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("team"), (F.col("s_acctbal") / 50.0).alias("strength")
    )


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, name_a, name_b): every word of every document with its source."""
    words = F.posexplode(F.split("text", r"\s+")).alias("pos", "name_a")
    return (
        spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
        .select("doc_id", F.col("source").alias("name_b"), words)
        .filter(F.col("name_a") != "")
        .select("doc_id", "pos", "name_a", "name_b")
    )


def spoken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name): every word of every conversation turn."""
    return (
        spread(table(spark, sf_dir, "conversations").select("text"))
        .select(F.explode(F.split("text", r"\s+")).alias("name"))
        .filter(F.col("name") != "")
    )


def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name): distinct words of the benchmark texts."""
    return (
        table(spark, sf_dir, "benchmark")
        .select(F.explode(F.split("text", r"\s+")).alias("name"))
        .filter(F.col("name") != "")
        .distinct()
    )
