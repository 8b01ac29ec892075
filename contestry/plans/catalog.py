"""Every query of the engine over the given tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.functions.elo import expected_score, updated_rating
from contestry.functions.labels import parse_day, parse_flag, points
from contestry.functions.probability import (
    advance_probability,
    clip_normalize,
    drawn_class,
    drawn_winner,
    keyed_uniform,
    top_label,
)
from contestry.operators.advancement import (
    advancement_shares,
    contenders,
    play_round,
    stage_outcomes,
    summarize,
)
from contestry.operators.asof import add_elo_snapshots, add_ranking_snapshots
from contestry.operators.cleaning import clean_matches
from contestry.operators.form import add_form
from contestry.operators.grouped_logistic import fit_grouped
from contestry.operators.models import (
    EnsembleModel,
    PriorModel,
    calibrate,
    fit_boosted,
    fit_logistic,
    fit_maps,
    fit_prior,
    optimality,
    score_together,
    uniform_model,
)
from contestry.operators.names import canonicalize, nearest_names, unknown_names
from contestry.operators.ordering import earliest, temporal_split
from contestry.operators.quality import (
    check_bounds,
    check_features,
    check_matches,
    check_probabilities,
    duplicate_keys,
    future_ratings,
    null_counts,
    profile,
)
from contestry.operators.ratings import (
    add_elo,
    champion_rank,
    current_elo,
    entering_ratings,
    favourites,
    pair_forecast,
    rating_table,
)
from contestry.operators.reshape import model_dataset, participants, team_long
from contestry.operators.schedule import check_schedule
from contestry.operators.scoring import (
    backtest_summary,
    calibration_error,
    class_prior,
    class_report,
    comparison,
    confusion,
    leaderboard,
    prediction_frame,
    reliability,
    score,
    unexpected_labels,
    with_label_index,
)
from contestry.operators.standings import (
    best_thirds,
    bracket_slots,
    group_table,
    lot,
    rank_groups,
    resolve_pairings,
    seeding_problems,
    seeds,
    slot_tokens,
    standings,
    top_two,
    unknown_tokens,
)
from contestry.plans import testbed as tb
from contestry.plans.training import (
    Tournament,
    backtest,
    feature_matrix,
    tail_cut,
    train,
    window_filter,
)
from contestry.schemas import CLASSES, PROBABILITIES, TEAM_FEATURES
from contestry.session import cut_lineage, scratch_table
from contestry.sources.results import (
    read_elo,
    read_matches,
    read_rankings,
    read_results,
    read_strengths,
)
from contestry.sources.sinks import rounded, write_matches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters the queries and their SQL share.
SEED = 42
REPLICATES = 200
POOL = ("tournament",)
WINDOW = ("1997-01-01", "1997-06-30")
URGENT = "1-URGENT"
CHAMPIONS = {URGENT: 1, "2-HIGH": -1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}


def query(fn: Query) -> Query:
    """Register a query under its function name."""
    QUERIES[fn.__name__] = fn
    return fn


# --- cleaning, reshaping, form ------------------------------------------------------------


@query
def clean_contests(spark, sf):
    return clean_matches(tb.raw_results(spark, sf), aliases=tb.RAW_ALIASES)


@query
def model_dataset_rows(spark, sf):
    return model_dataset(tb.matches(spark, sf))


@query
def team_long_rows(spark, sf):
    return team_long(tb.results(spark, sf))


@query
def form_features(spark, sf):
    c = tb.played(spark, sf).drop("target_class", "is_team_a_home")
    return rounded(add_form(c))


@query
def parsed_text(spark, sf):
    c = tb.contests(spark, sf)
    day = F.date_format("date", "yyyy-M-d")
    return c.select(
        "match_id",
        parse_day(F.when(F.col("match_id") % 11 == 0, "n.d.").otherwise(day)).alias("day"),
        parse_flag(
            F.when(F.col("match_id") % 13 == 0, " TRUE ")
            .when(F.col("match_id") % 13 == 1, "maybe")
            .otherwise(F.col("is_neutral").cast("int").cast("string"))
        ).alias("flag"),
    )


@query
def earliest_sample(spark, sf):
    return earliest(tb.played(spark, sf).select("match_id", "date"), 1000)


# --- as-of ratings ------------------------------------------------------------------------


@query
def asof_rating(spark, sf):
    out = add_elo_snapshots(tb.played(spark, sf), tb.rating_snapshots(spark, sf))
    return out.select("match_id", "date", "team_a", "team_b", "team_a_elo", "team_b_elo", "elo_diff")


@query
def asof_rank_points(spark, sf):
    out = add_ranking_snapshots(tb.played(spark, sf), tb.ranking_releases(spark, sf))
    return out.select("match_id", *[c for c in out.columns if "fifa" in c])


# The routes for teams and groups too big for one task, forced by a small limit, over a table
# in which some contests have no date.
SMALL_LIMIT = 40
UNDATED_EVERY = 29


def _some_undated(spark, sf):
    dated = F.when(F.col("match_id") % UNDATED_EVERY > 0, F.col("date"))
    return cut_lineage(tb.results(spark, sf).withColumn("date", dated))


@query
def asof_rating_split(spark, sf):
    out = add_elo_snapshots(_some_undated(spark, sf), tb.rating_snapshots(spark, sf), limit=SMALL_LIMIT)
    return out.select("match_id", "date", "team_a", "team_b", "team_a_elo", "team_b_elo", "elo_diff")


@query
def form_features_split(spark, sf):
    c = _some_undated(spark, sf).drop("target_class", "is_team_a_home")
    return rounded(add_form(c, limit=SMALL_LIMIT))


# --- names --------------------------------------------------------------------------------


@query
def canonical_names(spark, sf):
    return canonicalize(tb.word_pairs(spark, sf), ["name_a", "name_b"], tb.NAME_ALIASES)


@query
def unknown_word_names(spark, sf):
    return unknown_names(
        tb.word_pairs(spark, sf), ["name_a"], tb.known_words(spark, sf), tb.NAME_ALIASES
    )


@query
def nearest_word_names(spark, sf):
    known = cut_lineage(tb.known_words(spark, sf))
    unknown = cut_lineage(unknown_names(tb.spoken_words(spark, sf), ["name"], known, {}))
    return rounded(nearest_names(unknown, known))


# --- sources and sinks --------------------------------------------------------------------


def _as_csv(df: DataFrame, label: str) -> str:
    """A text file of a table, blanks and all, under the shared folder."""
    path = scratch_table(df.sparkSession, label)
    exact = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**exact).csv(path)
    return path


@query
def stored_match_rows(spark, sf):
    return read_matches(spark, write_matches(tb.matches(spark, sf), scratch_table(spark, "matches")))


@query
def raw_result_rows(spark, sf):
    return read_results(spark, _as_csv(tb.raw_results(spark, sf), "results"))


@query
def ranking_rows(spark, sf):
    return read_rankings(spark, _as_csv(tb.ranking_releases(spark, sf), "rankings"))


@query
def snapshot_rows(spark, sf):
    return read_elo(spark, _as_csv(tb.rating_snapshots(spark, sf), "ratings"))


@query
def strength_rows(spark, sf):
    return read_strengths(spark, _as_csv(tb.strengths(spark, sf), "strengths"))


@query
def feature_matrix_rows(spark, sf):
    """Both rating sources under untidy spellings, which the alias map leads to the teams."""
    m = tb.stored_matches(spark, sf).withColumns(
        {side: tb.side_name(F.col(side)) for side in ("home_team", "away_team")}
    )
    untidy = F.concat(F.lit(" Side  "), F.col("team").cast("string"), F.lit(" "))
    elo = tb.rating_snapshots(spark, sf).withColumn("team", untidy)
    rankings = tb.ranking_releases(spark, sf).withColumn("team", untidy)
    return rounded(feature_matrix(m, elo=elo, rankings=rankings, aliases=tb.RAW_ALIASES))


# --- quality ------------------------------------------------------------------------------


def _spoiled_matches(spark, sf):
    """Matches with every rule broken now and then."""
    m, i = tb.matches(spark, sf), F.col("match_id")
    home = F.col("home_score")
    return m.select(
        F.when(i % 101 == 0, 0).otherwise(i).alias("match_id"),
        F.when(i % 103 == 0, None).when(i % 107 == 0, F.lit("1800-01-01").cast("date"))
        .otherwise(F.col("date")).alias("date"),
        F.concat(F.when(i % 109 == 0, "T  ").otherwise("T "), F.col("home_team").cast("string"))
        .alias("home_team"),
        F.concat(F.lit("T "), F.when(i % 113 == 0, F.col("home_team")).otherwise(F.col("away_team"))
                 .cast("string")).alias("away_team"),
        F.when(i % 127 == 0, -home - 1).otherwise(home).alias("home_score"),
        F.when(i % 131 == 0, None).otherwise(F.col("away_score")).alias("away_score"),
        F.when(i % 137 == 0, None).otherwise(F.col("neutral")).alias("neutral"),
        F.when(home > F.col("away_score"), "H").when(home < F.col("away_score"), "A")
        .otherwise("D").alias("result"),
        (home > F.col("away_score")).alias("home_win"),
    )


@query
def quality_contests(spark, sf):
    return check_matches(
        cut_lineage(_spoiled_matches(spark, sf)), max_date="2000-01-01", aliases={"T 3": "Three"}, keep_zero=True
    )


@query
def null_summary(spark, sf):
    return null_counts(_spoiled_matches(spark, sf))


@query
def duplicate_line_keys(spark, sf):
    return duplicate_keys(tb.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query
def leakage_check(spark, sf):
    shift = (F.col("match_id") % 3 - 1).cast("int")
    rated = tb.contests(spark, sf).select(
        "date",
        F.date_add("date", shift).alias("team_a_elo_date"),
        F.when(shift > 0, None).otherwise(F.date_add("date", shift)).alias("team_b_elo_date"),
        F.when(F.col("match_id") % 5 == 0, F.date_add("date", 1)).alias("team_a_fifa_date"),
    )
    return future_ratings(rated, ["team_a_elo_date", "team_b_elo_date", "team_a_fifa_date"])


def _spoiled_forecasts(spark, sf):
    f, i = tb.forecasts(spark, sf), F.col("match_id")
    return f.withColumns(
        {
            "p_team_a_win": F.when(i % 17 == 0, None).otherwise(F.col("p_team_a_win")),
            "p_draw": F.when(i % 19 == 0, 1.5).otherwise(F.col("p_draw")),
            "p_team_b_win": F.when(i % 23 == 0, -0.25).otherwise(F.col("p_team_b_win")),
        }
    )


@query
def probability_check(spark, sf):
    return check_probabilities(_spoiled_forecasts(spark, sf), PROBABILITIES, keep_zero=True)


@query
def probability_bounds(spark, sf):
    return check_bounds(_spoiled_forecasts(spark, sf), PROBABILITIES, keep_zero=True)


@query
def feature_check(spark, sf):
    m = tb.stored_matches(spark, sf)
    features = add_form(model_dataset(m)).withColumns(
        {
            "match_id": F.when(F.col("match_id") % 101 == 0, 0).otherwise(F.col("match_id")),
            "target_class": F.when(F.col("match_id") % 103 > 0, F.col("target_class")),
        }
    )
    return check_features(features, expected_rows=m.count() + 5, keep_zero=True)


@query
def table_profile_orders(spark, sf):
    orders = tb.table(spark, sf, "orders")
    return rounded(profile(orders, ["o_orderdate"], ["o_orderpriority", "o_orderstatus"]))


@query
def table_profile_customer(spark, sf):
    customer = tb.table(spark, sf, "customer").withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") % 10 > 0, F.col("c_mktsegment"))
    )
    return rounded(profile(customer, [], ["c_mktsegment", "c_nationkey"]))


# --- order, split, windows ----------------------------------------------------------------


@query
def temporal_split_rows(spark, sf):
    return temporal_split(tb.played(spark, sf).select("match_id", "date"))


@query
def date_cut(spark, sf):
    return rounded(tail_cut(tb.contests(spark, sf)))


@query
def window_rows(spark, sf):
    return window_filter(tb.contests(spark, sf), *WINDOW, URGENT).select("match_id", "date")


# --- walk-forward ratings -----------------------------------------------------------------


def _rated(spark, sf):
    return add_elo(tb.played(spark, sf), POOL)


@query
def elo_pre(spark, sf):
    out = _rated(spark, sf).select("match_id", "tournament", "team_a_elo", "team_b_elo", "elo_diff")
    return rounded(out, 4)


@query
def elo_current(spark, sf):
    return rounded(current_elo(tb.played(spark, sf), POOL), 4)


@query
def elo_leaderboard(spark, sf):
    return rounded(rating_table(current_elo(tb.played(spark, sf), POOL), POOL), 4)


@query
def entering_strength(spark, sf):
    rows = window_filter(_rated(spark, sf), *WINDOW, URGENT)
    return rounded(entering_ratings(rows), 4)


def _favourites(spark, sf):
    rows = _rated(spark, sf).filter(F.col("date").between(*WINDOW))
    return favourites(entering_ratings(rows, POOL), POOL)


@query
def favourite_rank(spark, sf):
    champions = _champions(spark, sf)
    return champion_rank(_favourites(spark, sf), champions)


def _champions(spark, sf):
    """Best team of each tournament's table; one tournament names a team nobody has met."""
    table = standings(tb.played(spark, sf), POOL)
    best = rank_groups(table, POOL).filter(F.col("rank") == 1)
    return best.select(
        "tournament",
        F.when(F.col("tournament") == "5-LOW", F.lit(-1)).otherwise(F.col("team")).alias("champion"),
    )


@query
def favourite_order(spark, sf):
    return rounded(_favourites(spark, sf), 4)


@query
def participant_list(spark, sf):
    return participants(tb.contests(spark, sf), "tournament")


@query
def elo_expectancy(spark, sf):
    rated = add_elo_snapshots(tb.played(spark, sf), tb.rating_snapshots(spark, sf))
    a, b = F.col("team_a_elo"), F.col("team_b_elo")
    bonus = F.when(F.col("is_team_a_home"), 65.0).otherwise(0.0)
    expected = expected_score(a, b, bonus)
    actual = points(F.col("team_a_score"), F.col("team_b_score"))
    actual = F.when(actual == 3, 1.0).when(actual == 1, 0.5).otherwise(0.0)
    return rounded(
        rated.select(
            "match_id",
            expected.alias("expected"),
            updated_rating(a, expected, actual).alias("updated"),
        )
    )


@query
def pair_forecast_rows(spark, sf):
    c = tb.played(spark, sf)
    pairs = c.select("tournament", "team_a", "team_b", "is_neutral").distinct()
    # Some teams have a rating under another name only.
    renamed = F.when(F.col("team") % 7 == 0, -F.col("team")).otherwise(F.col("team"))
    ratings = current_elo(c, POOL).withColumn("team", renamed)
    return rounded(pair_forecast(pairs, ratings, keys=POOL))


# --- scoring ------------------------------------------------------------------------------


@query
def strength_forecast(spark, sf):
    f = tb.forecasts(spark, sf)
    return rounded(prediction_frame(f).withColumn("predicted", top_label()))


@query
def clipped_forecast(spark, sf):
    f = tb.forecasts(spark, sf)
    zeroed = [F.when(F.col(p) < 0.2, 0.0).otherwise(F.col(p)) for p in PROBABILITIES]
    parts = clip_normalize(zeroed, 0.01)
    return rounded(f.select("match_id", *[p.alias(n) for p, n in zip(parts, PROBABILITIES)]))


@query
def class_prior_row(spark, sf):
    return rounded(class_prior(tb.results(spark, sf)))


@query
def unexpected_label_rows(spark, sf):
    labels = tb.contests(spark, sf).select(
        F.when(F.col("status") == "P", "pending").when(F.col("status") == "O", "draw")
        .alias("target_class")
    )
    return unexpected_labels(labels)


@query
def score_forecast(spark, sf):
    return rounded(score(tb.forecasts(spark, sf), POOL))


@query
def ece(spark, sf):
    return rounded(calibration_error(tb.forecasts(spark, sf), POOL))


@query
def reliability_curve(spark, sf):
    return rounded(reliability(tb.forecasts(spark, sf)))


@query
def confusion_matrix(spark, sf):
    return confusion(tb.forecasts(spark, sf))


@query
def class_performance(spark, sf):
    return rounded(class_report(tb.forecasts(spark, sf)))


def _board(spark, sf):
    f = tb.forecasts(spark, sf).withColumnsRenamed({p: f"given_{p}" for p in PROBABILITIES})
    f = cut_lineage(f)
    models = {
        "strength": PriorModel(tuple(F.col(f"given_{p}") for p in PROBABILITIES)),
        "uniform_random": uniform_model(),
        "class_frequency": fit_prior(f),
    }
    return leaderboard(score_together(f, models))


@query
def model_leaderboard(spark, sf):
    return rounded(_board(spark, sf))


@query
def baseline_comparison(spark, sf):
    return rounded(
        comparison(_board(spark, sf), "strength", ["uniform_random", "class_frequency"])
    )


# --- standings and brackets ---------------------------------------------------------------


@query
def standings_rows(spark, sf):
    return standings(tb.results(spark, sf), POOL)


def _group_table(spark, sf):
    c = tb.played(spark, sf)
    return group_table(tb.members(spark, sf, c), c, POOL)


@query
def group_table_rows(spark, sf):
    return _group_table(spark, sf)


def _ranked(spark, sf, seed=None):
    return rank_groups(_group_table(spark, sf), [*POOL, "group"], seed)


@query
def group_rank(spark, sf):
    return _ranked(spark, sf).select("tournament", "group", "team", "points", "rank")


@query
def group_rank_by_lot(spark, sf):
    ranked = _ranked(spark, sf, SEED)
    return rounded(
        ranked.select("tournament", "group", "team", "rank",
                      lot(SEED, "tournament", "group", "team").alias("lot")), 9
    )


@query
def rank_split(spark, sf):
    ranked = rank_groups(_group_table(spark, sf), POOL, limit=SMALL_LIMIT)
    return ranked.select("tournament", "team", "points", "rank")


@query
def group_top_two(spark, sf):
    return top_two(_ranked(spark, sf)).select("tournament", "group", "team", "rank")


@query
def best_third_teams(spark, sf):
    return best_thirds(_ranked(spark, sf), POOL).select("tournament", "group", "team", "third_rank")


def _seeded(spark, sf):
    ranked = _ranked(spark, sf)
    return seeds(ranked, best_thirds(ranked, POOL), POOL)


@query
def bracket_seeding(spark, sf):
    return bracket_slots(_seeded(spark, sf))


@query
def seeding_check(spark, sf):
    # Teams that count as one make the seeding wrong in places; no row is left out.
    merged = F.when(F.col("team") % 10 == 3, F.lit(0)).otherwise(F.col("team"))
    return seeding_problems(_seeded(spark, sf).withColumn("team", merged), POOL)


def _tokens(spark, sf):
    ranked = _ranked(spark, sf)
    return slot_tokens(ranked, best_thirds(ranked, POOL), POOL)


def _pairings(spark, sf):
    """Winner of a group against the runner-up of the next, or a third; one token is wrong."""
    groups = tb.members(spark, sf).select("tournament", "group").distinct()
    number = F.ascii("group") - 65
    return groups.select(
        "tournament",
        (number + 1).alias("match"),
        F.concat(F.lit("1"), "group").alias("home"),
        F.when(number < 8, F.concat(F.lit("3-"), (number + 1).cast("string")))
        .when(number == 11, F.lit("9Z"))
        .otherwise(F.concat(F.lit("2"), F.char(number + 66)))
        .alias("away"),
    )


@query
def slot_resolution(spark, sf):
    return resolve_pairings(_pairings(spark, sf), _tokens(spark, sf), POOL)


@query
def unknown_slot_tokens(spark, sf):
    return unknown_tokens(_pairings(spark, sf), _tokens(spark, sf), POOL)


@query
def schedule_check(spark, sf):
    # Some members have another name in the draw, so their contests are of unknown teams.
    c = tb.played(spark, sf)
    members = tb.members(spark, sf, c)
    renamed = F.when(F.col("team") % 9 == 0, -F.col("team")).otherwise(F.col("team"))
    doubled = members.withColumn(
        "group",
        F.explode(F.when(F.col("team") % 8 == 0, F.array("group", F.lit("A")))
                  .otherwise(F.array("group"))),
    ).withColumn("team", renamed)
    home = members.select("tournament", "group", F.col("team").alias("home"))
    season = c.select(
        "tournament", F.col("team_a").alias("home"),
        F.when(F.col("match_id") % 10 == 0, F.col("team_a")).otherwise(F.col("team_b"))
        .alias("away"),
    )
    return check_schedule(doubled, season.join(home, ["tournament", "home"]), POOL)


# --- draws and advancement ----------------------------------------------------------------


@query
def keyed_draw(spark, sf):
    f = tb.forecasts(spark, sf)
    u = keyed_uniform(SEED, F.col("match_id"))
    return rounded(f.select("match_id", u.alias("u"), drawn_class(u).alias("outcome")), 9)


@query
def advance_probability_rows(spark, sf):
    f = tb.forecasts(spark, sf)
    through = advance_probability(*[F.col(p) for p in PROBABILITIES])
    u = keyed_uniform(SEED, F.lit("through"), F.col("match_id"))
    winner = drawn_winner(u, F.col("team_a"), F.col("team_b"), through)
    return rounded(f.select("match_id", through.alias("p_through"), winner.alias("winner")))


@query
def next_round(spark, sf):
    slots = bracket_slots(_seeded(spark, sf)).select("tournament", "slot", "team")
    return play_round(slots, tb.strengths(spark, sf), POOL, SEED, 0)


def _shares(spark, sf):
    told = tb.forecasts(spark, sf).select("match_id", *POOL, "team_a", "team_b", *PROBABILITIES)
    told = cut_lineage(told)
    members = tb.members(spark, sf, told)
    outcomes = stage_outcomes(
        members,
        told,
        tb.strengths(spark, sf),
        keys=POOL,
        replicates=REPLICATES,
        seed=SEED,
    )
    return cut_lineage(advancement_shares(outcomes, REPLICATES, POOL, members))


@query
def advancement(spark, sf):
    return rounded(_shares(spark, sf))


@query
def advancement_summary(spark, sf):
    return summarize(_shares(spark, sf), POOL)


@query
def title_contenders(spark, sf):
    shares = contenders(_shares(spark, sf), POOL)
    return rounded(shares.select(*POOL, "place", "team", "win_title_probability"))


# --- models held to SQL by what marks the one right answer ----------------------------------

#: Mean gradient that still counts as none: of the library's solver, and of the Newton steps.
NO_GRADIENT, NO_GROUP_GRADIENT = 1e-3, 1e-6


def _form_rows(spark, sf):
    """Contests with form differences, split by time; no rating, so no walk."""
    # The split goes by date and number, so the form behind it is computed once, not per cut.
    return cut_lineage(add_form(temporal_split(tb.played(spark, sf))))


@query
def logistic_optimality(spark, sf):
    """The objective is strictly convex in the weights, so no gradient means the right ones."""
    train_rows = _form_rows(spark, sf).filter(F.col("split") == "train")
    names = ["form_5_diff", "form_10_diff", "is_team_a_home"]
    left = optimality(fit_logistic(train_rows, names), train_rows)
    return left.select("class", "input", "n", (F.abs("gradient") <= NO_GRADIENT).alias("optimal"))


@query
def grouped_logistic_optimality(spark, sf):
    """The same for one fit per tournament, all made together."""
    rows = with_label_index(_form_rows(spark, sf))
    left = fit_grouped(rows, POOL, ["form_5_diff", "is_team_a_home"])
    left = left.gradients(rows)
    return left.select(*POOL, "class", "input", "n", (F.abs("gradient") <= NO_GROUP_GRADIENT).alias("optimal"))


@query
def isotonic_steps(spark, sf):
    """The isotonic map of every class at hundredths of its probability, fitted on all rows."""
    hundredths = {p: F.floor(F.col(p) * 100).cast("double") for p in PROBABILITIES}
    f = cut_lineage(tb.forecasts(spark, sf).withColumns(hundredths).select("target_class", *PROBABILITIES))
    steps = []
    for name, p, fitted in zip(CLASSES, PROBABILITIES, fit_maps(f, "isotonic")):
        seen = f.groupBy(F.col(p).alias("score")).agg(F.count(F.lit(1)).alias("n"))
        steps.append(fitted.apply(seen, "score", "share").select(F.lit(name).alias("class"), "score", "n", "share"))
    return rounded(reduce(DataFrame.unionByName, steps))


# --- models (no SQL counterpart) ----------------------------------------------------------


def _features(spark, sf):
    """Form and walk-forward rating, the inputs of the models."""
    base = add_form(tb.played(spark, sf)).drop(*[f"{f}_{s}" for f in TEAM_FEATURES for s in "ab"])
    return cut_lineage(add_elo(base, POOL))


def _split_features(spark, sf):
    split = cut_lineage(temporal_split(_features(spark, sf)))
    return {p: split.filter(F.col("split") == p).drop("split") for p in ("train", "val", "test")}


@query
def logistic_scores(spark, sf):
    part = _split_features(spark, sf)
    model = fit_logistic(part["train"], ["elo_diff", "form_5_diff", "is_team_a_home"])
    return rounded(prediction_frame(model.transform(part["test"])))


@query
def ensemble_scores(spark, sf):
    part = _split_features(spark, sf)
    members = [fit_prior(part["train"]), fit_logistic(part["train"], ["elo_diff"])]
    model = EnsembleModel(members, [1.0, 2.0])
    return rounded(prediction_frame(model.transform(part["test"])))


@query
def ensemble_forecast(spark, sf):
    """The weighted blend of two members that SQL can state."""
    d = tb.played(spark, sf)
    blend = EnsembleModel([fit_prior(d), uniform_model()], [1.0, 3.0])
    return rounded(prediction_frame(blend.transform(d)), 9)


@query
def backtest_summary_row(spark, sf):
    """The summary over one row of scores per tournament."""
    f = cut_lineage(tb.forecasts(spark, sf))
    errors = calibration_error(f, POOL)
    rows = score(f, POOL).join(errors, list(POOL))
    return backtest_summary(rows.withColumn("champion_in_top_5", F.col("tournament") < "3"))


@query
def calibrated_scores(spark, sf):
    part = _split_features(spark, sf)
    base = fit_logistic(part["train"], ["elo_diff", "form_5_diff"])
    return rounded(prediction_frame(calibrate(base, part["val"]).transform(part["test"])))


@query
def boosted_scores(spark, sf):
    part = _split_features(spark, sf)
    model = fit_boosted(part["train"], ["elo_diff", "form_5_diff"])
    return rounded(prediction_frame(model.transform(part["test"])))


@query
def training_leaderboard(spark, sf):
    return rounded(train(_features(spark, sf)).board)


@query
def backtest_rows(spark, sf):
    tournaments = [
        Tournament(f"{name} 1997", *WINDOW, champion, name)
        for name, champion in CHAMPIONS.items()
    ]
    rows, _ = backtest(
        _features(spark, sf), tournaments, candidates=["elo_diff", "form_5_diff", "is_team_a_home"]
    )
    return rounded(rows)
