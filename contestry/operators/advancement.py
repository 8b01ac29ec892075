"""Advancement shares over replicate outcomes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from contestry.functions.batch_draws import HEAD_BITS, head_drawer
from contestry.functions.elo import strength_probabilities
from contestry.functions.probability import (
    advance_probability,
    drawn_class,
    drawn_winner,
    keyed_uniform,
)
from contestry.operators.ordering import MAX_GROUP_ROWS, pieces_needed, top_rows
from contestry.operators.standings import (
    best_thirds,
    bracket_slots,
    pairs_of,
    rank_groups,
    seeds,
    with_derived,
)
from contestry.schemas import CLASSES, PROBABILITIES, STAGES
from contestry.session import cut_lineage, spread

# Contests whose draws are held at once.
ROWS_AT_ONCE = 2_000
# Winners, runners-up and thirds: later places of a group are not read.
LAST_PLACE = 3


def replicate(df: DataFrame, n: int) -> DataFrame:
    """Every row once per replicate 0 .. n-1."""
    if n <= 0:
        raise ValueError(f"the number of replicates must be positive, got {n}")
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def draw_outcomes(forecasts: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Add the drawn class of each row, keyed by its own columns."""
    return forecasts.withColumn("outcome", drawn_class(keyed_uniform(seed, *map(F.col, keys))))


def drawn_table(members: DataFrame, drawn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records of group members over drawn outcomes.

    ``members`` has all ``keys``. A member without a contest has a record of zeros. A drawn
    contest has no score, so goals stay 0 and equal points are split by lot.
    """
    a_won, level = F.col("outcome") == CLASSES[0], F.col("outcome") == CLASSES[1]
    result = F.when(a_won, 1).when(level, 0).otherwise(-1)
    sides = F.array(
        F.struct(F.col("team_a").alias("team"), result.alias("_r")),
        F.struct(F.col("team_b").alias("team"), (-result).alias("_r")),
    )
    record = (
        drawn.select(*keys, F.inline(sides))
        .groupBy(*keys, "team")
        .agg(
            F.count(F.lit(1)).alias("played"),
            F.count_if(F.col("_r") > 0).alias("won"),
            F.count_if(F.col("_r") == 0).alias("drawn"),
            F.count_if(F.col("_r") < 0).alias("lost"),
        )
    )
    joined = members.join(record, [*keys, "team"], "left").fillna(0, ["played", "won", "drawn", "lost"])
    return with_derived(
        joined.withColumns(
            {"goals_for": F.lit(0).cast("bigint"), "goals_against": F.lit(0).cast("bigint")}
        )
    )


def _below(share: Column) -> Column:
    """How many heads of a digest are below a share, so that ``head < this`` is ``uniform < share``.

    The product is exact. As in a comparison of columns, null is below nothing and NaN above all.
    """
    whole = F.ceil(F.greatest(F.lit(0.0), F.least(F.lit(2.0), share)) * F.lit(float(2**HEAD_BITS)))
    above = F.lit(2 ** (HEAD_BITS + 1))
    return F.when(F.isnan(share), above).otherwise(F.when(share.isNull(), 0).otherwise(whole)).cast("bigint")


def _draws(kept: Sequence[str], replicates: int, seed: int, schema: pa.Schema):
    """The outcome of each contest in all replicates, a bit for each: won by either side, drawn."""
    heads, at_once = head_drawer(), ROWS_AT_ONCE
    prefixes: dict[int, list[bytes]] = {}
    for r in range(replicates):
        prefixes.setdefault(len(str(r)), []).append(f"{seed}|{r}|".encode())

    def drawn(rows: pa.RecordBatch) -> np.ndarray:
        texts = rows.column("_text").cast(pa.binary())
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        out = np.empty((len(texts), replicates), np.int64)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            data = np.frombuffer(b"".join(texts.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), length)
            out[at] = np.hstack([heads(some, data) for some in prefixes.values()])
        return out

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                rows = batch.slice(at, at_once)
                head = drawn(rows)
                low, high = (rows.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("_low", "_high"))
                first = head < low
                level = ~first & (head < high)
                bits = [np.packbits(x, axis=1) for x in (first, ~first & ~level, level)]
                columns = [rows.column(c) for c in kept] + [pa.array([x.tobytes() for x in each], pa.binary()) for each in bits]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return draw


def _tally(keys: Sequence[str], replicates: int, schema: pa.Schema):
    """Won and drawn contests of each key in every replicate, over rows sorted by the keys."""
    at_once = ROWS_AT_ONCE

    def tallied(rows: pa.RecordBatch, starts: np.ndarray) -> list[np.ndarray]:
        sums = []
        for c in ("_won", "_level"):
            bits = np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            flags = np.unpackbits(bits, axis=1, count=replicates)
            sums.append(np.add.reduceat(flags, starts, axis=0, dtype=np.int64))
        return sums

    def told(run: pa.RecordBatch, played, won, level) -> pa.RecordBatch:
        records = pa.StructArray.from_arrays([won.ravel(), level.ravel()], ["won", "drawn"])
        offsets = np.arange(len(played) + 1, dtype=np.int32) * replicates
        columns = [*run.columns, pa.array(played), pa.ListArray.from_arrays(offsets, records)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run = None  # the last key of the rows so far goes on in the next ones
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                rows = batch.slice(at, at_once)
                n, new = rows.num_rows, np.zeros(rows.num_rows, bool)
                new[0] = True
                for k in keys:
                    column = rows.column(k)
                    differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), True)
                    new[1:] |= differs.to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(new)
                run = rows.select(list(keys)).take(pa.array(starts))
                played = np.diff(np.append(starts, n))
                won, level = tallied(rows, starts)
                if open_run is not None:
                    if open_run[0].to_pylist() == run.slice(0, 1).to_pylist():
                        for mine, past in zip((played, won, level), open_run[1:]):
                            mine[0] += past[0]
                    else:
                        yield told(*open_run)
                if len(starts) > 1:
                    yield told(run.slice(0, len(starts) - 1), played[:-1], won[:-1], level[:-1])
                open_run = (run.slice(len(starts) - 1), played[-1:], won[-1:], level[-1:])
        if open_run is not None:
            yield told(*open_run)

    return tally


def drawn_records(
    members: DataFrame, forecasts: DataFrame, keys: Sequence[str], replicates: int, seed: int,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """:func:`drawn_table` of all replicates, without a row for each draw.

    All replicates of a contest are drawn at once, as :func:`draw_outcomes` does. Its two sides go
    to their teams with two bits for each replicate and are counted there, so the rows shuffled are
    as many as the sides. A team above ``limit`` contests is dealt into pieces.
    """
    if replicates <= 0:
        raise ValueError(f"the number of replicates must be positive, got {replicates}")
    a, d, b = (F.col(p) for p in PROBABILITIES)
    total = a + d + b
    checked = F.when(
        (a < 0) | (d < 0) | (b < 0) | (total <= 0),
        F.raise_error(F.lit("weights must be non-negative with a positive sum")),
    ).otherwise(total)
    shares = forecasts.select(
        *keys, "team_a", "team_b", F.coalesce(F.col("match_id").cast("string"), F.lit("\\N")).alias("_text"),
        _below(a / checked).alias("_low"), _below((a + d) / checked).alias("_high"),
    )
    teams = F.explode(F.array("team_a", "team_b")).alias("team")
    pieces = pieces_needed(shares.select(*keys, teams).groupBy(*keys, "team").agg(F.count(F.lit(1)).alias("_n")), "_n", limit)
    # Drawn before the sides part, so a contest is drawn once.
    kept = [*keys, "team_a", "team_b", "_piece"]
    shares = spread(shares.withColumn("_piece", F.pmod(F.xxhash64("_text"), F.lit(pieces)).cast("int")))
    bits = [T.StructField(c, T.BinaryType()) for c in ("_a", "_b", "_level")]
    outcomes = T.StructType([*[shares.schema[c] for c in kept], *bits])
    drawn = shares.mapInArrow(_draws(kept, replicates, seed, to_arrow_schema(outcomes)), outcomes)
    sides = F.array(*[F.struct(F.col(f"team_{s}").alias("team"), F.col(f"_{s}").alias("_won")) for s in "ab"])
    by = [*keys, "team", "_piece"]
    each = drawn.select(*keys, "_piece", "_level", F.inline(sides))
    fields = [each.schema[c] for c in by]
    record = T.StructType([T.StructField(c, T.LongType()) for c in ("won", "drawn")])
    out = T.StructType([*fields, T.StructField("played", T.LongType()), T.StructField("_records", T.ArrayType(record))])
    tally = _tally(by, replicates, to_arrow_schema(out))
    told = each.repartition(*by).sortWithinPartitions(*by).mapInArrow(tally, out)
    counts = ["played", "won", "drawn"]
    if pieces > 1:
        told = told.select(*keys, "team", "played", F.posexplode("_records").alias("replicate", "_r"))
        told = told.select(*keys, "team", "replicate", "played", "_r.won", "_r.drawn")
        told = told.groupBy(*keys, "team", "replicate").agg(*[F.sum(c).alias(c) for c in counts])
        told = replicate(members, replicates).join(told, [*keys, "replicate", "team"], "left").fillna(0, counts)
    else:
        none = F.array_repeat(F.struct(F.lit(0).cast("bigint").alias("won"), F.lit(0).cast("bigint").alias("drawn")), replicates)
        told = members.join(told, [*keys, "team"], "left").withColumn("_records", F.coalesce("_records", none))
        told = told.select(
            *members.columns, F.coalesce("played", F.lit(0)).alias("played"), F.posexplode("_records").alias("replicate", "_r")
        ).select(*members.columns, "replicate", "played", "_r.won", "_r.drawn")
    return with_derived(told.withColumns({
        "lost": F.col("played") - F.col("won") - F.col("drawn"),
        "goals_for": F.lit(0).cast("bigint"), "goals_against": F.lit(0).cast("bigint"),
    }))


def play_round(
    slots: DataFrame, strengths: DataFrame, keys: Sequence[str], seed: int, round_no: int
) -> DataFrame:
    """Slots of the next round: each pair's drawn winner."""
    shared = [k for k in keys if k in strengths.columns]
    pairs = pairs_of(slots, keys)
    for s in "ab":
        side = strengths.select(
            *shared, F.col("team").alias(f"team_{s}"), F.col("strength").alias(f"_{s}")
        )
        pairs = pairs.join(side, [*shared, f"team_{s}"], "left")
    through = advance_probability(*strength_probabilities(F.col("_a"), F.col("_b")))
    uniform = keyed_uniform(seed, F.lit(round_no), *map(F.col, keys), F.col("slot"))
    # A slot left empty by a short field is a bye for the other side.
    winner = drawn_winner(uniform, F.col("team_a"), F.col("team_b"), through)
    either = F.coalesce("team_a", "team_b")
    both = F.col("team_a").isNotNull() & F.col("team_b").isNotNull()
    return pairs.select(*keys, "slot", F.when(both, winner).otherwise(either).alias("team"))


def fold_bracket(
    slots: DataFrame, strengths: DataFrame, keys: Sequence[str], size: int, seed: int
) -> DataFrame:
    """Whole brackets at once: per key ``rounds``, for each round the sides still in.

    A bracket is one array of ``size`` sides, its strengths attached once. Each round halves it:
    neighbours meet, the winner is drawn by the round and its new place, an empty place is a bye.
    The rounds are expressions over that array, so no rows move between them.
    """
    shared = [k for k in keys if k in strengths.columns]
    side = F.struct("team", "strength")
    placed = slots.join(strengths.select(*shared, "team", "strength"), [*shared, "team"], "left")
    listed = F.sort_array(F.collect_list(F.struct("slot", "team", "strength")))
    grouped = placed.groupBy(*keys).agg(listed.alias("_listed"))
    as_side = lambda x: F.struct(x["team"].alias("team"), x["strength"].alias("strength"))
    at_slot = lambda i: F.get(F.filter("_listed", lambda x: x["slot"] == i), F.lit(0))
    kind = placed.select(side.alias("s")).schema["s"].dataType
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))
    # Only a short field has to look for its places.
    spread = F.transform(places, lambda i: F.when(at_slot(i).isNotNull(), as_side(at_slot(i))))
    full = F.when(F.size("_listed") == size, F.transform("_listed", as_side)).otherwise(spread)
    out = grouped.select(*keys, full.cast(T.ArrayType(kind)).alias("_r0"))

    def played(round_no: int, left: int):
        def meet(j):
            a, b = (F.get(f"_r{round_no}", (2 * j + k).cast("int")) for k in (0, 1))
            through = advance_probability(*strength_probabilities(a["strength"], b["strength"]))
            uniform = keyed_uniform(seed, F.lit(round_no), *map(F.col, keys), j)
            both = a["team"].isNotNull() & b["team"].isNotNull()
            return F.when(both, drawn_winner(uniform, a, b, through)).otherwise(F.coalesce(a, b))

        pairs = F.sequence(F.lit(0).cast("bigint"), F.lit(left // 2 - 1).cast("bigint"))
        return F.transform(pairs, meet)

    left, n = size, 0
    while left > 1:
        out = out.withColumn(f"_r{n + 1}", played(n, left))
        left, n = left // 2, n + 1
    teams = [F.transform(F.filter(f"_r{k}", lambda x: x.isNotNull()), lambda x: x["team"]) for k in range(n + 1)]
    return out.select(*keys, F.array(*teams).alias("rounds"))


def stage_outcomes(
    members: DataFrame,
    forecasts: DataFrame,
    strengths: DataFrame,
    *,
    keys: Sequence[str] = (),
    replicates: int,
    seed: int,
    n_thirds: int = 8,
    size: int = 32,
) -> DataFrame:
    """(keys, replicate, team, stage) reached, from group tables to the champion.

    Replicates are not a loop: one job draws every group contest of every replicate and
    ranks every group, another one folds every bracket. Two tables are written on the way.
    """
    per = [*keys, "replicate"]
    placing = ["group", "team", "points", "goal_difference", "goals_for"]
    # Far smaller than the draws it sums up, and read by the ranking more than once.
    table = cut_lineage(drawn_records(members, forecasts, keys, replicates, seed).select(*per, *placing))
    ranked = rank_groups(table, [*per, "group"], seed)
    # Both qualifying routes and the stage table read the ranking. The filter is known to the
    # window, so a task passes on the first of each group only.
    ranked = cut_lineage(ranked.filter(F.col("rank") <= LAST_PLACE).select(*per, "rank", *placing))
    thirds = best_thirds(ranked, per, n_thirds, seed)
    slots = bracket_slots(seeds(ranked, thirds, per), size).select(*per, "slot", "team")
    names = [s for s in STAGES if s != "win_group"]
    names = names[len(names) - size.bit_length() :]
    folded = fold_bracket(slots, strengths, per, size, seed)

    def reached(k: int, name: str):
        return F.transform(F.get("rounds", F.lit(k)), lambda t: F.struct(t.alias("team"), F.lit(name).alias("stage")))

    stages = F.concat(*(reached(k, name) for k, name in enumerate(names)))
    won = ranked.filter(F.col("rank") == 1).select(*per, "team", F.lit("win_group").alias("stage"))
    return won.unionByName(folded.select(*per, F.inline(stages)))


def advancement_shares(
    outcomes: DataFrame, replicates: int, keys: Sequence[str] = (), teams: DataFrame | None = None
) -> DataFrame:
    """Share of replicates in which each team reached each stage.

    ``teams`` adds those that never got anywhere, with zeros.
    """
    counts = outcomes.groupBy(*keys, "team").agg(
        *[F.count_if(F.col("stage") == s).alias(out) for s, out in STAGES.items()]
    )
    if teams is not None:
        counts = teams.select(*keys, "team").join(counts, [*keys, "team"], "left").fillna(0)
    return counts.select(
        *keys, "team", *[(F.col(out) / F.lit(replicates)).alias(out) for out in STAGES.values()]
    )


def contenders(shares: DataFrame, keys: Sequence[str] = (), n: int = 10) -> DataFrame:
    """The ``n`` likeliest champions of each key with their ``place``, ties by name (K4)."""
    best = [F.desc("win_title_probability"), F.asc("team")]
    return top_rows(shares, list(keys), best, "place", n)


def summarize(shares: DataFrame, keys: Sequence[str] = (), n: int = 10) -> DataFrame:
    """Number of teams, total title probability, the favourite and the ``n`` likeliest
    champions in order, per key (A15)."""
    totals = shares.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_teams"),
        F.round(F.sum("win_title_probability"), 6).alias("title_probability_total"),
    )
    top = contenders(shares, keys, n).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("place", "team"))).alias("_top")
    )
    top = top.select(
        *keys,
        F.col("_top")[0]["team"].alias("favourite"),
        F.array_join(F.transform("_top", lambda t: t["team"].cast("string")), ",").alias("contenders"),
    )
    if keys:
        return totals.join(top, list(keys))
    one = F.lit(0).alias("_one")  # both sides are one row
    return totals.select("*", one).join(top.select("*", one), "_one").drop("_one")
