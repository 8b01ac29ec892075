"""The same queries in SQL, for checking results on another engine."""

from __future__ import annotations

from contestry.plans.catalog import POOL, REPLICATES, SEED, UNDATED_EVERY, URGENT, WINDOW
from contestry.plans.testbed import NAME_ALIASES, RAW_ALIASES
from contestry.schemas import (
    CLASSES,
    DIFFERENCES,
    LABEL_COLUMNS,
    PROBABILITIES,
    STAGES,
    TEAM_FEATURES,
)

assert POOL == ("tournament",)

# Named subqueries, each with the ones it reads. ``sql`` puts them in front of a query.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, text: str, *needs: str) -> None:
    PARTS[name] = (needs, text)


def sql(text: str, *needs: str, recursive: bool = False, undated: bool = False) -> str:
    """A query behind the subqueries it needs, in order; ``undated`` takes some dates away."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in PARTS[name][0]:
                visit(other)
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return text
    heads = []
    for n in order:
        body = PARTS[n][1]
        if undated and n == "c":
            heads.append(f"dated_c AS MATERIALIZED ({body})")
            body = (
                f"SELECT * REPLACE (CASE WHEN match_id % {UNDATED_EVERY} > 0 THEN date END AS date) "
                "FROM dated_c"
            )
        heads.append(body if body.startswith(f"{n}(") else f"{n} AS MATERIALIZED ({body})")
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(heads) + "\n" + text


part(
    "c",
    """
  SELECT p.ok * 64 + p.i AS match_id, CAST(o.o_orderdate AS DATE) AS date, p.a AS team_a,
         p.b AS team_b, p.ga AS team_a_score, p.gb AS team_b_score, (p.ok % 3 = 0) AS is_neutral,
         o.o_orderpriority AS tournament, o.o_orderstatus AS status
  FROM (SELECT ok, sk AS a, g AS ga, lead(sk) OVER w AS b, lead(g) OVER w AS gb,
               row_number() OVER w AS i
        FROM (SELECT l_orderkey AS ok, l_suppkey AS sk,
                     CAST(FLOOR(SUM(l_quantity) / 10) AS INT) AS g
              FROM lineitem GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY ok ORDER BY sk)) p
  JOIN orders o ON o.o_orderkey = p.ok WHERE p.b IS NOT NULL""",
)
part(
    "d",
    """
  SELECT * EXCLUDE (status), NOT is_neutral AS is_team_a_home,
         CASE WHEN team_a_score > team_b_score THEN 'team_a_win'
              WHEN team_a_score < team_b_score THEN 'team_b_win' ELSE 'draw' END AS target_class
  FROM c""",
    "c",
)
part(
    "m",
    """
  SELECT match_id, date, team_a AS home_team, team_b AS away_team, team_a_score AS home_score,
         team_b_score AS away_score, is_neutral AS neutral, tournament, n_name AS venue_country
  FROM c LEFT JOIN supplier ON s_suppkey = team_a LEFT JOIN nation ON n_nationkey = s_nationkey""",
    "c",
)
part(
    "long",
    """
  SELECT *, goals_for - goals_against AS goal_diff,
         CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1
              ELSE 0 END AS points
  FROM (SELECT match_id, date, tournament, 'a' AS side, team_a AS team,
               team_a_score AS goals_for, team_b_score AS goals_against FROM c
        UNION ALL
        SELECT match_id, date, tournament, 'b', team_b, team_b_score, team_a_score FROM c)""",
    "c",
)

# --- form ---------------------------------------------------------------------------------

_FRAMES = ",\n         ".join(
    f"AVG({m}) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS last_{n}_{m}_"
    + ("per_match" if m == "points" else "avg")
    for n in (5, 10)
    for m in ("points", "goals_for", "goals_against", "goal_diff")
)
part(
    "form",
    f"""
  SELECT match_id, side, {_FRAMES},
         CAST(date - LAG(date) OVER w AS INT) AS days_since_last_match,
         CASE WHEN date IS NOT NULL THEN ROW_NUMBER() OVER w - 1
           - COUNT(*) OVER (PARTITION BY team ORDER BY date
               RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 365 DAY PRECEDING)
         END AS matches_played_last_365_days
  FROM long WINDOW w AS (PARTITION BY team ORDER BY date, match_id)""",
    "long",
)
_SIDES = ", ".join(f"{s}.{f} AS {f}_{s}" for s in "ab" for f in TEAM_FEATURES)
_DIFFS = ", ".join(f"a.{f} - b.{f} AS {out}" for out, f in DIFFERENCES.items())
part(
    "features",
    f"""
  SELECT c.match_id, {_SIDES}, {_DIFFS}
  FROM c JOIN form a ON a.match_id = c.match_id AND a.side = 'a'
         JOIN form b ON b.match_id = c.match_id AND b.side = 'b'""",
    "c",
    "form",
)


def _r(column: str, digits: int = 6) -> str:
    return f"ROUND({column}, {digits}) AS {column}"


_WHOLE = ("days_since_last_match", "matches_played_last_365_days")
_FORM_OUT = ", ".join(
    [f"{f}_{s}" if f in _WHOLE else _r(f"{f}_{s}") for s in "ab" for f in TEAM_FEATURES]
    + [d if f in _WHOLE else _r(d) for d, f in DIFFERENCES.items()]
)

# --- as-of --------------------------------------------------------------------------------

part(
    "snaps",
    """
  SELECT l_suppkey AS team, CAST(date_trunc('month', l_shipdate) AS DATE) AS rdate,
         CAST(1000 + COUNT(*) AS DOUBLE) AS elo
  FROM lineitem GROUP BY 1, 2""",
)
part(
    "releases",
    """
  SELECT l_suppkey AS team, CAST(date_trunc('month', l_shipdate) AS DATE) AS rdate,
         CAST(COUNT(*) AS INT) AS rank, CAST(SUM(l_quantity) AS DOUBLE) AS points
  FROM lineitem GROUP BY 1, 2""",
)
part(
    "rated_c",
    """
  SELECT d.*, a.elo AS team_a_elo, b.elo AS team_b_elo, a.elo - b.elo AS elo_diff
  FROM d ASOF LEFT JOIN snaps a ON a.team = d.team_a AND a.rdate <= d.date
         ASOF LEFT JOIN snaps b ON b.team = d.team_b AND b.rdate <= d.date""",
    "d",
    "snaps",
)

# --- forecasts ----------------------------------------------------------------------------

_EXPONENT = "LEAST(50.0, GREATEST(-50.0, -(COALESCE({a}, 0.0) - COALESCE({b}, 0.0)) / 100.0))"


def strength_sql(a: str, b: str) -> str:
    """Three probability columns from two strength expressions."""
    decided = f"(1.0::DOUBLE / (1.0 + POW(10.0::DOUBLE, {_EXPONENT.format(a=a, b=b)})))"
    return (
        f"(1.0 - 0.22::DOUBLE) * {decided} AS p_team_a_win, 0.22::DOUBLE AS p_draw, "
        f"(1.0 - 0.22::DOUBLE) * (1.0 - {decided}) AS p_team_b_win"
    )


part("f", f"SELECT *, {strength_sql('20 * team_a_elo', '20 * team_b_elo')} FROM rated_c", "rated_c")
part(
    "g",
    """
  SELECT *, CASE WHEN p_team_a_win >= p_draw AND p_team_a_win >= p_team_b_win THEN 'team_a_win'
                 WHEN p_draw >= p_team_b_win THEN 'draw' ELSE 'team_b_win' END AS predicted,
         GREATEST(p_team_a_win, p_draw, p_team_b_win) AS confidence
  FROM f""",
    "f",
)
_TRUE = (
    "CASE target_class WHEN 'team_a_win' THEN p_team_a_win WHEN 'draw' THEN p_draw "
    "ELSE p_team_b_win END"
)
_SQUARES = " + ".join(
    f"POW({p} - (target_class = '{c}')::INT, 2)" for c, p in zip(CLASSES, PROBABILITIES)
)
_PICK = (
    "CASE WHEN p_team_a_win >= p_draw AND p_team_a_win >= p_team_b_win THEN 'team_a_win' "
    "WHEN p_draw >= p_team_b_win THEN 'draw' ELSE 'team_b_win' END"
)
_SCORES = (
    f"AVG(-LN(LEAST(GREATEST({_TRUE}, 1e-15), 1.0))) AS log_loss, AVG({_SQUARES}) AS brier, "
    f"AVG(({_PICK} = target_class)::INT) AS accuracy, COUNT(*) AS n"
)
_SCORES_OUT = "ROUND(log_loss, 6) AS log_loss, ROUND(brier, 6) AS brier, ROUND(accuracy, 6) AS accuracy, n"


def bin_sql(p: str, n_bins: int = 10) -> str:
    """Bin index of a probability, null for 0."""
    above = " + ".join(f"({p} > {e!r}::DOUBLE)::INT" for e in [k * (1.0 / n_bins) for k in range(n_bins)])
    return f"CASE WHEN ({above}) > 0 THEN ({above}) - 1 END"


part(
    "prior",
    "SELECT "
    + ", ".join(
        f"(COUNT(*) FILTER (target_class = '{c}') + 1.0::DOUBLE) / (COUNT(*) + 3.0::DOUBLE) AS {p}"
        for c, p in zip(CLASSES, PROBABILITIES)
    )
    + " FROM d",
    "d",
)
part(
    "board",
    f"""
  SELECT model, {_SCORES} FROM (
    SELECT 'strength' AS model, target_class, {", ".join(PROBABILITIES)} FROM f
    UNION ALL SELECT 'uniform_random', target_class, 1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE,
                     1 / 3.0::DOUBLE FROM f
    UNION ALL SELECT 'class_frequency', target_class, prior.* FROM f, prior) GROUP BY model""",
    "f",
    "prior",
)

# --- walk-forward -------------------------------------------------------------------------

part(
    "wm",
    "SELECT *, row_number() OVER (PARTITION BY tournament ORDER BY date, match_id) AS k FROM d",
    "d",
)
part(
    "r",
    """r(tournament, team, elo, k, mid) USING KEY (tournament, team, mid) AS (
  SELECT DISTINCT tournament, team, 1500.0::DOUBLE, 0::BIGINT, -1::BIGINT
  FROM (SELECT tournament, team_a AS team FROM wm UNION SELECT tournament, team_b FROM wm)
  UNION
  SELECT tournament, team, unnest([elo_new, elo_old]), k, unnest([-1::BIGINT, match_id])
  FROM (
    SELECT wm.tournament, wm.match_id, unnest([wm.team_a, wm.team_b]) AS team, wm.k,
           unnest([a.elo, b.elo]) AS elo_old,
           unnest([a.elo + 32 * (z.s - z.e), b.elo + 32 * ((1 - z.s) - (1 - z.e))]) AS elo_new
    FROM (SELECT tournament, max(k) + 1 AS nk FROM r GROUP BY 1) n
    JOIN wm ON wm.tournament = n.tournament AND wm.k = n.nk
    JOIN recurring.r a ON a.tournament = wm.tournament AND a.team = wm.team_a AND a.mid = -1
    JOIN recurring.r b ON b.tournament = wm.tournament AND b.team = wm.team_b AND b.mid = -1,
    LATERAL (SELECT
      1 / (1 + pow(10, (b.elo - a.elo - CASE WHEN wm.is_neutral THEN 0 ELSE 65 END) / 400.0)) AS e,
      CASE WHEN wm.team_a_score > wm.team_b_score THEN 1.0
           WHEN wm.team_a_score < wm.team_b_score THEN 0.0 ELSE 0.5 END AS s) z))""",
    "wm",
)
part(
    "pre",
    """
  SELECT wm.*, a.elo AS team_a_elo, b.elo AS team_b_elo, a.elo - b.elo AS elo_diff
  FROM wm JOIN r a ON a.mid = wm.match_id AND a.team = wm.team_a
          JOIN r b ON b.mid = wm.match_id AND b.team = wm.team_b""",
    "wm",
    "r",
)
part("cur", "SELECT tournament, team, elo FROM r WHERE mid = -1", "r")
part(
    "entering",
    f"""
  SELECT tournament, team, arg_min(elo, (date, match_id, side)) AS elo FROM (
    SELECT tournament, date, match_id, 'a' AS side, team_a AS team, team_a_elo AS elo FROM pre
    UNION ALL SELECT tournament, date, match_id, 'b', team_b, team_b_elo FROM pre)
  WHERE date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}' GROUP BY 1, 2""",
    "pre",
)
part(
    "fav",
    """
  SELECT *, row_number() OVER (PARTITION BY tournament ORDER BY elo DESC, team) AS rank
  FROM entering""",
    "entering",
)

# --- standings ----------------------------------------------------------------------------

_RECORD = (
    "COUNT(*) AS played, COUNT(*) FILTER (goals_for > goals_against) AS won, "
    "COUNT(*) FILTER (goals_for = goals_against) AS drawn, "
    "COUNT(*) FILTER (goals_for < goals_against) AS lost, "
    "SUM(goals_for)::BIGINT AS goals_for, SUM(goals_against)::BIGINT AS goals_against"
)
_DERIVED = "goals_for - goals_against AS goal_difference, 3 * won + drawn AS points"
_BEST = "points DESC, goal_difference DESC, goals_for DESC"
_RECORD_COLUMNS = ("played", "won", "drawn", "lost", "goals_for", "goals_against")
part(
    "table_all",
    f"SELECT *, {_DERIVED} FROM (SELECT tournament, team, {_RECORD} FROM long GROUP BY 1, 2)",
    "long",
)
part(
    "members",
    """
  SELECT DISTINCT tournament, chr((65 + s_nationkey % 12)::INT) AS "group", team
  FROM (SELECT tournament, team_a AS team FROM c UNION SELECT tournament, team_b FROM c)
  JOIN supplier ON s_suppkey = team""",
    "c",
)
part(
    "table_groups",
    f"""
  SELECT *, {_DERIVED} FROM (
    SELECT tournament, "group", team,
           {", ".join(f"COALESCE({c}, 0) AS {c}" for c in _RECORD_COLUMNS)}
    FROM members LEFT JOIN (
      SELECT tournament, team, {_RECORD} FROM long GROUP BY 1, 2)
    USING (tournament, team))""",
    "members",
    "long",
)
part(
    "ranked",
    f"""
  SELECT *, row_number() OVER (PARTITION BY tournament, "group" ORDER BY {_BEST}, team) AS rank
  FROM table_groups""",
    "table_groups",
)
part(
    "thirds",
    f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tournament ORDER BY {_BEST}, team)
                           AS third_rank FROM ranked WHERE rank = 3) WHERE third_rank <= 8""",
    "ranked",
)
part(
    "seeded",
    """
  SELECT tournament, team,
         row_number() OVER (PARTITION BY tournament ORDER BY tier, place, n) - 1 AS seed
  FROM (SELECT tournament, team, rank AS tier, "group" AS place, 0 AS n FROM ranked WHERE rank <= 2
        UNION ALL SELECT tournament, team, 3, '', third_rank FROM thirds)""",
    "ranked",
    "thirds",
)
_SLOT = "2 * LEAST(seed, 31 - seed) + (seed > LEAST(seed, 31 - seed))::INT"
part("slots", f"SELECT *, {_SLOT} AS slot FROM seeded WHERE seed BETWEEN 0 AND 31", "seeded")
part(
    "tokens",
    """
  SELECT tournament, rank::VARCHAR || "group" AS token, team FROM ranked WHERE rank <= 2
  UNION ALL SELECT tournament, '3-' || third_rank::VARCHAR, team FROM thirds""",
    "ranked",
    "thirds",
)
part(
    "pairings",
    """
  SELECT tournament, n + 1 AS match, '1' || "group" AS home,
         CASE WHEN n < 8 THEN '3-' || (n + 1)::VARCHAR WHEN n = 11 THEN '9Z'
              ELSE '2' || chr(n + 66) END AS away
  FROM (SELECT DISTINCT tournament, "group", ascii("group") - 65 AS n FROM members)""",
    "members",
)
part("strengths", "SELECT s_suppkey AS team, s_acctbal / 50.0 AS strength FROM supplier")


def uniform_sql(*keys: str) -> str:
    """The keyed uniform number; keys are SQL text expressions."""
    text = " || '|' || ".join([f"'{SEED}'", *keys])
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def drawn_sql(u: str) -> str:
    total = "(p_team_a_win + p_draw + p_team_b_win)"
    return (
        f"CASE WHEN {u} < p_team_a_win / {total} THEN 'team_a_win' "
        f"WHEN {u} < (p_team_a_win + p_draw) / {total} THEN 'draw' ELSE 'team_b_win' END"
    )


def round_sql(slots: str, keys: str, round_no: int) -> str:
    """Winners of the pairs of one round."""
    listed = [k.strip() for k in keys.split(",")]
    u = uniform_sql(f"'{round_no}'", *[f"{k}::VARCHAR" for k in listed], "slot::VARCHAR")
    p = "CASE WHEN pa + pb <= 0 THEN 0.5 ELSE pa / (pa + pb) END"
    return f"""
  SELECT {keys}, slot, CASE WHEN team_a IS NULL OR team_b IS NULL THEN COALESCE(team_a, team_b)
    WHEN {u} < ({p}) THEN team_a ELSE team_b END AS team
  FROM (SELECT q.*, p_team_a_win AS pa, p_team_b_win AS pb FROM (
    SELECT p.*, {strength_sql("x.strength", "y.strength")}
    FROM (SELECT {keys}, slot // 2 AS slot, MAX(team) FILTER (slot % 2 = 0) AS team_a,
                 MAX(team) FILTER (slot % 2 = 1) AS team_b FROM {slots} GROUP BY {keys}, slot // 2) p
    LEFT JOIN strengths x ON x.team = team_a LEFT JOIN strengths y ON y.team = team_b) q)"""


# --- advancement --------------------------------------------------------------------------

part(
    "drawn",
    f"""
  SELECT tournament, replicate, team_a, team_b, {drawn_sql("u")} AS outcome
  FROM (SELECT f.*, replicate,
               {uniform_sql("replicate::VARCHAR", "match_id::VARCHAR")} AS u
        FROM f, (SELECT unnest(range({REPLICATES})) AS replicate))""",
    "f",
)
_LOT = uniform_sql("tournament", "replicate::VARCHAR", '"group"', "team::VARCHAR")
_LOT3 = uniform_sql("tournament", "replicate::VARCHAR", "team::VARCHAR")
part(
    "a_ranked",
    f"""
  SELECT *, row_number() OVER (PARTITION BY tournament, replicate, "group"
           ORDER BY points DESC, lot, team) AS rank
  FROM (SELECT *, {_LOT} AS lot FROM (
    SELECT tournament, replicate, team, SUM(pts) AS points FROM (
      SELECT tournament, replicate, team_a AS team,
             CASE outcome WHEN 'team_a_win' THEN 3 WHEN 'draw' THEN 1 ELSE 0 END AS pts FROM drawn
      UNION ALL SELECT tournament, replicate, team_b,
             CASE outcome WHEN 'team_b_win' THEN 3 WHEN 'draw' THEN 1 ELSE 0 END FROM drawn)
    GROUP BY 1, 2, 3) JOIN members USING (tournament, team))""",
    "drawn",
    "members",
)
part(
    "a_thirds",
    f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tournament, replicate
      ORDER BY points DESC, {_LOT3}, team) AS third_rank FROM a_ranked WHERE rank = 3)
  WHERE third_rank <= 8""",
    "a_ranked",
)
part(
    "s0",
    f"""
  SELECT tournament, replicate, team, {_SLOT} AS slot FROM (
    SELECT tournament, replicate, team, row_number() OVER (PARTITION BY tournament, replicate
             ORDER BY tier, place, n) - 1 AS seed
    FROM (SELECT tournament, replicate, team, rank AS tier, "group" AS place, 0 AS n
          FROM a_ranked WHERE rank <= 2
          UNION ALL SELECT tournament, replicate, team, 3, '', third_rank FROM a_thirds))
  WHERE seed BETWEEN 0 AND 31""",
    "a_ranked",
    "a_thirds",
)
_KNOCKOUT = [s for s in STAGES if s != "win_group"]
for _i in range(5):
    part(f"s{_i + 1}", round_sql(f"s{_i}", "tournament, replicate", _i), f"s{_i}", "strengths")
part(
    "outcomes",
    "SELECT tournament, replicate, team, 'win_group' AS stage FROM a_ranked WHERE rank = 1\n"
    + "\n".join(
        f"UNION ALL SELECT tournament, replicate, team, '{stage}' FROM s{i}"
        for i, stage in enumerate(_KNOCKOUT)
    ),
    "a_ranked",
    *[f"s{i}" for i in range(6)],
)
part(
    "shares",
    "SELECT tournament, team, "
    + ", ".join(
        f"COUNT(*) FILTER (stage = '{s}') / {REPLICATES}.0::DOUBLE AS {out}"
        for s, out in STAGES.items()
    )
    + " FROM members LEFT JOIN outcomes USING (tournament, team) GROUP BY 1, 2",
    "members",
    "outcomes",
)

part(
    "placed",
    """
  SELECT *, row_number() OVER (PARTITION BY tournament
           ORDER BY win_title_probability DESC, team) AS place
  FROM shares""",
    "shares",
)

# --- names --------------------------------------------------------------------------------


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def alias_sql(aliases: dict[str, str]) -> str:
    """Key and canonical name; of several rows for one key an alias goes before a canonical name."""
    rows = [(alias, canonical, 0) for alias, canonical in aliases.items()]
    rows += [(canonical, canonical, 1) for canonical in aliases.values()]
    values = ", ".join(f"({_text(a)}, {_text(c)}, {n}, {i})" for i, (a, c, n) in enumerate(rows))
    key = fold_sql(clean_sql("name"))
    return (
        f"(SELECT {key} AS key, arg_min(canonical, (n, CASE WHEN n = 0 THEN -i ELSE i END)) AS canonical "
        f"FROM (VALUES {values}) AS v(name, canonical, n, i) GROUP BY 1)"
    )


_APOSTROPHES = "translate({x}, '’‘ʼ`', '''''''''')"


def clean_sql(x: str) -> str:
    return f"trim(regexp_replace({_APOSTROPHES.format(x=x)}, '\\s+', ' ', 'g'))"


def fold_sql(x: str) -> str:
    return f"replace(lower(strip_accents({x})), 'ß', 'ss')"


part(
    "words",
    """
  SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS name_a, source AS name_b
  FROM (SELECT doc_id, source, regexp_split_to_array(text, '\\s+') AS w FROM documents)""",
)
part(
    "known",
    """
  SELECT DISTINCT name FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS name
                             FROM benchmark) WHERE name <> ''""",
)
# One byte per letter, because the edit distance here counts bytes.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_BYTES = "".join(chr(i) for i in [*range(1, 9), *range(14, 27)])
_ONE = "translate({x}, '" + _LETTERS + "', '" + _BYTES + "')"

# --- cleaning -----------------------------------------------------------------------------


def _raw_name(side: str) -> str:
    return (
        f"CASE WHEN match_id % 7 = 0 THEN '  Side  ' || {side}::VARCHAR || ' ' "
        f"ELSE 'Side ' || {side}::VARCHAR END"
    )


part(
    "raw",
    f"""
  SELECT DISTINCT date, {_raw_name("team_a")} AS home, {_raw_name("team_b")} AS away,
         CASE WHEN status <> 'P' THEN team_a_score END AS hs,
         CASE WHEN status <> 'P' THEN team_b_score END AS aws,
         CASE WHEN tournament = '5-LOW' THEN 'Friendly ' ELSE tournament END AS tournament,
         'City ' || (match_id % 100)::VARCHAR AS city, is_neutral AS neutral
  FROM c""",
    "c",
)
part(
    "numbered",
    """
  SELECT *, row_number() OVER (ORDER BY date, home, away, hs NULLS LAST, aws NULLS LAST,
                               tournament, city, neutral) - 1 AS match_id FROM raw""",
    "raw",
)

# --- spoiled inputs of the checks ---------------------------------------------------------

part(
    "spoiled",
    """
  SELECT CASE WHEN i % 101 = 0 THEN 0 ELSE i END AS match_id,
         CASE WHEN i % 103 = 0 THEN NULL WHEN i % 107 = 0 THEN DATE '1800-01-01'
              ELSE date END AS date,
         CASE WHEN i % 109 = 0 THEN 'T  ' ELSE 'T ' END || home_team::VARCHAR AS home_team,
         'T ' || (CASE WHEN i % 113 = 0 THEN home_team ELSE away_team END)::VARCHAR AS away_team,
         CASE WHEN i % 127 = 0 THEN -home_score - 1 ELSE home_score END AS home_score,
         CASE WHEN i % 131 <> 0 THEN away_score END AS away_score,
         CASE WHEN i % 137 <> 0 THEN neutral END AS neutral,
         CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A'
              ELSE 'D' END AS result,
         home_score > away_score AS home_win
  FROM (SELECT *, match_id AS i FROM m)""",
    "m",
)
part(
    "spoiled_f",
    """
  SELECT CASE WHEN match_id % 17 <> 0 THEN p_team_a_win END AS p_team_a_win,
         CASE WHEN match_id % 19 = 0 THEN 1.5 ELSE p_draw END AS p_draw,
         CASE WHEN match_id % 23 = 0 THEN -0.25 ELSE p_team_b_win END AS p_team_b_win
  FROM f""",
    "f",
)


def checks_sql(rules: dict[str, str], source: str, nonzero: bool = False, key: str = "check") -> str:
    rows = "\nUNION ALL ".join(
        f"SELECT '{name}' AS {key}, COALESCE(({count}), 0)::BIGINT AS n FROM {source}"
        for name, count in rules.items()
    )
    return f"SELECT * FROM ({rows}) WHERE n > 0" if nonzero else rows


_MATCH_NULLS = ("match_id", "date", "home_team", "away_team", "home_score", "away_score",
                "neutral", "result")
_LABEL = (
    "CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' "
    "WHEN home_score = away_score THEN 'D' END"
)
_MATCH_RULES = {
    **{f"null_{c}": f"COUNT(*) FILTER ({c} IS NULL)" for c in _MATCH_NULLS},
    "date_out_of_range": "COUNT(*) FILTER (date < DATE '1872-01-01' OR date > DATE '2000-01-01')",
    "duplicate_match_id": "COUNT(match_id) - COUNT(DISTINCT match_id)",
    "home_score_not_integral": "COUNT(*) FILTER (home_score % 1 <> 0)",
    "home_score_negative": "COUNT(*) FILTER (home_score < 0)",
    "away_score_not_integral": "COUNT(*) FILTER (away_score % 1 <> 0)",
    "away_score_negative": "COUNT(*) FILTER (away_score < 0)",
    "same_team": "COUNT(*) FILTER (home_team = away_team)",
    "result_mismatch": f"COUNT(*) FILTER ({_LABEL} <> result)",
    "home_win_mismatch": "COUNT(*) FILTER ((home_score > away_score) <> home_win)",
}
_FEATURE_RULES = {
    "duplicate_match_id": "COUNT(match_id) - COUNT(DISTINCT match_id)",
    "row_count": "5",
    **{
        f"null_{c}": f"COUNT(*) FILTER ({c} IS NULL)"
        for c in ("match_id", "date", "team_a", "team_b", *LABEL_COLUMNS)
    },
}


def profile_sql(table: str, columns, dates, names, top: int = 20) -> str:
    none = "NULL::DOUBLE AS share, NULL::VARCHAR AS low, NULL::VARCHAR AS high"
    rows = [f"SELECT 'rows' AS section, '*' AS item, COUNT(*) AS n, {none} FROM {table}"]
    for c in columns:
        count = f"COUNT(*) FILTER ({c} IS NULL)"
        rows.append(
            f"SELECT 'nulls', '{c}', {count}, ROUND({count} / COUNT(*)::DOUBLE, 6), NULL, NULL "
            f"FROM {table} HAVING {count} > 0"
        )
    rows.append(
        f"SELECT 'duplicate_rows', '*', (SELECT COUNT(*) FROM {table}) - "
        f"(SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {table})), NULL, NULL, NULL"
    )
    for c in dates:
        rows.append(
            f"SELECT 'dates', '{c}', 0, NULL, MIN({c}::DATE)::VARCHAR, MAX({c}::DATE)::VARCHAR "
            f"FROM {table}"
        )
    union = " UNION ALL ".join(f"SELECT {c}::VARCHAR AS item FROM {table}" for c in names)
    rows.append(
        f"SELECT * FROM (SELECT 'names', item, COUNT(*) AS n, NULL, NULL, NULL FROM ({union}) "
        f"WHERE item IS NOT NULL GROUP BY item ORDER BY n DESC, item LIMIT {top})"
    )
    return "\nUNION ALL ".join(rows)


def _oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    named = (
        f"COALESCE((SELECT canonical FROM {alias_sql(RAW_ALIASES)} WHERE key = "
        + fold_sql(clean_sql("{x}"))
        + "), " + clean_sql("{x}") + ")"
    )
    o["clean_contests"] = sql(
        f"""SELECT match_id, date, {named.format(x="home")} AS home_team,
       {named.format(x="away")} AS away_team, hs::SMALLINT AS home_score,
       aws::SMALLINT AS away_score, neutral, trim(tournament) AS tournament,
       trim(tournament) <> 'Friendly' AS is_competitive,
       CASE WHEN hs > aws THEN 'H' WHEN hs < aws THEN 'A' ELSE 'D' END AS result,
       hs > aws AS home_win, hs = aws AS draw, hs < aws AS away_win,
       (hs + aws)::SMALLINT AS total_goals, (hs - aws)::SMALLINT AS goal_diff,
       city AS venue_city, NULL::VARCHAR AS venue_country
FROM numbered WHERE hs IS NOT NULL AND aws IS NOT NULL""",
        "numbered",
    )
    o["model_dataset_rows"] = sql(
        """SELECT match_id, date, home_team AS team_a, away_team AS team_b,
       home_score AS team_a_score, away_score AS team_b_score,
       CASE WHEN home_score > away_score THEN 'win' WHEN home_score < away_score THEN 'loss'
            ELSE 'draw' END AS team_a_result,
       CASE WHEN home_score > away_score THEN 'team_a_win'
            WHEN home_score < away_score THEN 'team_b_win' ELSE 'draw' END AS target_class,
       neutral AS is_neutral, NOT neutral AS is_team_a_home, tournament,
       venue_country AS host_country FROM m""",
        "m",
    )
    o["stored_match_rows"] = sql(
        "SELECT * REPLACE (home_score::BIGINT AS home_score, away_score::BIGINT AS away_score) FROM m", "m"
    )
    goals = "CASE WHEN status <> 'P' THEN team_{s}_score::VARCHAR END AS {side}_score"
    o["raw_result_rows"] = sql(
        f"""SELECT strftime(date, '%Y-%m-%d') AS date, {_raw_name("team_a")} AS home_team,
       {_raw_name("team_b")} AS away_team, {goals.format(s="a", side="home")},
       {goals.format(s="b", side="away")},
       CASE WHEN tournament = '5-LOW' THEN 'Friendly ' ELSE tournament END AS tournament,
       'City ' || (match_id % 100)::VARCHAR AS city, NULL::VARCHAR AS country,
       CASE WHEN match_id % 2 = 0 THEN upper(is_neutral::VARCHAR) ELSE is_neutral::INT::VARCHAR END
         AS neutral
FROM c, (VALUES (0), (1)) v(copy) WHERE copy = 0 OR match_id % 50 = 0""",
        "c",
    )
    o["ranking_rows"] = sql(
        "SELECT team::VARCHAR AS team, rdate AS rank_date, rank, points FROM releases", "releases"
    )
    o["snapshot_rows"] = sql("SELECT team::VARCHAR AS team, rdate AS date, elo FROM snaps", "snaps")
    o["strength_rows"] = sql("SELECT team::VARCHAR AS team, strength FROM strengths", "strengths")
    side = "CASE {x} WHEN 1 THEN 'Side One' WHEN 2 THEN 'Side Two' ELSE 'Side ' || {x}::VARCHAR END"
    o["feature_matrix_rows"] = sql(
        f"""SELECT d.match_id, d.date, {side.format(x="d.team_a")} AS team_a,
       {side.format(x="d.team_b")} AS team_b, d.team_a_score, d.team_b_score,
       CASE WHEN d.team_a_score > d.team_b_score THEN 'win'
            WHEN d.team_a_score < d.team_b_score THEN 'loss' ELSE 'draw' END AS team_a_result,
       d.target_class, d.is_neutral, d.is_team_a_home, d.tournament, m.venue_country AS host_country,
       x.* EXCLUDE (match_id), r.team_a_elo, r.team_b_elo, r.elo_diff,
       k.* EXCLUDE (match_id)
FROM d JOIN m USING (match_id) JOIN rated_c r USING (match_id)
JOIN (SELECT match_id, {_FORM_OUT} FROM features) x USING (match_id)
JOIN (SELECT match_id, a.rank AS team_a_fifa_rank, b.rank AS team_b_fifa_rank,
             a.points AS team_a_fifa_points, b.points AS team_b_fifa_points,
             a.rank - b.rank AS fifa_rank_diff, a.points - b.points AS fifa_points_diff
      FROM d ASOF LEFT JOIN releases a ON a.team = d.team_a AND a.rdate <= d.date
             ASOF LEFT JOIN releases b ON b.team = d.team_b AND b.rdate <= d.date) k USING (match_id)""",
        "d", "m", "rated_c", "features", "releases",
    )
    o["team_long_rows"] = sql("SELECT * EXCLUDE (tournament) FROM long", "long")
    form_rows = (
        f"SELECT c.* EXCLUDE (status), x.* EXCLUDE (match_id) FROM c JOIN "
        f"(SELECT match_id, {_FORM_OUT} FROM features) x USING (match_id)"
    )
    o["form_features"] = sql(form_rows, "features")
    o["form_features_split"] = sql(form_rows, "features", undated=True)
    o["parsed_text"] = sql(
        """SELECT match_id, CASE WHEN match_id % 11 <> 0 THEN date END AS day,
       CASE WHEN match_id % 13 = 0 THEN true WHEN match_id % 13 = 1 THEN NULL
            ELSE is_neutral END AS flag FROM c""",
        "c",
    )
    o["earliest_sample"] = sql(
        "SELECT match_id, date FROM c ORDER BY date, match_id LIMIT 1000", "c"
    )
    rated_rows = "SELECT match_id, date, team_a, team_b, team_a_elo, team_b_elo, elo_diff FROM rated_c"
    o["asof_rating"] = sql(rated_rows, "rated_c")
    o["asof_rating_split"] = sql(rated_rows, "rated_c", undated=True)
    o["asof_rank_points"] = sql(
        """SELECT match_id, a.rank AS team_a_fifa_rank, b.rank AS team_b_fifa_rank,
       a.points AS team_a_fifa_points, b.points AS team_b_fifa_points,
       a.rank - b.rank AS fifa_rank_diff, a.points - b.points AS fifa_points_diff
FROM d ASOF LEFT JOIN releases a ON a.team = d.team_a AND a.rdate <= d.date
       ASOF LEFT JOIN releases b ON b.team = d.team_b AND b.rdate <= d.date""",
        "d",
        "releases",
    )
    aliases = alias_sql(NAME_ALIASES)
    o["canonical_names"] = sql(
        f"""SELECT doc_id, pos::INT AS pos, COALESCE(x.canonical, {clean_sql("name_a")}) AS name_a,
       COALESCE(y.canonical, {clean_sql("name_b")}) AS name_b
FROM words LEFT JOIN {aliases} x ON x.key = {fold_sql(clean_sql("name_a"))}
           LEFT JOIN {aliases} y ON y.key = {fold_sql(clean_sql("name_b"))}
WHERE name_a <> ''""",
        "words",
    )
    o["unknown_word_names"] = sql(
        f"""SELECT DISTINCT name FROM (
  SELECT COALESCE(canonical, w) AS name FROM (
    SELECT DISTINCT {clean_sql("name_a")} AS w FROM words WHERE name_a <> '')
  LEFT JOIN {aliases} ON key = {fold_sql("w")})
WHERE name NOT IN (SELECT name FROM known)""",
        "words",
        "known",
    )
    similar = (
        f"1.0 - levenshtein({_ONE.format(x='u.name')}, {_ONE.format(x='k.name')})"
        "::DOUBLE / GREATEST(length(u.name), length(k.name))"
    )
    o["nearest_word_names"] = sql(
        f"""SELECT name, nearest, ROUND(similarity, 6) AS similarity FROM (
  SELECT u.name, k.name AS nearest, {similar} AS similarity,
         row_number() OVER (PARTITION BY u.name ORDER BY {similar} DESC, k.name) AS place
  FROM (SELECT DISTINCT {clean_sql("w")} AS name FROM (
          SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM conversations)
        WHERE w <> '') u, known k
  WHERE u.name NOT IN (SELECT name FROM known) AND {similar} >= 0.6)
WHERE place = 1""",
        "known",
    )
    odd = (
        "SELECT 'un_normalized_name' AS check, COUNT(*)::BIGINT AS n FROM ("
        "SELECT DISTINCT home_team AS t FROM spoiled UNION SELECT away_team FROM spoiled) "
        "WHERE t LIKE 'T  %' OR t = 'T 3'"
    )
    o["quality_contests"] = sql(
        checks_sql(_MATCH_RULES, "spoiled") + "\nUNION ALL " + odd, "spoiled"
    )
    nulls = {c: f"COUNT(*) FILTER ({c} IS NULL)" for c in (*_MATCH_NULLS, "home_win")}
    o["null_summary"] = sql(checks_sql(nulls, "spoiled", True, '"column"'), "spoiled")
    o["duplicate_line_keys"] = (
        "SELECT (COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)))::BIGINT AS n_duplicates "
        "FROM lineitem"
    )
    o["leakage_check"] = sql(
        checks_sql(
            {
                "team_a_elo_date": "COUNT(*) FILTER (match_id % 3 = 2)",
                "team_b_elo_date": "0",
                "team_a_fifa_date": "COUNT(*) FILTER (match_id % 5 = 0)",
            },
            "c",
            True,
        ),
        "c",
    )
    ps = list(PROBABILITIES)
    total = " + ".join(f"COALESCE({p}, 0)" for p in ps)
    o["probability_check"] = sql(
        checks_sql(
            {
                "null_probability": f"COUNT(*) FILTER ({' OR '.join(f'{p} IS NULL' for p in ps)})",
                "outside_unit_interval": "COUNT(*) FILTER ("
                + " OR ".join(f"COALESCE({p} < -1e-6 OR {p} > 1 + 1e-6, false)" for p in ps) + ")",
                "row_sum_not_one": f"COUNT(*) FILTER (ABS({total} - 1.0) > 1e-6)",
            },
            "spoiled_f",
        ),
        "spoiled_f",
    )
    o["probability_bounds"] = sql(
        checks_sql(
            {p: f"COUNT(*) FILTER ({p} < -1e-9 OR {p} > 1 + 1e-9)" for p in ps}, "spoiled_f"
        ),
        "spoiled_f",
    )
    spoiled_d = (
        "(SELECT CASE WHEN match_id % 101 = 0 THEN 0 ELSE match_id END AS match_id, date, team_a, "
        "team_b, team_a_score, team_b_score, target_class AS team_a_result, "
        "CASE WHEN match_id % 103 > 0 THEN target_class END AS target_class FROM d)"
    )
    o["feature_check"] = sql(checks_sql(_FEATURE_RULES, spoiled_d), "d")
    for name in ("feature_check",):
        o[name] = o[name].replace(f"COALESCE((5), 0)::BIGINT AS n FROM {spoiled_d}", "5::BIGINT AS n")
    o["table_profile_orders"] = profile_sql(
        "orders",
        ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
         "o_orderpriority"),
        ("o_orderdate",),
        ("o_orderpriority", "o_orderstatus"),
    )
    o["table_profile_customer"] = (
        "WITH cust AS (SELECT * REPLACE (CASE WHEN c_custkey % 10 > 0 THEN c_mktsegment END "
        "AS c_mktsegment) FROM customer)\n"
        + profile_sql(
            "cust",
            ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
            (),
            ("c_mktsegment", "c_nationkey"),
        )
    )
    o["temporal_split_rows"] = sql(
        """SELECT match_id, date, CASE WHEN k <= n - v - t THEN 'train' WHEN k <= n - t THEN 'val'
       ELSE 'test' END AS split
FROM (SELECT match_id, date, row_number() OVER (ORDER BY date, match_id) AS k,
             COUNT(*) OVER () AS n, round_even(COUNT(*) OVER () * 0.15, 0) AS v,
             round_even(COUNT(*) OVER () * 0.15, 0) AS t FROM c)""",
        "c",
    )
    o["logistic_optimality"] = sql(
        """SELECT target_class AS class, input, COUNT(*) AS n, TRUE AS optimal
FROM (SELECT target_class, row_number() OVER (ORDER BY date, match_id) AS k, COUNT(*) OVER () AS n,
             round_even(COUNT(*) OVER () * 0.15, 0) AS held FROM f)
CROSS JOIN (SELECT unnest(['form_5_diff', 'form_10_diff', 'is_team_a_home', 'intercept']) AS input)
WHERE k <= n - 2 * held GROUP BY 1, 2""",
        "f",
    )
    o["grouped_logistic_optimality"] = sql(
        """SELECT tournament, class, input, n, TRUE AS optimal
FROM (SELECT tournament, COUNT(*) AS n FROM c GROUP BY 1)
CROSS JOIN (SELECT unnest(['team_a_win', 'draw', 'team_b_win']) AS class)
CROSS JOIN (SELECT unnest(['form_5_diff', 'is_team_a_home', 'intercept']) AS input)""",
        "c",
    )
    o["isotonic_steps"] = sql(
        """, cells AS (
  SELECT class, floor(p * 100) AS score, COUNT(*) AS n, SUM((target_class = class)::INT) AS hits
  FROM (SELECT target_class, unnest(['team_a_win', 'draw', 'team_b_win']) AS class,
               unnest([p_team_a_win, p_draw, p_team_b_win]) AS p FROM f) GROUP BY 1, 2),
runs AS (SELECT a.class, a.score AS lo, b.score AS hi,
                SUM(m.hits)::DOUBLE / SUM(m.n)::DOUBLE AS mean
         FROM cells a JOIN cells b ON b.class = a.class AND b.score >= a.score
         JOIN cells m ON m.class = a.class AND m.score BETWEEN a.score AND b.score GROUP BY 1, 2, 3),
least AS (SELECT x.class, x.score, r.lo, MIN(r.mean) AS mean FROM cells x
          JOIN runs r ON r.class = x.class AND r.lo <= x.score AND r.hi >= x.score GROUP BY 1, 2, 3)
SELECT x.class, x.score, x.n, ROUND(MAX(l.mean), 6) AS share
FROM cells x JOIN least l ON l.class = x.class AND l.score = x.score GROUP BY 1, 2, 3""",
        "f",
    )
    o["date_cut"] = sql(
        "SELECT ROUND(quantile_cont((date - DATE '1970-01-01')::DOUBLE, 0.85), 6) AS cut FROM c", "c"
    )
    o["window_rows"] = sql(
        f"""SELECT match_id, date FROM c WHERE date BETWEEN DATE '{WINDOW[0]}' AND
       DATE '{WINDOW[1]}' AND tournament = '{URGENT}'""",
        "c",
    )
    o["elo_pre"] = sql(
        f"""SELECT match_id, tournament, {_r("team_a_elo", 4)}, {_r("team_b_elo", 4)},
       {_r("elo_diff", 4)} FROM pre""",
        "pre",
        recursive=True,
    )
    o["elo_current"] = sql(
        f"SELECT tournament, team, {_r('elo', 4)} FROM cur", "cur", recursive=True
    )
    o["elo_leaderboard"] = sql(
        f"""SELECT tournament, team, {_r("elo", 4)}, rank,
       ROUND(100.0 * (1.0 - (rank - 1) / n::DOUBLE), 4) AS percentile
FROM (SELECT *, row_number() OVER (PARTITION BY tournament ORDER BY elo DESC, team) AS rank,
             COUNT(*) OVER (PARTITION BY tournament) AS n FROM cur)""",
        "cur",
        recursive=True,
    )
    o["entering_strength"] = sql(
        f"SELECT team, {_r('elo', 4)} FROM entering WHERE tournament = '{URGENT}'",
        "entering",
        recursive=True,
    )
    o["favourite_order"] = sql(
        f"SELECT tournament, team, {_r('elo', 4)}, rank FROM fav", "fav", recursive=True
    )
    o["favourite_rank"] = sql(
        f"""SELECT tournament, champion, rank AS predicted_rank,
       (SELECT COUNT(*) FROM fav f WHERE f.tournament = b.tournament) AS n_participants,
       {", ".join(f"COALESCE(rank <= {k}, false) AS in_top_{k}" for k in (3, 5, 10))}
FROM (SELECT tournament, CASE WHEN tournament = '5-LOW' THEN -1 ELSE team END AS champion
      FROM (SELECT *, row_number() OVER (PARTITION BY tournament ORDER BY {_BEST}, team) AS place
            FROM table_all) WHERE place = 1) b
LEFT JOIN (SELECT tournament, team AS champion, rank FROM fav) USING (tournament, champion)""",
        "fav",
        "table_all",
        recursive=True,
    )
    o["participant_list"] = sql(
        "SELECT tournament, team_a AS team FROM c UNION SELECT tournament, team_b FROM c", "c"
    )
    o["elo_expectancy"] = sql(
        """SELECT match_id, ROUND(e, 6) AS expected, ROUND(team_a_elo + 32 * (s - e), 6) AS updated
FROM (SELECT *, 1 / (1 + pow(10, (team_b_elo - team_a_elo -
               CASE WHEN is_team_a_home THEN 65 ELSE 0 END) / 400.0)) AS e,
             CASE target_class WHEN 'team_a_win' THEN 1.0 WHEN 'draw' THEN 0.5 ELSE 0.0 END AS s
      FROM rated_c)""",
        "rated_c",
    )
    sa = "CASE WHEN is_neutral THEN x.elo ELSE COALESCE(x.elo, 1500.0) + 65.0 END"
    o["pair_forecast_rows"] = sql(
        f"""SELECT tournament, team_a, team_b, is_neutral, {", ".join(_r(p) for p in ps)} FROM (
  SELECT p.*, {strength_sql(f"({sa})", "y.elo")}
  FROM (SELECT DISTINCT tournament, team_a, team_b, is_neutral FROM c) p
  LEFT JOIN rated x ON x.tournament = p.tournament AND x.team = p.team_a
  LEFT JOIN rated y ON y.tournament = p.tournament AND y.team = p.team_b)""",
        "c",
        "rated",
        recursive=True,
    )
    o["strength_forecast"] = sql(
        f"""SELECT match_id, date, team_a, team_b, target_class, predicted,
       {", ".join(_r(p) for p in ps)} FROM g""",
        "g",
    )
    lifted = [f"GREATEST(CASE WHEN {p} < 0.2 THEN 0.0 ELSE {p} END, 0.01)" for p in ps]
    o["clipped_forecast"] = sql(
        "SELECT match_id, "
        + ", ".join(f"ROUND({x} / ({' + '.join(lifted)}), 6) AS {p}" for x, p in zip(lifted, ps))
        + " FROM f",
        "f",
    )
    o["class_prior_row"] = sql(f"SELECT {', '.join(_r(p) for p in ps)} FROM prior", "prior")
    blend = ", ".join(f"ROUND({p} / 4 + 0.25::DOUBLE, 9) AS {p}" for p in ps)
    o["ensemble_forecast"] = sql(
        f"SELECT match_id, date, team_a, team_b, target_class, {blend} FROM d, prior", "d", "prior"
    )
    o["backtest_summary_row"] = sql(
        f"""SELECT ROUND(AVG(log_loss), 4) AS mean_log_loss, ROUND(AVG(brier), 4) AS mean_brier,
       ROUND(AVG(accuracy), 4) AS mean_accuracy, ROUND(AVG(e), 4) AS mean_calibration_error,
       COUNT(*) AS n_tournaments, ROUND(AVG((tournament < '3')::INT), 4) AS champion_top_5_rate
FROM (SELECT tournament, {_SCORES} FROM f GROUP BY 1)
JOIN (SELECT tournament, SUM(CASE WHEN bin IS NOT NULL THEN n * ABS(acc - conf) ELSE 0 END) / SUM(n) AS e
      FROM (SELECT tournament, {bin_sql("confidence")} AS bin, COUNT(*) AS n,
                   AVG((predicted = target_class)::INT) AS acc, AVG(confidence) AS conf
            FROM g GROUP BY 1, 2) GROUP BY 1) USING (tournament)""",
        "f",
        "g",
    )
    o["unexpected_label_rows"] = sql(
        """SELECT DISTINCT CASE status WHEN 'P' THEN 'pending' END AS target_class
FROM c WHERE status <> 'O'""",
        "c",
    )
    o["score_forecast"] = sql(
        f"SELECT tournament, {_SCORES_OUT} FROM (SELECT tournament, {_SCORES} FROM f GROUP BY 1)",
        "f",
    )
    o["ece"] = sql(
        f"""SELECT tournament, ROUND(SUM(CASE WHEN bin IS NOT NULL THEN n * ABS(acc - conf) ELSE 0
       END) / SUM(n), 6) AS calibration_error
FROM (SELECT tournament, {bin_sql("confidence")} AS bin, COUNT(*) AS n,
             AVG((predicted = target_class)::INT) AS acc, AVG(confidence) AS conf
      FROM g GROUP BY 1, 2) GROUP BY 1""",
        "g",
    )
    per_class = " UNION ALL ".join(
        f"SELECT '{c}' AS class, {p} AS p, (target_class = '{c}')::INT AS hit FROM f"
        for c, p in zip(CLASSES, ps)
    )
    o["reliability_curve"] = sql(
        f"""SELECT class, bin, ROUND(AVG(p), 6) AS mean_predicted,
       ROUND(AVG(hit), 6) AS observed_frequency, COUNT(*) AS count
FROM (SELECT *, {bin_sql("p")} AS bin FROM ({per_class})) WHERE bin IS NOT NULL GROUP BY 1, 2""",
        "f",
    )
    o["confusion_matrix"] = sql(
        "SELECT actual, "
        + ", ".join(f"COUNT(*) FILTER (predicted = '{c}') AS {c}" for c in CLASSES)
        + " FROM (VALUES ('team_a_win'), ('draw'), ('team_b_win')) v(actual)"
        " LEFT JOIN g ON target_class = actual GROUP BY 1",
        "g",
    )
    o["class_performance"] = sql(
        """SELECT class, CASE WHEN said = 0 THEN 0 ELSE ROUND(tp / said::DOUBLE, 6) END AS precision,
       CASE WHEN support = 0 THEN 0 ELSE ROUND(tp / support::DOUBLE, 6) END AS recall,
       CASE WHEN said + support = 0 THEN 0 ELSE ROUND(2 * tp / (said + support)::DOUBLE, 6) END
         AS f1, support
FROM (SELECT class, COUNT(*) FILTER (predicted = class AND target_class = class) AS tp,
             COUNT(*) FILTER (predicted = class) AS said,
             COUNT(*) FILTER (target_class = class) AS support
      FROM g, (VALUES ('team_a_win'), ('draw'), ('team_b_win')) v(class) GROUP BY 1)""",
        "g",
    )
    o["model_leaderboard"] = sql(f"SELECT model, {_SCORES_OUT} FROM board", "board")
    o["baseline_comparison"] = sql(
        """SELECT ROUND(a, 6) AS main_log_loss, ROUND(b, 6) AS best_baseline_log_loss, best_baseline,
       a < b AS beats_best_baseline
FROM (SELECT MAX(log_loss) FILTER (model = 'strength') AS a,
             MIN(log_loss) FILTER (model <> 'strength') AS b,
             arg_min(model, log_loss) FILTER (model <> 'strength') AS best_baseline FROM board)""",
        "board",
    )
    o["standings_rows"] = sql("SELECT * FROM table_all", "table_all")
    o["group_table_rows"] = sql("SELECT * FROM table_groups", "table_groups")
    o["group_rank"] = sql('SELECT tournament, "group", team, points, rank FROM ranked', "ranked")
    o["rank_split"] = sql(
        f"""SELECT tournament, team, points,
       row_number() OVER (PARTITION BY tournament ORDER BY {_BEST}, team) AS rank FROM table_groups""",
        "table_groups",
    )
    lot = uniform_sql("tournament", '"group"', "team::VARCHAR")
    o["group_rank_by_lot"] = sql(
        f"""SELECT tournament, "group", team, row_number() OVER (PARTITION BY tournament, "group"
       ORDER BY {_BEST}, lot, team) AS rank, ROUND(lot, 9) AS lot
FROM (SELECT *, {lot} AS lot FROM table_groups)""",
        "table_groups",
    )
    o["group_top_two"] = sql(
        'SELECT tournament, "group", team, rank FROM ranked WHERE rank <= 2', "ranked"
    )
    o["best_third_teams"] = sql('SELECT tournament, "group", team, third_rank FROM thirds', "thirds")
    o["bracket_seeding"] = sql("SELECT * FROM slots", "slots")
    o["seeding_check"] = sql(
        """SELECT tournament, COUNT(*) AS n_seeds,
       COUNT(DISTINCT CASE WHEN team % 10 = 3 THEN 0 ELSE team END) AS n_teams
FROM seeded GROUP BY 1 HAVING COUNT(*) <> 32 OR n_teams <> 32""",
        "seeded",
    )
    o["slot_resolution"] = sql(
        """SELECT p.*, h.team AS home_team, a.team AS away_team FROM pairings p
LEFT JOIN tokens h ON h.tournament = p.tournament AND h.token = p.home
LEFT JOIN tokens a ON a.tournament = p.tournament AND a.token = p.away""",
        "pairings",
        "tokens",
    )
    o["unknown_slot_tokens"] = sql(
        """SELECT DISTINCT u.tournament, u.token FROM (
  SELECT tournament, home AS token FROM pairings UNION SELECT tournament, away FROM pairings) u
LEFT JOIN tokens t ON t.tournament = u.tournament AND t.token = u.token WHERE t.token IS NULL""",
        "pairings",
        "tokens",
    )
    o["schedule_check"] = sql(_SCHEDULE, "members", "c")
    u = uniform_sql("match_id::VARCHAR")
    o["keyed_draw"] = sql(
        f"SELECT match_id, ROUND(u, 9) AS u, {drawn_sql('u')} AS outcome "
        f"FROM (SELECT *, {u} AS u FROM f)",
        "f",
    )
    v = uniform_sql("'through'", "match_id::VARCHAR")
    o["advance_probability_rows"] = sql(
        f"""SELECT match_id, ROUND(q, 6) AS p_through,
       CASE WHEN {v} < q THEN team_a ELSE team_b END AS winner
FROM (SELECT *, p_team_a_win / (p_team_a_win + p_team_b_win) AS q FROM f)""",
        "f",
    )
    o["next_round"] = sql(round_sql("slots", "tournament", 0), "slots", "strengths")
    o["advancement"] = sql(
        f"SELECT tournament, team, {', '.join(_r(s) for s in STAGES.values())} FROM shares", "shares"
    )
    o["advancement_summary"] = sql(
        """SELECT tournament, COUNT(*) AS n_teams,
       ROUND(SUM(win_title_probability), 6) AS title_probability_total,
       arg_min(team, (-win_title_probability, team)) AS favourite,
       string_agg(team::VARCHAR, ',' ORDER BY place) FILTER (place <= 10) AS contenders
FROM placed GROUP BY 1""",
        "placed",
    )
    o["title_contenders"] = sql(
        """SELECT tournament, place, team, ROUND(win_title_probability, 6) AS win_title_probability
FROM placed WHERE place <= 10""",
        "placed",
    )
    return o


part(
    "rated",
    "SELECT * REPLACE (CASE WHEN team % 7 = 0 THEN -team ELSE team END AS team) FROM cur",
    "cur",
)

_SCHEDULE = f"""
, g0 AS (SELECT tournament, unnest(CASE WHEN team % 8 = 0 THEN ["group", 'A'] ELSE ["group"] END)
                AS "group", CASE WHEN team % 9 = 0 THEN -team ELSE team END AS team FROM members),
fx AS (SELECT x.*, members."group" FROM (
         SELECT tournament, team_a AS home,
                CASE WHEN match_id % 10 = 0 THEN team_a ELSE team_b END AS away
         FROM c) x
       JOIN members ON members.tournament = x.tournament AND members.team = x.home),
pg AS (SELECT tournament, "group", COUNT(*) AS n FROM g0 GROUP BY 1, 2),
pt AS (SELECT tournament, team, COUNT(*) AS n FROM g0 GROUP BY 1, 2),
sd AS (SELECT tournament, "group", home AS team FROM fx
       UNION ALL SELECT tournament, "group", away FROM fx),
va AS (SELECT * FROM sd WHERE (tournament, team) IN (SELECT (tournament, team) FROM pt))
SELECT tournament, 'group_count' AS check, '*' AS subject, COUNT(*) AS n FROM pg
  GROUP BY 1 HAVING COUNT(*) <> 12
UNION ALL SELECT tournament, 'group_size', "group", n FROM pg WHERE n <> 4
UNION ALL SELECT tournament, 'duplicate_team', team::VARCHAR, n FROM pt WHERE n > 1
UNION ALL SELECT tournament, 'team_total', '*', COUNT(*) FROM pt GROUP BY 1 HAVING COUNT(*) <> 48
UNION ALL SELECT tournament, 'qualifier_total', '*', COUNT(*) * 2 + 8 FROM pg GROUP BY 1
  HAVING COUNT(*) * 2 + 8 <> 32
UNION ALL SELECT tournament, 'unknown_team', team::VARCHAR, COUNT(*) FROM sd
  WHERE (tournament, team) NOT IN (SELECT (tournament, team) FROM pt) GROUP BY 1, 3
UNION ALL SELECT tournament, 'identical_sides', home::VARCHAR, COUNT(*) FROM fx
  WHERE home = away GROUP BY 1, 3
UNION ALL SELECT tournament, 'outside_stated_group', team::VARCHAR, COUNT(*) FROM va
  WHERE (tournament, "group", team) NOT IN (SELECT (tournament, "group", team) FROM g0) GROUP BY 1, 3
UNION ALL SELECT tournament, 'fixture_count', team::VARCHAR, COUNT(*) FROM va GROUP BY 1, 3
  HAVING COUNT(*) <> 3"""

ORACLES = _oracles()
