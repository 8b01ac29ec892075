"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Two lines within TAU edits: cut the shorter one into TAU + 1 segments, and one of them occurs
unchanged in the longer line, near its own place. Lines are indexed by (length, segment
number, segment) and probed with the few substrings that the lengths allow; candidates are
verified by a banded bit-parallel edit distance. Lines are compared as bytes.

A line goes for one witness. So every line is first held to the earliest one under each of its
keys, which settles a group of near copies at a cost of its size; only lines still without a
witness meet all earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.llm.common import DOCUMENT, carried, document_key, texts_of
from contestry.session import cut_lineage

TAU = 2
#: Shorter lines are compared for equality alone: two edits are over a fifth of them.
LEAST_BYTES = 10
#: Hot lines whose places may be broadcast, about 50 bytes each.
MOST_BROADCAST = 200_000
BLANKS = " \t\r"
BLOCK = 32
#: Frequent letters whose counts lines are told apart by before their bytes are compared.
LETTERS = "etaonihrsdlu"
LINE = ["_id", "_low"]
DIGEST = ["_h1", "_h2"]


def _segment(length: Column, number: Column, tau: int) -> tuple[Column, Column]:
    """Start (from 1) and size of a segment: even parts, the later ones longer by one."""
    size = F.floor(length / (tau + 1)).cast("int")
    short = F.lit(tau + 1) - (length - size * (tau + 1))  # segments without the extra byte
    start = size * number + F.greatest(number - short, F.lit(0)) + 1
    return start.cast("int"), (size + (number >= short).cast("int")).cast("int")


def letter_counts(line: Column) -> Column:
    """How often each of LETTERS occurs, modulo 32, in five bits each."""
    text, total = line.cast("string"), F.lit(0).cast("long")
    for k, letter in enumerate(LETTERS):
        count = F.length(line) - F.octet_length(F.replace(text, F.lit(letter), F.lit("")))
        total = total.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(31)).cast("long"), 5 * k))
    return total


def counts_apart(a: Column, b: Column) -> Column:
    """A lower bound on twice the edits between two lines, from their letter counts.

    An edit takes one byte away, adds one, or does both, so the counts of all letters together
    move by two at most.
    """
    total = F.lit(0)
    for k in range(len(LETTERS)):
        apart = (F.shiftright(a, 5 * k).bitwiseAND(F.lit(31)) - F.shiftright(b, 5 * k).bitwiseAND(F.lit(31)) + 32) % 32
        total = total + F.least(apart, F.lit(32) - apart)
    return total


def line_keys(lines: DataFrame, tau: int = TAU, least: int = LEAST_BYTES) -> DataFrame:
    """``_key`` rows of lines (``_line``, ``_id``, ``_low``): hashes of (length, number, segment), ``_mark``.

    First the segments of the line itself, its keys in the index; then the other substrings that
    can be a segment of a line shorter by 0 to ``tau``. Segment i of the shorter line lies at most
    i places off its start counted from the left, and at most ``tau`` - i places off counted from
    the right. ``_mark`` is ``_low``, 32 bits that tell the lines of one document apart, and behind
    it a bit that is set for keys of the index.
    """
    places = [
        (less, i, shift)
        for less in range(tau + 1)
        for i in range(tau + 1)
        for shift in range(max(-i, less - (tau - i)), min(i, less + tau - i) + 1)
    ]
    rows = [F.struct(*(F.lit(v).alias(c) for c, v in zip(("_less", "_i", "_shift"), p, strict=True))) for p in places]
    each = lines.select("*", F.inline(F.array(*rows))).withColumn("_size", F.length("_line") - F.col("_less"))
    start, size = _segment(F.col("_size"), F.col("_i"), tau)
    at = start + F.col("_shift")
    inside = (F.col("_size") >= least) & (at >= 1) & (at + size - 1 <= F.length("_line"))
    own = ((F.col("_less") == 0) & (F.col("_shift") == 0)).cast("long")
    key = F.xxhash64("_size", "_i", F.substring("_line", at, size))
    return each.where(inside).select(key.alias("_key"), "_id", F.shiftleft("_low", 1).bitwiseOR(own).alias("_mark"))


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows of keys that several lines have: ``LINE``, ``_key``, ``_own`` and ``_first``, the
    first line before it that it can be compared with, by (``_id``, ``_mark``)."""
    order = Window.partitionBy("_key").orderBy("_id", "_mark")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("_mark").bitwiseAND(F.lit(1)) == 1
    line = F.struct("_id", "_mark")
    ranked = keys.select(
        "*",
        F.first(line).over(before).alias("_any"),
        F.first(F.when(own, line), ignorenulls=True).over(before).alias("_indexed"),
        F.lead("_id").over(order).alias("_next"),
    )
    first = F.when(own, F.col("_any")).otherwise(F.col("_indexed"))
    low = F.shiftright("_mark", 1).alias("_low")
    witness = F.when(first.isNotNull(), F.struct(first["_id"].alias("_id"), F.shiftright(first["_mark"], 1).alias("_low")))
    return ranked.where("_any IS NOT NULL OR _next IS NOT NULL").select("_id", low, "_key", own.alias("_own"), witness.alias("_first"))


def _same_blocks(a: Column, b: Column, blocks: Column) -> Column:
    """How many whole blocks at the start of two binaries are equal."""
    return F.aggregate(
        F.when(blocks > 0, F.sequence(F.lit(1), blocks)).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda m, k: F.when(
            (m == k - 1)
            & (F.substring(a, (k - 1) * BLOCK + 1, F.lit(BLOCK)) == F.substring(b, (k - 1) * BLOCK + 1, F.lit(BLOCK))),
            k,
        ).otherwise(m),
    )


def _same_tail(a: Column, b: Column, blocks: Column) -> Column:
    """How many whole blocks at the end of two binaries are equal."""
    return F.aggregate(
        F.when(blocks > 0, F.sequence(F.lit(1), blocks)).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda m, k: F.when(
            (m == k - 1)
            & (
                F.substring(a, F.length(a) - k * BLOCK + 1, F.lit(BLOCK))
                == F.substring(b, F.length(b) - k * BLOCK + 1, F.lit(BLOCK))
            ),
            k,
        ).otherwise(m),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and wherever it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def banded_distance(a: Column, b: Column, tau: int = TAU) -> Column:
    """The edit distance of two binaries, or some number above ``tau`` if it is larger.

    Equal blocks at both ends are cut off first, which changes no distance. Then a band of
    2 * tau + 1 cells around the diagonal moves down the longer text, one byte of the shorter
    at a time; its vertical differences are two bit sets. The distance is followed along the
    diagonal on which the last cell lies; a pair beyond ``tau`` is not followed to its end.
    """
    width = 2 * tau + 1
    mask = F.lit((1 << width) - 1).cast("long")

    def pair(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    def without_head(p: Column) -> Column:
        blocks = _same_blocks(p["x"], p["y"], (F.length(p["y"]) / BLOCK).cast("int"))
        return let(
            F.struct(p.alias("p"), (blocks * BLOCK + 1).alias("at")),
            lambda q: pair(*(F.substring(q["p"][c], q["at"], F.length(q["p"][c])) for c in "xy")),
        )

    def without_tail(p: Column) -> Column:
        blocks = _same_tail(p["x"], p["y"], (F.length(p["y"]) / BLOCK).cast("int"))
        return let(
            F.struct(p.alias("p"), (blocks * BLOCK).alias("cut")),
            lambda q: pair(*(F.substring(q["p"][c], F.lit(1), F.length(q["p"][c]) - q["cut"]) for c in "xy")),
        )

    def column(p: Column, state: Column, j: Column) -> Column:
        """Differences in the band before byte ``j`` of the shorter text, and its diagonal ones."""
        byte = F.substring(p["y"], j, F.lit(1))
        same = F.lit(0).cast("long")
        for k in range(width):
            row = j - tau + k
            hit = (row >= 1) & (F.substring(p["x"], row, F.lit(1)) == byte)
            same = same.bitwiseOR(F.when(hit, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        return let(
            same,
            lambda eq: F.struct(
                state["vp"].alias("vp"),
                state["vn"].alias("vn"),
                (eq.bitwiseAND(state["vp"]) + state["vp"])
                .bitwiseXOR(state["vp"])
                .bitwiseOR(eq)
                .bitwiseOR(state["vn"])
                .bitwiseAND(mask)
                .alias("d0"),
            ),
        )

    def moved(c: Column, edits: Column) -> Column:
        """The band one place further down."""
        across = c["vn"].bitwiseOR(F.bitwise_not(c["d0"].bitwiseOR(c["vp"])).bitwiseAND(mask))
        down = F.shiftright(c["d0"], 1)
        return let(
            across,
            lambda hp: F.struct(
                c["d0"].bitwiseAND(c["vp"]).bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(mask)).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                edits.alias("edits"),
            ),
        )

    def walked(p: Column) -> Column:
        more = F.length(p["x"]) - F.length(p["y"])
        start = F.struct(
            F.lit(((1 << width) - 1) & ~((1 << tau) - 1)).cast("long").alias("vp"),
            F.lit(0).cast("long").alias("vn"),
            more.cast("int").alias("edits"),
        )

        def follow(state: Column, j: Column) -> Column:
            step = lambda c: F.when(F.getbit(c["d0"], more + tau) == 1, 0).otherwise(1)
            return let(column(p, state, j), lambda c: moved(c, state["edits"] + step(c)))

        places = F.when(F.length(p["y"]) > 0, F.sequence(F.lit(1), F.length(p["y"]))).otherwise(
            F.array().cast("array<int>")
        )
        end = F.aggregate(places, start, lambda s, j: F.when(s["edits"] > tau, s).otherwise(follow(s, j)))
        return F.when(more > tau, F.lit(tau + 1)).otherwise(end["edits"])

    longer_first = F.when(F.length(a) >= F.length(b), pair(a, b)).otherwise(pair(b, a))
    return let(longer_first, lambda p: let(without_head(p), lambda q: let(without_tail(q), walked)))


def _documents(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str]) -> DataFrame:
    """Texts keyed by ``DOCUMENT``."""
    texts = texts_of(docs, id_col, text_col, carry)
    return texts.select(*document_key(F.col("_id"), F.col("_text")), "_text", *(["_carried"] if carry else []))


def _bytes(raw: Column) -> Column:
    """The bytes of a line without blanks at its ends; most lines have none to look for."""
    ends = [f(raw, F.lit(b)) for f in (F.startswith, F.endswith) for b in BLANKS]
    return F.when(reduce(Column.__or__, ends), F.btrim(raw, F.lit(BLANKS))).otherwise(raw).cast("binary")


def _lines_at(texts: DataFrame, places: DataFrame, once: bool = False) -> DataFrame:
    """The lines that ``places`` lists per document (``_at``: structs with ``_no`` and ``LINE``):
    ``LINE``, ``_line`` and ``_place``; with ``once`` not again for documents that are there again."""
    joined = texts.join(places, DOCUMENT).select(*DOCUMENT, "_text", "_at")
    if once:
        joined = joined.dropDuplicates(DOCUMENT)
    each = joined.withColumn("_parts", F.split("_text", "\n", -1)).select(*DOCUMENT, "_parts", F.inline("_at"))
    return each.select(*LINE, _bytes(F.get("_parts", "_no")).alias("_line"), F.struct(*DOCUMENT, "_no").alias("_place"))


def _located(first: DataFrame) -> DataFrame:
    """Different lines with ``LINE``, a short name for them: the id of their document, or a
    number from its hash where that is null, and half of their own hash."""
    unnamed = F.lit(1 << 62) + F.shiftrightunsigned(F.col("_place._hash"), 2)
    name = F.when(F.col("_place._null"), unnamed).otherwise(F.col("_place._key"))
    return first.select("*", name.alias("_id"), F.col("_h1").bitwiseAND(F.lit((1 << 32) - 1)).alias("_low"))


def _places(lines: DataFrame) -> DataFrame:
    """Per document the list of its lines: ``_at`` for ``_lines_at``."""
    place = [F.col(f"_place.{c}").alias(c) for c in DOCUMENT]
    return lines.groupBy(*place).agg(F.collect_list(F.struct(F.col("_place._no").alias("_no"), *LINE)).alias("_at"))


def _close(pairs: DataFrame, lines: DataFrame, tau: int) -> DataFrame:
    """The later line of each pair (``_a``, ``_b``: ``LINE``) within ``tau`` edits: ``LINE``, ``DIGEST``."""
    sides = pairs.where("_a <> _b").select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()
    for c in "ab":
        side = F.struct("_place", "_line", "_letters", *LINE).alias(f"_{c}_line")
        side = lines.select(F.struct(*LINE).alias(f"_{c}"), side)
        sides = sides.join(side, f"_{c}")
    early, late = F.least("_a_line", "_b_line"), F.greatest("_a_line", "_b_line")  # structs go by their place first
    met = sides.where(counts_apart(F.col("_a_line._letters"), F.col("_b_line._letters")) <= 2 * tau)
    met = met.select(early.alias("_early"), late.alias("_late")).where("_early._place < _late._place")
    met = met.where(banded_distance(F.col("_early._line"), F.col("_late._line"), tau) <= tau)
    return met.select(*(F.col(f"_late.{c}") for c in LINE), *_digest(F.col("_late._line"))).distinct()


def _digest(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("_h1"), F.xxhash64(line, F.lit(1)).alias("_h2")]


def near_lines(texts: DataFrame, first: DataFrame, tau: int = TAU, least: int = LEAST_BYTES) -> DataFrame:
    """``DIGEST`` of different lines that are within ``tau`` edits of a line with an earlier place.

    ``first`` has the first place of each different line. Every pair within ``tau`` is found or
    one of it has a witness already: keys have no caps. Keys move as three numbers; texts of
    lines are fetched for lines that share a key with another one only.
    """
    named = _located(first.where("_long"))
    every = _lines_at(texts, _places(named), once=True)
    hot = cut_lineage(shared_keys(line_keys(every, tau, least)))
    wanted = cut_lineage(_places(named.join(hot.select(*LINE).distinct(), LINE)))
    few = (wanted.agg(F.sum(F.size("_at"))).first()[0] or 0) <= MOST_BROADCAST
    lines = _lines_at(texts, F.broadcast(wanted) if few else wanted).distinct()
    lines = cut_lineage(lines.withColumn("_letters", letter_counts(F.col("_line"))))
    pairs = hot.where("_first IS NOT NULL").select(F.struct(*LINE).alias("_a"), F.col("_first").alias("_b"))
    told = cut_lineage(_close(pairs, lines, tau))
    # Of documents with one id the order is not known here, so any of their lines may be earlier.
    lettered = hot.join(lines.select(*LINE, "_letters"), LINE).select("_key", "_own", F.struct(*LINE).alias("_a"), "_letters")
    open_ = hot.select("_key", "_own", *LINE).join(told, LINE, "left_anti").select("_key", "_own", *LINE)
    open_ = open_.join(lines.select(*LINE, "_letters"), LINE)
    open_ = open_.select("_key", F.col("_own").alias("_mine"), F.struct(*LINE).alias("_b"), F.col("_letters").alias("_others"))
    met = open_.join(lettered, "_key").where("(_own OR _mine) AND _a._id <= _b._id AND _a <> _b")
    met = met.where(counts_apart(F.col("_letters"), F.col("_others")) <= 2 * tau)
    rest = _close(met.select("_a", "_b"), lines, tau)
    return told.select(*DIGEST).unionByName(rest.select(*DIGEST)).distinct()


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per document: id, ``n_lines``, ``n_removed``, ``text`` without repeated lines,
    and the columns named in ``carry``.

    A line that is not blank goes if an equal line has an earlier place, by id and line number;
    a line of LEAST_BYTES bytes or more also if one within ``tau`` edits (bytes, blanks at the
    ends aside) and of that size has. Null text is empty text; an empty text is one empty line.
    Null ids come last. Rows alike in id and text are one document; different texts with one id
    go by their hash. An empty table gives no rows; other columns are not read.
    """
    texts = _documents(docs, id_col, text_col, carry)
    lines = texts.select(*DOCUMENT, F.posexplode(F.split("_text", "\n", -1)).alias("_no", "_raw"))
    lines = lines.select(F.struct(*DOCUMENT, "_no").alias("_place"), _bytes(F.col("_raw")).alias("_line"))
    lines = lines.where(F.length("_line") > 0)
    lines = lines.select("_place", *_digest(F.col("_line")), (F.length("_line") >= LEAST_BYTES).alias("_long"))
    first = cut_lineage(lines.groupBy(*DIGEST).agg(F.min("_place").alias("_place"), F.max("_long").alias("_long")))
    near = near_lines(texts, first, tau).withColumn("_near", F.lit(True))
    # Written, so that a line in a third of all places is split by the join below.
    known = cut_lineage(first.select(*DIGEST, F.col("_place").alias("_first")).join(near, DIGEST, "left"))
    gone = (
        lines.join(known, DIGEST)
        .where(F.col("_near").isNotNull() | (F.col("_place") > F.col("_first")))
        .groupBy(*(F.col(f"_place.{c}").alias(c) for c in DOCUMENT))
        .agg(F.collect_set("_place._no").alias("_gone"))
    )
    split = F.split("_text", "\n", -1)
    joined = texts.join(gone, DOCUMENT, "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_gone"))
    return joined.select(
        F.when(~F.col("_null"), F.col("_key")).alias(id_col),
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("_gone").isNull(), F.col("_text"))
        .otherwise(let(split, lambda parts: F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")))
        .alias("text"),
        *carried(carry),
    )
