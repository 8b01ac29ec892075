"""Edit distance and line removal against plain dynamic programming."""

import random

import pytest
import xxhash

from pyspark.sql import functions as F

from contestry.llm.line_dedup import (
    LEAST_BYTES, banded_distance, counts_apart, dedup_lines, letter_counts, line_keys, shared_keys,
)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(draw, text, n):
    text = list(text)
    for _ in range(n):
        at, kind = draw.randrange(len(text) + 1), draw.randrange(3)
        if kind == 0:
            text.insert(at, draw.choice("abcé"))
        elif text:
            at = min(at, len(text) - 1)
            if kind == 1:
                del text[at]
            else:
                text[at] = draw.choice("abcé")
    return "".join(text)


def some_pairs(n=250, seed=1):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        a = "".join(draw.choices("abc", k=draw.choice([0, 1, 2, 5, 31, 40, 97, 200])))
        out.append((a, edited(draw, a, draw.randrange(6))))
    return out


@pytest.mark.parametrize("tau", [1, 2, 4])
def test_banded_distance(spark, tau):
    pairs = some_pairs()
    df = spark.createDataFrame([(bytearray(a.encode()), bytearray(b.encode())) for a, b in pairs], "a binary, b binary")
    rows = df.select("a", "b", banded_distance(df.a, df.b, tau).alias("_edits")).collect()
    for r in rows:
        d = distance(bytes(r.a), bytes(r.b))
        assert r._edits == d if d <= tau else r._edits > tau


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_no_near_pair_misses_the_index(spark, tau):
    draw = random.Random(9)
    pairs = []
    for _ in range(300):
        a = "".join(draw.choices("ab", k=draw.randrange(24, 60)))
        b = edited(draw, a, draw.randrange(tau + 1))
        pairs.append(sorted([a.encode(), b.encode()], key=len))
    rows = [(i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "_h1 long, a binary, b binary")
    sides = [df.select(F.col("_h1").alias("_id"), F.lit(n).cast("long").alias("_low"), F.col(c).alias("_line")) for n, c in enumerate("ab")]
    keys = line_keys(sides[0].unionByName(sides[1]), tau)
    indexed = keys.where("_mark = 1").select("_id", "_key")  # of the shorter line; _mark is 2 or 3 for the longer one
    met = {r._id for r in indexed.intersect(keys.where("_mark > 1").select("_id", "_key")).collect()}
    apart = df.select("_h1", counts_apart(letter_counts(df.a), letter_counts(df.b)).alias("n")).collect()
    assert all(r.n <= 2 * distance(*pairs[r._h1]) for r in apart)
    assert all(i in met for i, (a, b) in enumerate(pairs) if distance(a, b) <= tau)


def place(row):
    """Documents go by id, null last, and those with one id by the hash of their text."""
    name, text = row
    digest = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return name is None, name or 0, digest - (digest >> 63 << 64)


def brute(rows):
    order = sorted(enumerate(rows), key=lambda r: place(r[1]))
    seen, gone = [], {}
    for at, (_, text) in order:
        lines = (text or "").split("\n")
        gone[at] = set()
        for no, line in enumerate(lines):
            key = line.strip(" \t\r").encode()
            if not key:
                continue
            long = [s for s in seen if min(len(s), len(key)) >= LEAST_BYTES]
            if key in seen or any(abs(len(key) - len(s)) <= 2 and distance(key, s) <= 2 for s in long):
                gone[at].add(no)
            if key not in seen:
                seen.append(key)
    out = []
    for at, (name, text) in enumerate(rows):
        lines = (text or "").split("\n")
        out.append((repr(name), len(lines), len(gone[at]), "\n".join(x for i, x in enumerate(lines) if i not in gone[at])))
    return sorted(out)


def test_documents_equal_brute_force(spark):
    draw = random.Random(4)
    base = ["".join(draw.choices("abcdé ", k=draw.randrange(10, 70))) for _ in range(25)]
    rows = []
    for i in range(40):
        lines = [edited(draw, draw.choice(base), draw.choice([0, 0, 1, 2, 3])) for _ in range(draw.randrange(1, 6))]
        rows.append((i, "\n".join(lines + [""] * draw.randrange(2))))
    rows += [(100 + i, base[0] + "\r\n" + base[1]) for i in range(30)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "z" * 40000), (None, base[2])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, _line int, _key string")
    got = dedup_lines(docs.repartition(4)).collect()
    assert sorted((repr(r.doc_id), r.n_lines, r.n_removed, r.text) for r in got) == brute(rows)


def test_witnesses_of_chains_short_lines_and_shared_ids(spark):
    draw = random.Random(11)
    # Lines one edit apart from the next, later ones far from the first; all share segments.
    chain = [("q" * k + "p" * (14 - k) + "-stem-of-all-lines") for k in range(14)]
    rows = [(50 - i, chain[draw.randrange(14)] + "\n" + draw.choice(["Yes.", "Read more", "", " \t", "x"])) for i in range(40)]
    rows += [(7, f"{'ab'[i % 2]}{i:02d} one id, other texts") for i in range(20)]
    rows += [(None, f"a line {i} of no one") for i in range(8)] + [(None, "Yes.")]
    rows = sorted(set(rows), key=repr)
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = dedup_lines(docs).collect()
    assert sorted((repr(r.doc_id), r.n_lines, r.n_removed, r.text) for r in got) == brute(rows)


def test_first_line_of_a_key_is_held_to_the_index(spark):
    rows = [(9, 1, 1, True), (9, 2, 2, False), (9, 3, 3, False), (9, 4, 4, True), (8, 5, 5, True), (7, 1, 1, False), (7, 2, 2, True)]
    keys = spark.createDataFrame([(k, i, low * 2 + own) for k, i, low, own in rows], "_key long, _id long, _mark long")
    got = {(r._key, r._id): r._first and r._first._id for r in shared_keys(keys).collect()}
    assert got == {(9, 1): None, (9, 2): 1, (9, 3): 1, (9, 4): 1, (7, 1): None, (7, 2): 1}


def test_repeated_rows_and_empty_table(spark):
    line = "a line that is long enough to count"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line + "!")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.text) for r in dedup_lines(docs).collect())
    assert got == [(1, 0, line), (1, 0, line), (2, 1, "")]
    assert dedup_lines(docs.limit(0)).count() == 0
