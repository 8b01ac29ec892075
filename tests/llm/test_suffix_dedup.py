"""Repeats against every window of every text, and the suffix array against plain sorting."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from contestry.llm.suffix_dedup import SORTED_BYTES, SuffixArray, _marked, fragments, remove_repeats, repeated_ranges

SCHEMA = "doc_id long, text string, _bytes int, kept string"


def brute(texts, length):
    times = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = len([i for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])])
        out.append((len(t), sum(gone), runs, bytes(x for x, g in zip(t, gone) if not g)))
    return out


def some_texts(seed, n=40):
    draw = random.Random(seed)
    word = lambda k: "".join(draw.choices("abcdéf \n", k=k))
    shared = [word(draw.randrange(20, 120)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [word(draw.randrange(0, 80))]
        for _ in range(draw.randrange(4)):
            parts += [draw.choice(shared)[draw.randrange(12) :], word(draw.randrange(0, 40))]
        out.append("".join(parts))
    return [*out, "xy" * 150, "ab" * 200 + word(30), out[0], out[1], "", "é" * 30]


@pytest.mark.parametrize("most", [20_000, 3])
def test_documents_equal_brute_force(spark, most):
    texts = some_texts(3)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(0, texts[0], None, None), (0, texts[5] + "q", 1, ""), (None, texts[7], 1, ""), (900, None, 1, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = remove_repeats(df, length=24, gram=8, most_fragments=most).collect()
    want = brute([(t or "").encode() for _, t, _, _ in rows], 24)
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(
        (repr(row[0]), *w) for row, w in zip(rows, want)
    )
    assert sum(w[1] for w in want) > 500


def test_production_length_and_very_long_text(spark):
    draw = random.Random(7)
    passage = "".join(draw.choices("abcdefgh ", k=260))
    rows = [(i, "".join(draw.choices("abcdefgh ", k=300)) + passage + str(i)) for i in range(5)]
    rows += [(9, "long " * 300_000)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute([t.encode() for _, t in rows[:5]], 200)
    assert [(got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) for i in range(5)] == [w[1:] for w in want]
    assert (got[9].n_removed, got[9].n_spans) == (1_500_000, 1)
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_windows_lie_in_fragments_of_one_anchor():
    for text in some_texts(5):
        data = text.encode()
        anchor, first, behind = fragments(data, 24, 8)
        covered = [i for f, b in zip(first, behind) for i in range(f, b)]
        assert covered == list(range(max(0, len(data) - 23)))
        of = {}
        for a, f, b in zip(anchor, first, behind):
            for i in range(f, b):
                assert of.setdefault(data[i : i + 24], a) == a


def test_suffix_order_and_common_prefixes():
    strings = [t.encode() for t in some_texts(6, 12) if t]
    array = SuffixArray(strings, 5)
    suffixes = [strings[array.owner[p]][array.within[p] :] for p in array.order]
    starts = sum(max(0, len(s) - 4) for s in strings)
    assert len(suffixes) == starts
    for i in range(1, len(suffixes)):
        a, b = suffixes[i - 1], suffixes[i]
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert array.common[i] == same


def maximal(strings, least):
    """Every repeat that two occurrences cannot all extend to the left or the right."""
    found = {}
    for k, s in enumerate(strings):
        for i in range(len(s)):
            for j in range(i + least, len(s) + 1):
                found.setdefault(s[i:j], []).append((k, i))
    out = set()
    for text, places in found.items():
        if len(places) < 2:
            continue
        before = {strings[k][i - 1] if i else ("start", k) for k, i in places}
        after = {strings[k][i + len(text)] if i + len(text) < len(strings[k]) else ("end", k, i) for k, i in places}
        if len(before) > 1 and len(after) > 1:
            out.add((text, tuple(sorted(places))))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats_have_all_occurrences(seed):
    draw = random.Random(seed)
    strings = ["".join(draw.choices("ab", k=draw.randrange(5, 28))).encode() for _ in range(4)]
    array = SuffixArray(strings, 3)
    got = set()
    for size, first, last in array.maximal_repeats():
        places = [(int(array.owner[p]), int(array.within[p])) for p in array.order[first : last + 1]]
        k, i = places[0]
        got.add((strings[k][i : i + size], tuple(sorted(places))))
    assert got == maximal(strings, 3)


def test_ranges_of_one_string_alone():
    assert repeated_ranges([b"abcabcabc", b"xyz"], 3) == [[(0, 9)], []]
    assert np.array_equal(repeated_ranges([b"abcd", b"bcd"], 3), [[(1, 4)], [(0, 3)]])


def peak_bytes(work):
    """What ``work`` gives, and the most bytes it held at once."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_sorting_holds_few_bytes_a_byte():
    draw = random.Random(8)
    passages = [draw.randbytes(210) for _ in range(600)]
    around = lambda p, edge: draw.randbytes(draw.randrange(70)) + edge + p + edge + draw.randbytes(draw.randrange(70))
    strings = [around(p, edge) for edge in (b"\0", b"\1") for p in passages]
    found, most = peak_bytes(lambda: repeated_ranges(strings, 200))
    where = [s.index(p) for s, p in zip(strings, passages * 2, strict=True)]
    assert found == [[(at, at + 210)] for at in where]
    # Levels, sorted keys and their order; two executor cores sort at once.
    assert most < 75 * sum(map(len, strings))


def test_fragments_that_come_again_are_sorted_once():
    draw = random.Random(9)
    same = draw.randbytes(200)
    parts = [draw.randbytes(49) + bytes([i]) + same + bytes([i]) + draw.randbytes(49) for i in range(200)]
    frame = pd.DataFrame({"_anchor": 1, "_digest": range(len(parts)), "_n": 1, "_part": parts})
    times = 2 * SORTED_BYTES // sum(map(len, parts))
    got, most = peak_bytes(lambda: pd.concat(_marked(200)(iter([frame] * times))))
    assert sorted(got["_digest"]) == list(range(len(parts)))
    assert all(s == [50] and e == [250] for s, e in zip(got["_starts"], got["_ends"]))
    assert most < 5 * SORTED_BYTES
