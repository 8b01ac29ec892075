"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run of period q that ends before word e holds one branching square of that period, at e - 2q:
its two halves are equal and the words behind them differ. The halves are suffixes of one LCP
interval of depth q and of different children of it. So for every interval the suffixes of all
children but the largest are asked whether the suffix one depth on or back is in the interval,
by the inverse suffix array; no tree is built. A square found is rotated to the left as far as
it goes, which gives its run; the squares of one run end alike and are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from contestry.llm.common import texts_of

#: Periods a run holds at least, and words.
EXPONENT, LEAST_WORDS = 4, 6
#: Words of the documents that share a suffix array, about; a longer document has one of its own.
CHUNK_WORDS = 1 << 18

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _heads(keys: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, the first place of an equal key."""
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))


def _shared(heads: np.ndarray) -> np.ndarray:
    """Places whose key occurs more than once."""
    same = heads[1:] == heads[:-1]
    return np.flatnonzero(np.append(same, False) | np.append(False, same))


def suffix_ranks(codes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words; the last ones are all different.

    ``ends`` has the end of the document of each word. Codes of different documents differ, so
    a suffix is compared within its document alone. Only suffixes not told apart yet are
    sorted again. Every array has -1 behind its last rank.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    heads = _heads(codes[order])
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = heads
    levels, open_, step = [rank], order[_shared(heads)], 1
    while len(open_):
        behind = np.minimum(open_ + step, n)
        key = rank[open_] * (n + 1) + np.where(open_ + step < ends[open_], rank[behind] + 1, 0)
        placed = np.argsort(key, kind="stable")
        open_, key = open_[placed], key[placed]
        inner = _heads(key)
        rank = rank.copy()
        rank[open_] += inner - _heads(levels[-1][open_])
        levels.append(rank)
        open_, step = open_[_shared(inner)], 2 * step
    return levels


def common_prefixes(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Words shared by each two suffixes that are neighbours in ``order``."""
    left, right = order[:-1], order[1:]
    lcp, alike, kept = np.zeros(len(left), np.int64), np.arange(len(left)), []
    for rank in levels:
        alike = alike[rank[left[alike]] == rank[right[alike]]]
        kept.append(alike)
    for k in range(len(levels) - 1, -1, -1):
        some = kept[k]
        so_far = lcp[some]
        more = levels[k][left[some] + so_far] == levels[k][right[some] + so_far]
        lcp[some[more]] += 1 << k
    return lcp


def lcp_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All LCP intervals of positive depth with at least ``least`` suffixes, by a stack scan.

    Returns the depths, how many bounds each interval has, and all bounds in a row: where the
    children begin in suffix order and, last, where the interval ends.
    """
    depths, counts, bounds = [], [], []
    inside = np.flatnonzero(lcp > 0)
    # Stretches without a zero; one interval cannot reach from one to another.
    for stretch in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1):
        if len(stretch) + 1 < least:
            continue
        first, stack = int(stretch[0]), []
        for at, depth in enumerate([*lcp[stretch].tolist(), 0], first + 1):
            begin = at - 1
            while stack and stack[-1][0] > depth:
                done, own = stack.pop()
                own.append(at)
                begin = own[0]
                if at - begin >= least:
                    depths.append(done)
                    counts.append(len(own))
                    bounds += own
            if stack and stack[-1][0] == depth:
                stack[-1][1].append(at)
            elif depth:
                stack.append((depth, [begin, at]))
    return np.array(depths, np.int64), np.array(counts, np.int64), np.array(bounds, np.int64)


def branching_squares(levels: list[np.ndarray], exponent: int) -> np.ndarray:
    """(end, period) of each branching square with ``exponent`` equal pieces up to its end, sorted."""
    n = len(levels[0]) - 1
    inverse = levels[-1]
    order = np.empty(n, np.int64)
    order[inverse[:n]] = np.arange(n)
    depths, counts, bounds = lcp_intervals(common_prefixes(levels, order), exponent)
    if not len(depths):
        return np.zeros((0, 2), np.int64)
    last = np.cumsum(counts) - 1
    own = np.repeat(np.arange(len(depths)), counts)[:-1]
    low, high = bounds[:-1], bounds[1:]
    inner = own == np.repeat(np.arange(len(depths)), counts)[1:]  # not across two intervals
    low, high, own = low[inner], high[inner], own[inner]
    size = high - low
    starts = np.concatenate([[0], np.cumsum(counts - 1)[:-1]])
    largest = np.repeat(np.maximum.reduceat(size, starts), counts - 1) == size
    # Of several largest children the first is left out.
    seen = np.cumsum(largest)
    before = np.repeat((seen - largest)[starts], counts - 1)
    small = ~(largest & (seen - before == 1))
    low, high, own, size = low[small], high[small], own[small], size[small]
    begin, end = bounds[last - counts + 1], bounds[last]
    child = np.repeat(np.arange(len(low)), size)
    place = low[child] + np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size)
    node = own[child]
    at, depth = order[place], depths[node]

    def within(suffix: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        where = inverse[np.clip(suffix, 0, n)]
        return (suffix >= 0) & (where >= begin[nodes]) & (where < end[nodes])

    found = []
    for partner, square in ((at + depth, at), (at - depth, at - depth)):
        where = inverse[np.clip(partner, 0, n)]
        hit = within(partner, node) & ((where < low[child]) | (where >= high[child]))
        for k in range(1, exponent - 1):  # as many pieces before it as the exponent asks for
            hit[hit] = within(square[hit] - k * depth[hit], node[hit])
        found.append(np.stack([square[hit] + 2 * depth[hit], depth[hit]], 1))
    return np.unique(np.concatenate(found), axis=0)


def _rotated(codes: np.ndarray, at: int, period: int, low: int) -> int:
    """The first place from which on, up to ``at``, words ``period`` apart are equal."""
    size = 64
    while at > low:
        first = max(low, at - size)
        differ = np.flatnonzero(codes[first:at] != codes[first + period : at + period])
        if len(differ):
            return first + int(differ[-1]) + 1
        at, size = first, 2 * size
    return low


def runs_of(documents: list[list[int]], exponent: int = EXPONENT, least: int = LEAST_WORDS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, a list of word numbers, sorted.

    A run has at least ``exponent`` (2 or more) periods and ``least`` words.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(d) for d in documents], np.int64)
    if not sizes.sum():
        return out
    words = np.concatenate([np.asarray(d, np.int64) for d in documents])
    document = np.repeat(np.arange(len(documents)), sizes)
    ends = np.cumsum(sizes)
    codes = document * (int(words.max()) + 1) + words
    known: list[tuple[int, int]] = []
    last = -1
    for end, period in branching_squares(suffix_ranks(codes, ends[document]), exponent).tolist():
        if end != last:
            known, last = [], end
        # A multiple of a period that already has a run here is that run again.
        if any(period % q == 0 and end - 2 * period >= start for start, q in known):
            continue
        d = int(document[end - 1])
        low = int(ends[d] - sizes[d])
        start = _rotated(codes, end - 2 * period, period, low)
        known.append((start, period))
        if end - start >= max(least, exponent * period):
            out[d].append((start - low, end - start, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, each run down to its first period."""
    if runs:
        keep = bytearray(b"\x01") * len(words)
        for start, length, period in runs:
            keep[start + period : start + length] = bytes(length - period)
        words = [w for w, k in zip(words, keep, strict=True) if k]
    return b" ".join(words)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _chunks(texts: list[str]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, in groups of about CHUNK_WORDS words."""
    group, held = [], 0
    for text in texts:
        words = text.encode().split()  # of bytes: at ASCII white space alone
        if group and held + len(words) > CHUNK_WORDS:
            yield group
            group, held = [], 0
        group.append(words)
        held += len(words)
    if group:
        yield group


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    exponent: int = EXPONENT,
    least: int = LEAST_WORDS,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``runs``, ``collapsed``.

    Words are the pieces between blanks ``[\\x20\\x09-\\x0D]``. ``runs`` has (start, length, period)
    of every stretch of words that repeats with that smallest period, at least ``exponent`` times
    and over ``least`` words, and that no word beside it continues; sorted by start and period.
    ``collapsed`` has the words joined by one blank, less those of each run behind its first
    period. Null and empty texts have no words. Rows are taken one by one, so repeated rows and
    null ids stay as they are; an empty table gives no rows; other columns are not read.

    Rows are independent: no shuffle. A task holds one group of about CHUNK_WORDS words, or one
    longer document, with some 30 words of memory for each, and 4 more for each doubling of a
    repeat in it.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for group in _chunks(batch.column(1).to_pylist()):
                number = _Numbers().__getitem__
                # A document too short for a run takes no place in the suffix array.
                runs = runs_of([list(map(number, w)) if len(w) >= least else [] for w in group], exponent, least)
                kept = [_collapsed(w, r).decode() for w, r in zip(group, runs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(group)),
                        pa.array([len(w) for w in group], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs], pa.list_(RUN)),
                        pa.array(kept, pa.string()),
                    ],
                    names=[id_col, "n_words", "runs", "collapsed"],
                )
                done += len(group)

    schema = f"`{id_col}` long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return texts_of(docs, id_col, text_col).mapInArrow(found, schema)
