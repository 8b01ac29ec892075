"""Repeated byte strings by an interval tree over enhanced suffix arrays.

Every window of ``length`` bytes has an anchor, the first smallest of the byte-gram hashes in
it, so equal windows lie around equal anchors. Stretches of windows with one anchor are
fragments; anchors that occur once cannot hold a repeat and their fragments never move.
Fragments that share an anchor meet in one task, which sorts their suffixes, computes common
prefixes, scans them with a stack for prefix intervals of at least ``length`` bytes, and takes
those whose occurrences differ in the byte before: the maximal repeats, with all occurrences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contestry.llm.common import carried, let_go, texts_of
from contestry.session import cut_lineage

LENGTH = 200
#: Bytes of a gram; a window of LENGTH bytes has LENGTH - GRAM + 1 of them.
GRAM = 48
#: Windows handled at once, so that a document of any length needs bounded memory.
PIECE = 1 << 20
PLACE_BITS = 24
#: Bytes of fragments whose suffixes are sorted together, about, and different fragments of one
#: anchor above which the anchor's windows are counted one by one instead (same results).
SORTED_BYTES, MOST_FRAGMENTS = 2 << 20, 20_000
LAST_ID = (1 << 63) - 1
WORD = 7
#: Sorted keys compared at once.
BLOCK = 1 << 18

BASE = 0x5851F42D4C957F2D
_INVERSE = pow(BASE, -1, 1 << 64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64; kept for the largest n asked for."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(12, (n - 1).bit_length())
        table = np.ones(1, np.uint64)
        while len(table) < size:
            step = np.uint64(pow(base, len(table), 1 << 64))
            table = np.concatenate([table, table * step])
        _powers[base] = known = table
    return known[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(BASE, n), out=sums[1:])
    h = (sums[gram:] - sums[: n - gram + 1]) * _power_table(_INVERSE, n - gram + 1)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def fragments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, one behind the last window) of each stretch of windows."""
    whole = np.frombuffer(data, np.uint8)
    out = []
    for at in range(0, len(whole) - length + 1, PIECE):
        part = whole[at : at + PIECE + length - 1]
        hashes = gram_hashes(part, gram)
        place = np.arange(len(hashes), dtype=np.uint64)
        # The top bits decide, the place breaks ties: the first of the smallest.
        least = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place
        width, span = length - gram + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        anchor = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        behind = np.append(first[1:], len(anchor))
        out.append((hashes[anchor[first]].view(np.int64), first + at, behind + at))
    if not out:
        return (np.array([], np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _ranks(key: np.ndarray, kind: type) -> np.ndarray:
    """For each key the number of different smaller keys."""
    order = np.argsort(key)
    out, rank = np.zeros(len(key), kind), kind(0)
    for at in range(1, len(key), BLOCK):
        own = key[order[at - 1 : at + BLOCK]]
        ranks = rank + np.cumsum(own[1:] != own[:-1], dtype=kind)
        out[order[at : at + BLOCK]] = ranks
        rank = ranks[-1]
    return out


class SuffixArray:
    """Suffixes of several byte strings that start where at least ``least`` bytes follow.

    Places and ranks take four bytes each, as long as there are fewer than 2 ** 31 bytes, and
    what only the sorting needs goes when it is done: about 50 bytes for each byte of seven levels
    (strings of up to 448 bytes) at once.
    """

    def __init__(self, strings: list[bytes], least: int):
        lengths = np.array([len(s) for s in strings], np.int64)
        data = np.frombuffer(b"".join(strings), np.uint8)
        n = len(data)
        kind = np.int32 if n < 1 << 31 else np.int64
        self.data, self.least = data, least
        self.left = np.repeat(np.cumsum(lengths).astype(kind), lengths)  # bytes to the end of the own string
        self.left -= np.arange(n, dtype=kind)
        levels = self._levels(int(lengths.max()) if len(lengths) else 0, kind)
        starts = np.flatnonzero(self.left >= least)
        self.order = starts[np.argsort(levels[-1][starts], kind="stable")]
        self.common = self._common_prefixes(levels)
        self.owner = np.repeat(np.arange(len(strings), dtype=kind), lengths)
        self.within = np.repeat(lengths.astype(kind), lengths) - self.left

    def _levels(self, longest: int, kind: type) -> list[np.ndarray]:
        """levels[j] orders the runs of WORD * 2 ** j symbols from each place."""
        data, left, n = self.data, self.left, len(self.data)
        # Symbols are bytes plus one, and 0 behind the end of the own string, so an ended suffix
        # sorts before its continuations; seven of nine bits fill a word.
        key = np.zeros(n, np.int64)
        for k in range(WORD):
            key <<= 9
            symbol = data[k:].astype(np.int16) + np.int16(1)
            symbol[left[: len(symbol)] <= k] = 0
            key[: len(symbol)] |= symbol
        levels, span = [_ranks(key, kind)], WORD
        while span < longest:
            now = levels[-1]
            np.multiply(now, n + 1, out=key, dtype=np.int64)
            after = now[span:] + kind(1)
            after[left[: len(after)] <= span] = 0
            key[: len(after)] += after
            del after
            levels.append(_ranks(key, kind))
            span *= 2
        return levels

    def _common_prefixes(self, levels: list[np.ndarray]) -> np.ndarray:
        """common[i]: bytes that suffix i shares with the one before it; 0 for the first."""
        a, b = self.order[:-1], self.order[1:]
        n, same = len(self.data), np.zeros(len(a), np.int64)
        while levels:
            ranks = levels.pop()
            span = WORD << len(levels)
            x, y = a + same, b + same
            inside = (x < n) & (y < n)
            hit = np.zeros(len(a), bool)
            hit[inside] = ranks[x[inside]] == ranks[y[inside]]
            same += span * hit
        for _ in range(WORD - 1):
            x, y = a + same, b + same
            inside = (x < n) & (y < n)
            hit = np.zeros(len(a), bool)
            hit[inside] = self.data[x[inside]] == self.data[y[inside]]
            same += hit
        # Bytes behind the end of the own string may agree too; a suffix ends with its own.
        same = np.minimum(same, np.minimum(self.left[a], self.left[b]))
        return np.concatenate([[0], same]) if len(self.order) else same

    def before(self) -> np.ndarray:
        """The byte before each suffix; a different negative number where its string begins."""
        return np.where(self.within[self.order] > 0, self.data[self.order - 1], -1 - self.order)

    def maximal_repeats(self) -> Iterator[tuple[int, int, int]]:
        """(length, first, last) in suffix order of each maximal repeat of at least ``least``.

        A stack holds the open prefix intervals. An interval closes where the common prefix
        gets shorter; it is maximal if the bytes before its occurrences differ, which every
        interval hands on to the one around it.
        """
        common, before = self.common, self.before()
        for begin, end in _stretches(common >= self.least):
            values, last = common[begin:end].tolist(), before[begin - 1 : end].tolist()
            stack: list[list] = []  # [length, first, byte before all so far, or None if they differ]
            for i, value in enumerate([*values, 0]):
                # Suffix i is in every open interval; what it adds is handed down as they close.
                first, own = i, last[i]
                while stack and stack[-1][0] > value:
                    size, first, known = stack.pop()
                    own = own if own == known else None
                    if own is None:
                        yield size, begin - 1 + first, begin - 1 + i
                if stack and stack[-1][0] == value:
                    stack[-1][2] = own if own == stack[-1][2] else None
                elif value:
                    stack.append([value, first, own])


def _stretches(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    yield from zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


def repeated_ranges(strings: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each string, the ranges that maximal repeats of at least ``length`` cover."""
    array = SuffixArray(strings, length)
    reach = np.zeros_like(array.left)
    for size, first, last in array.maximal_repeats():
        places = array.order[first : last + 1]
        reach[places] = np.maximum(reach[places], size)
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    places = np.flatnonzero(reach)
    for owner, start, size in zip(array.owner[places].tolist(), array.within[places].tolist(), reach[places].tolist(), strict=True):
        ranges = out[owner]
        if ranges and start <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(ranges[-1][1], start + size))
        else:
            ranges.append((start, start + size))
    return out


def _marked(length: int):
    """Ranges of the fragments of whole anchors, for rows sorted by anchor.

    A fragment that comes again, from repeated rows of its document, is held and sorted once.
    """

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            if not len(frame):
                continue
            held.append(frame)
            size += int(frame["_part"].str.len().sum())
            if size >= SORTED_BYTES:
                every = different(held)
                last = every["_anchor"] == every["_anchor"].iat[-1]
                if not last.all():
                    yield sort(every[~last])
                held = [every[last]]
                size = int(held[0]["_part"].str.len().sum())
        if held:
            yield sort(different(held))

    def different(held: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(held).drop_duplicates(["_anchor", "_digest"])

    def sort(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [bytes(b) for b in rows["_part"]]
        found = repeated_ranges(parts, length)
        # A fragment that occurs twice as a whole is covered as a whole.
        found = [[(0, len(b))] if n > 1 else r for r, b, n in zip(found, parts, rows["_n"], strict=True)]
        out = pd.DataFrame({"_anchor": rows["_anchor"].to_numpy(), "_digest": rows["_digest"].to_numpy()})
        out["_starts"] = [[s for s, _ in r] for r in found]
        out["_ends"] = [[e for _, e in r] for r in found]
        return out[[bool(r) for r in found]]

    return mark


def _window_ranges(crowded: DataFrame, length: int) -> DataFrame:
    """The same ranges for anchors with very many different fragments, by counting windows.

    Rows grow with the fragments times the windows of each, never with pairs.
    """
    places = F.sequence(F.lit(1), F.length("_part") - length + 1)
    each = crowded.select("_anchor", "_digest", "_n", "_part", F.explode(places).alias("_at"))
    each = each.withColumn("_window", F.sha2(F.substring("_part", F.col("_at"), F.lit(length)), 256))
    each = each.select("_anchor", "_digest", "_n", (F.col("_at") - 1).cast("long").alias("_at"), "_window")
    shared = each.groupBy("_anchor", "_window").agg(F.sum("_n").alias("_times")).where("_times > 1").drop("_times")
    hit = each.join(shared, ["_anchor", "_window"])
    return hit.groupBy("_anchor", "_digest").agg(F.sort_array(F.collect_list("_at")).alias("_starts")).select(
        "_anchor", "_digest", "_starts", F.transform("_starts", lambda s: s + length).alias("_ends")
    )


def _kinds_of_fragments(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``_key``, ``_hash``, ``_anchor``, ``_digest``, ``_n``: each different fragment of a document."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                kinds = []
                for data in rows.column(2).to_pylist():
                    anchors, first, behind = fragments(data, length, gram)
                    digests = [_digest(data[f : b + length - 1]) for f, b in zip(first.tolist(), behind.tolist(), strict=True)]
                    kinds.append(Counter(zip(anchors.tolist(), digests, strict=True)))
                times = [len(k) for k in kinds]
                columns = [pa.array(np.repeat(rows.column(k).to_numpy(), times)) for k in (0, 1)]
                pairs = [pair for k in kinds for pair in k]
                columns += [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)]
                columns.append(pa.array([n for k in kinds for n in k.values()], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=["_key", "_hash", "_anchor", "_digest", "_n"])

    schema = "_key long, _hash long, _anchor long, _digest long, _n long"
    return texts.select("_key", "_hash", "_bytes").mapInArrow(listed, schema)


def _digest(part: bytes) -> int:
    return xxhash.xxh3_64_intdigest(part) - (1 << 63)


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    gram: int = GRAM, most_fragments: int = MOST_FRAGMENTS, carry: Sequence[str] = (),
) -> DataFrame:
    """Documents (``_id``, ``_bytes``, ``_carried``) with what is known of their fragments.

    ``_whole`` lists anchors all of whose fragments are equal and occur more than once;
    ``_ranges`` has (anchor, digest, starts, ends) for fragments of the other shared anchors.
    Numbers of fragments settle most anchors; bytes are fetched once for each different
    fragment of the rest, from one document that holds it.
    """
    texts = texts_of(docs, id_col, text_col, carry).select(
        "_id",
        F.coalesce("_id", F.lit(LAST_ID)).alias("_key"),
        F.xxhash64("_text").alias("_hash"),
        F.col("_text").cast("binary").alias("_bytes"),
        *(["_carried"] if carry else []),
    )
    kinds = cut_lineage(_kinds_of_fragments(texts, length, gram))
    anchors = kinds.groupBy("_anchor").agg(
        F.sum("_n").alias("_times"), (F.min("_digest") != F.max("_digest")).alias("_rival")
    )
    shared = cut_lineage(kinds.join(anchors.where("_times > 1").drop("_times"), "_anchor"))
    rivals = shared.where("_rival")
    # One home for each different fragment; its number over all documents decides with it.
    homes = cut_lineage(
        rivals.groupBy("_anchor", "_digest").agg(F.sum("_n").alias("_n"), F.min(F.struct("_key", "_hash")).alias("_home"))
    )
    crowded = cut_lineage(
        homes.groupBy("_anchor").agg(F.count("*").alias("_kinds")).where(F.col("_kinds") > most_fragments).select("_anchor")
    )
    fetched = homes.groupBy("_home._key", "_home._hash").agg(
        F.collect_list(F.struct("_anchor", "_digest", "_n")).alias("_fetch")
    )
    whole = shared.where("NOT _rival").groupBy("_key", "_hash").agg(F.collect_list("_anchor").alias("_whole"))
    lists = fetched.join(whole, ["_key", "_hash"], "full")
    known = texts.join(lists, ["_key", "_hash"], "left")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_bytes, at_fetch = batch.schema.get_field_index("_bytes"), batch.schema.get_field_index("_fetch")
            for at in range(batch.num_rows):
                wanted = batch.column(at_fetch)[at].as_py()
                if not wanted:
                    continue
                data, times = batch.column(at_bytes)[at].as_py(), {(w["_anchor"], w["_digest"]): w["_n"] for w in wanted}
                rows = []
                for anchor, first, behind in zip(*(x.tolist() for x in fragments(data, length, gram)), strict=True):
                    part = data[first : behind + length - 1]
                    n = times.pop((anchor, _digest(part)), None)  # once, though it may occur again
                    if n is not None:
                        rows.append((anchor, _digest(part), n, part))
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                        names=["_anchor", "_digest", "_n", "_part"],
                    )

    parts = known.mapInArrow(fetch, "_anchor long, _digest long, _n long, _part binary")
    # Repeated rows of a document fetch the same part again.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "_anchor long, _digest long, _starts array<long>, _ends array<long>"
    if crowded.isEmpty():
        ranges = parts.repartition(tasks, "_anchor").sortWithinPartitions("_anchor").mapInPandas(_marked(length), schema)
    else:
        parts = cut_lineage(parts)
        usual = parts.join(crowded, "_anchor", "left_anti").repartition(tasks, "_anchor").sortWithinPartitions("_anchor")
        many = parts.join(crowded, "_anchor", "left_semi").dropDuplicates(["_anchor", "_digest"])
        ranges = usual.mapInPandas(_marked(length), schema).unionByName(_window_ranges(many, length))
    ranges = ranges.dropDuplicates(["_anchor", "_digest"])
    placed = rivals.select("_key", "_hash", "_anchor", "_digest").join(ranges, ["_anchor", "_digest"])
    placed = placed.groupBy("_key", "_hash").agg(
        F.collect_list(F.struct("_anchor", "_digest", "_starts", "_ends")).alias("_ranges")
    )
    return known.join(placed, ["_key", "_hash"], "left").drop("_key", "_hash", "_fetch")


def covered_spans(data: bytes, whole, ranges, length: int, gram: int) -> list[tuple[int, int]]:
    """Removed runs of a document in order; those that overlap or touch are one."""
    whole = set(whole or ())
    known = {(r["_anchor"], r["_digest"]): (r["_starts"], r["_ends"]) for r in ranges or ()}
    out: list[tuple[int, int]] = []

    def add(start: int, end: int) -> None:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))

    if whole or known:
        for anchor, first, behind in zip(*(x.tolist() for x in fragments(data, length, gram)), strict=True):
            if anchor in whole:
                add(first, behind + length - 1)
            elif known and (found := known.get((anchor, _digest(data[first : behind + length - 1])))):
                # Fragments come in the order of their windows, and so do ranges within one.
                for start, end in zip(*found, strict=True):
                    add(first + start, first + end)
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    gram: int = GRAM, most_fragments: int = MOST_FRAGMENTS, carry: Sequence[str] = (), as_text: bool = False,
) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary), and
    the columns named in ``carry``. With ``as_text``, ``kept`` is text, without what is left of
    characters that a cut went through.

    Removes every byte under a string of ``length`` bytes that also starts anywhere else, the
    first occurrence too; strings are judged on the input and never cross documents. Null text
    is empty text; texts shorter than ``length`` keep everything. Repeated rows are documents
    that repeat each other; null ids are rows like others. An empty table gives no rows; other
    columns are not read.
    """
    extra = ["_carried"] if carry else []
    joined = repeated_spans(docs, id_col, text_col, length, gram, most_fragments, carry)
    joined = joined.select("_id", "_bytes", "_whole", "_ranges", *extra)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                data, whole, ranges = (batch.column(k)[at].as_py() for k in (1, 2, 3))
                gone = covered_spans(data, whole, ranges, length, gram)
                edges = [0, *(x for span in gone for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                shown = kept.decode("utf-8", "ignore") if as_text else kept
                rows.append((len(data), len(data) - len(kept), len(gone), shown))
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays = [batch.column(0), *arrays, *(batch.column(4 + k) for k in range(len(extra)))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    schema = T.StructType()
    for name in (id_col, "n_bytes", "n_removed", "n_spans"):
        schema.add(name, "long")
    schema.add("kept", "string" if as_text else "binary")
    if carry:
        schema.add(joined.schema["_carried"])
    return joined.mapInArrow(cleaned, schema).select(
        id_col, "n_bytes", "n_removed", "n_spans", "kept", *carried(carry)
    )
