"""Jaccard join on word n-grams with Bayesian pruning of candidates.

Texts that share a band of MinHash values are candidates. Their MinHash values are compared a
few at a time; a pair is dropped as soon as the posterior probability that it reaches the
threshold falls below a tolerance, and what is left is verified on the n-gram sets themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.llm.blocks import link_rows
from contestry.llm.common import DOCUMENT, document_key, let_go, texts_of
from contestry.llm.components import block_pairs, connected_components
from contestry.session import cut_lineage

WORDS, THRESHOLD = 5, 0.8
#: BANDS of ROWS values: two texts of similarity 0.8 share no band once in 300,000 pairs.
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Values compared between two prunings, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
BLOCK = 512
#: Survivors of a pair of blocks above which intersections are counted by matrix products.
MANY, COLUMNS = 2_000, 4_096
TOKEN = re.compile(r"\w+")

_draw = np.random.default_rng(20)
MULTIPLY = _draw.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sets of hashed word n-grams; remembers hashes of words up to a bound."""

    def __init__(self, words: int = WORDS, remembered: int = 300_000):
        self.words, self.remembered, self.known = words, remembered, {}

    def of(self, text: str) -> tuple[np.ndarray, bytes]:
        """Sorted different n-gram hashes, and a digest of the word sequence.

        A text of fewer words than ``words``, but at least one, has one n-gram of all of them.
        """
        words = TOKEN.findall(text.lower())
        digest = xxhash.xxh3_128_digest(" ".join(words))
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        h = np.array([known[w] for w in words], np.uint64)
        if not len(h):
            return h, digest
        n = min(self.words, len(h))
        total = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            total = _mixed(total + h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
        return np.unique(total), digest


def minhash(grams: np.ndarray) -> np.ndarray:
    """HASHES values of 32 bits, each the least under one hash function."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 8_192):
        part = grams[at : at + 8_192]
        for k in range(HASHES):
            least[k] = min(least[k], (part * MULTIPLY[k] + ADD[k]).min())
    return (least >> np.uint64(32)).astype(np.uint32)


def bands_of(values: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash for each band, the band's number included."""
    rows = values.reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for k in range(ROWS):
        total = _mixed(total + rows[:, k])
    return total.view(np.int64)


@cache
def least_matches(seen: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values among ``seen`` with which a pair goes on.

    With any similarity alike beforehand, m equal of n values leave P(s >= t) =
    P(Binomial(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(seen + 1):
        total += comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if total >= tolerance:
            return m
    return seen


def surviving_pairs(values: np.ndarray, allowed: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Places (i < j) that no pruning dropped; ``allowed`` marks the pairs to look at."""
    n = len(values)
    equal = np.zeros((n, n), np.uint8)
    for k in range(STEP):
        equal += values[:, k][:, None] == values[:, k][None, :]
    pairs = np.argwhere(np.triu(allowed, 1) & (equal >= least_matches(STEP, threshold, tolerance)))
    same = equal[pairs[:, 0], pairs[:, 1]].astype(np.int64)
    for at in range(STEP, values.shape[1], STEP):
        same += (values[pairs[:, 0], at : at + STEP] == values[pairs[:, 1], at : at + STEP]).sum(axis=1)
        keep = same >= least_matches(min(at + STEP, values.shape[1]), threshold, tolerance)
        pairs, same = pairs[keep], same[keep]
    return pairs


def verified(grams: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Those of ``pairs`` whose sets reach the threshold, counted exactly."""
    sizes = np.array([len(g) for g in grams])
    if len(pairs) <= MANY:
        common = np.array([len(np.intersect1d(grams[i], grams[j], assume_unique=True)) for i, j in pairs], np.int64)
    else:
        values, place, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(grams)), sizes)
        shared = times[place] > 1
        column, owner = (np.cumsum(times > 1) - 1)[place[shared]], owner[shared]
        both = np.zeros((len(grams), len(grams)), np.float32)
        for at in range(0, int((times > 1).sum()), COLUMNS):
            part = (column >= at) & (column < at + COLUMNS)
            table = np.zeros((len(grams), COLUMNS), np.float32)
            table[owner[part], column[part] - at] = 1
            both += table @ table.T
        common = both[pairs[:, 0], pairs[:, 1]].astype(np.int64)
    union = sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - common if len(pairs) else common
    # In whole numbers where the threshold allows, so that a pair right at it is not lost.
    return pairs[common >= threshold * union - 1e-9 * union]


def _compare(frame: pd.DataFrame, threshold: float, tolerance: float) -> pd.DataFrame:
    """Links between two blocks of candidates; repeated rows of one text count once."""
    frame = frame.drop_duplicates("_rep")
    values = np.stack([np.frombuffer(v, np.uint32) for v in frame["_values"]])
    grams = [np.frombuffer(g, np.uint64) for g in frame["_grams"]]
    own = frame["_own"].to_numpy()
    allowed = np.ones((len(own), len(own)), bool)
    if frame["_b1"].iat[0] != frame["_b2"].iat[0]:
        allowed = own[:, None] != own[None, :]
    pairs = verified(grams, surviving_pairs(values, allowed, threshold, tolerance), threshold)
    linked = np.zeros((len(own), len(own)), bool)
    linked[pairs[:, 0], pairs[:, 1]] = linked[pairs[:, 1], pairs[:, 0]] = True
    some = np.flatnonzero(linked.any(axis=1))
    linked = linked[np.ix_(some, some)]
    return link_rows(
        frame["_rep"].to_numpy()[some], frame["_copies"].to_numpy()[some].astype(float), linked.astype(float), linked
    )


def signatures(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``DOCUMENT``, ``_digest`` of the word sequence and ``_bands`` of each text; two nulls without a word."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        shingler = Shingler(words)
        for batch in batches:
            digests, bands = [], []
            for text in batch.column(3).to_pylist():
                grams, digest = shingler.of(text)
                digests.append(digest if len(grams) else None)
                bands.append(bands_of(minhash(grams)) if len(grams) else None)
            arrays = [*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*DOCUMENT, "_digest", "_bands"])

    return texts.mapInArrow(signed, "_null boolean, _key long, _hash long, _digest binary, _bands array<long>")


def similar_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    words: int = WORDS,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: id, ``n_links``, ``class_id``, ``kept``, and ``DOCUMENT``.

    Two documents are linked when the Jaccard similarity of their sets of ``words``-word
    n-grams (lower case, letters and figures) is at least ``threshold``. ``n_links`` counts
    documents, copies included; ``class_id`` is the smallest id that links reach, null only if
    all are, and ``kept`` marks its document. Null and empty texts, and those without a word,
    link with nothing. Rows alike in id and text are one document and counted once; different
    texts with one id, or without one, are documents of their own, in the order of their
    hashes, null ids last. An empty table gives no rows; other columns are not read.

    Equal word sequences are one while comparing. Only band hashes are shuffled for all texts;
    n-grams move only for texts that share a band with another. Groups of candidates above
    ``block`` are compared in pairs of blocks; tasks return counts and spanning edges.
    """
    rows = texts_of(docs, id_col, text_col)
    texts = rows.select(*document_key(F.col("_id"), F.col("_text")), "_text")
    signed = cut_lineage(signatures(texts, words))
    single = signed.where("_digest IS NOT NULL").dropDuplicates(DOCUMENT)
    copies = single.groupBy("_digest").agg(F.min(F.struct(*DOCUMENT)).alias("_first"), F.count("*").alias("_copies"))
    # Written, so the numbers stay.
    copies = cut_lineage(copies.withColumn("_rep", F.monotonically_increasing_id()))
    first = copies.select("_rep", "_first.*")
    reps = single.select(*DOCUMENT, "_bands").join(first, DOCUMENT).select("_rep", "_bands")
    banded = cut_lineage(reps.select("_rep", F.explode("_bands").alias("_band")))
    buckets = banded.groupBy("_band").agg(F.min("_rep").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    stars = banded.join(buckets, "_band").select(F.col("_first").alias("a"), F.col("_rep").alias("b"))
    groups = connected_components(stars)
    chosen = groups.join(copies, F.col("node") == F.col("_rep")).select("_first.*", "_rep", "_digest", "_copies", "component")
    candidates = texts.join(chosen, DOCUMENT).select("_text", "_digest", "_rep", "_copies", "component")

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            values, grams, keep = [], [], []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, digest = shingler.of(text)
                keep.append(digest == wanted)
                if keep[-1]:
                    values.append(minhash(found).tobytes())
                    grams.append(found.tobytes())
            kept = batch.select(["_rep", "_copies", "component"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(values, pa.binary()), pa.array(grams, pa.binary())],
                names=["_rep", "_copies", "_group", "_values", "_grams"],
            )

    ready = candidates.mapInArrow(prepared, "_rep long, _copies long, _group long, _values binary, _grams binary")
    told = block_pairs(ready, "_group", "_rep", block).groupBy("_group", "_b1", "_b2")
    told = cut_lineage(told.applyInPandas(lambda f: _compare(f, threshold, tolerance), "id long, to long, n long"))
    links = told.where("to IS NULL").groupBy(F.col("id").alias("_rep")).agg(F.sum("n").alias("_links"))
    parts = connected_components(told.where("to IS NOT NULL"), "id", "to").withColumnRenamed("node", "_rep")
    classes = copies.join(links, "_rep", "left").join(parts, "_rep", "left")
    classes = classes.select("_digest", "_first", "_copies", "_links", F.coalesce("component", "_rep").alias("_class"))
    least = classes.groupBy("_class").agg(F.min("_first").alias("_least"))
    # Written, so that a sequence that a third of all documents have is split by the join.
    known = cut_lineage(classes.join(least, "_class").select("_digest", "_copies", "_links", "_least"))
    out = signed.select(*DOCUMENT, "_digest").join(known, "_digest", "left")
    place = F.struct(*DOCUMENT)
    one = F.coalesce("_least", place)
    return out.select(
        F.when(~F.col("_null"), F.col("_key")).alias(id_col),
        (F.coalesce("_links", F.lit(0)) + F.coalesce(F.col("_copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.when(~one["_null"], one["_key"]).alias("class_id"),
        (one == place).alias("kept"),
        *DOCUMENT,
    )
