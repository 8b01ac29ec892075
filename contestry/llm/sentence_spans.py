"""Repeated passages by sliding sentence spans.

From every sentence on, the shortest run of at least SPAN_SENTENCES sentences with at least
SPAN_WORDS words is hashed. Spans are joined over the whole corpus; sentences under a span
that occurred before, in a document with a smaller id or earlier in the same one, are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.llm.common import texts_of
from contestry.session import cut_lineage

SPAN_SENTENCES, SPAN_WORDS = 3, 20
#: A sentence or clause ends at one of these signs before white space, or with its line.
END = re.compile(r"[.!?;:,]+\s+|\n\s*")
#: Of every so many words in a row in a sentence, the one of the least hash ends a part.
CUT_WORDS = 8
WORD = re.compile(r"\S+\s*")
LAST_ID = (1 << 63) - 1


def cuts_of(words: list[str]) -> list[int]:
    """Numbers of the words of one sentence that end a part, by content alone.

    The last of the least hashes of each CUT_WORDS words in a row is picked. A window that lies
    within a passage picks the same word wherever the passage stands, and no window that leaves
    it picks one between two of those. So what two texts share is cut alike but for less than
    CUT_WORDS words behind its start and before its end, and no part is longer than CUT_WORDS.
    """
    hashes = list(map(xxhash.xxh3_64_intdigest, words))
    out, least = [], -1
    for last in range(CUT_WORDS - 1, len(words)):
        first = last - CUT_WORDS + 1
        if least < first:
            window = hashes[last : first - 1 if first else None : -1]
            least = last - window.index(min(window))
        elif hashes[last] <= hashes[least]:
            least = last
        else:
            continue
        out.append(least)
    return out


def _stops(text: str, start: int, end: int, words: list[str]) -> list[int]:
    """Where the blanks behind each word of ``text[start:end]`` end."""
    bare = text[start:end].lstrip()
    begin = end - len(bare)
    if len(bare.rstrip()) < sum(map(len, words)) + len(words):  # one blank between words
        stops = list(accumulate(map(len, words), lambda at, n: at + n + 1, initial=begin))[1:]
        stops[-1] = end
        return stops
    return [m.end() for m in WORD.finditer(text, begin, end)]


def sentences_of(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, words joined by blanks, number of words); the parts cover the whole text."""
    out, start = [], 0
    ends = [m.end() for m in END.finditer(text)]
    for end in [*ends, len(text)] if not ends or ends[-1] < len(text) else ends:
        words = text[start:end].split()
        cuts = cuts_of(words) if len(words) >= CUT_WORDS else []
        if cuts:
            stops, first, at = _stops(text, start, end, words), 0, start
            for k in cuts if cuts[-1] == len(words) - 1 else [*cuts, len(words) - 1]:
                out.append((at, stops[k], " ".join(words[first : k + 1]), k + 1 - first))
                at, first = stops[k], k + 1
        else:
            out.append((start, end, " ".join(words), len(words)))
        start = end
    return out


def spans_of(parts: list[tuple[int, int, str, int]]) -> list[tuple[int, int, bytes]]:
    """(first sentence, one behind the last, hash of 16 bytes) of the span that starts at each sentence."""
    told = [i for i, p in enumerate(parts) if p[3]]
    joined = " ".join([parts[i][2] for i in told])
    begins = list(accumulate([len(parts[i][2]) + 1 for i in told], initial=0))
    counts = [parts[i][3] for i in told]
    out, last, words, end = [], 0, 0, len(told)
    for first in range(end):
        while last < end and (last - first < SPAN_SENTENCES or words < SPAN_WORDS):
            words += counts[last]
            last += 1
        if last - first < SPAN_SENTENCES or words < SPAN_WORDS:
            break
        digest = xxhash.xxh3_128_digest(joined[begins[first] : begins[last] - 1])
        out.append((told[first], told[last - 1] + 1, digest))
        words -= counts[first]
    return out


def without(text: str, repeated: set[int]) -> tuple[str, int, int]:
    """Text less the sentences under repeated spans, sentences in all, sentences removed.

    A span is repeated when the first half of its hash is in ``repeated``, as a number, or it
    occurred before in the text.
    """
    parts = sentences_of(text)
    gone, seen = bytearray(len(parts)), set()
    for first, last, digest in spans_of(parts):
        if digest in seen or (repeated and int.from_bytes(digest[:8], "little", signed=True) in repeated):
            gone[first:last] = b"\x01" * (last - first)
        seen.add(digest)
    kept = "".join([text[s:e] for (s, e, _, _), g in zip(parts, gone, strict=True) if not g])
    return (kept if any(gone) else text), len(parts), sum(gone)


SPAN = ["_span", "_rest"]


def span_table(texts: DataFrame) -> DataFrame:
    """``_id`` and ``SPAN``: each different span of a document once, by its hash of two numbers."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1).to_pylist():
                own = {digest for _, _, digest in spans_of(sentences_of(text))}
                counts.append(len(own))
                found += own
            halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            ids = np.repeat(batch.column(0).to_numpy(), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(np.ascontiguousarray(h)) for h in halves.T)], names=["_id", *SPAN]
            )

    return texts.mapInArrow(spans, "_id long, _span long, _rest long")


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_sentences``, ``n_removed``, ``text`` without the repeats.

    The first occurrence, by id and place, stays. Null text is empty text. Rows that share an
    id are one document: they do not repeat each other. Rows with a null id come last, as one
    document too. Spans are compared by words, whatever the white space between them, by a
    128-bit hash. An empty table gives no rows; other columns are not read.

    Spans are hashed once and written. They are counted with partial sums before the shuffle.
    The join back may be skewed (a passage in a third of all documents): its other side is a
    table with one row per shared span, so AQE splits it.
    """
    texts = texts_of(docs, id_col, text_col).withColumn("_key", F.coalesce("_id", F.lit(LAST_ID)))
    spans = cut_lineage(span_table(texts.select(F.col("_key").alias("_id"), "_text")))
    shared = spans.groupBy(*SPAN).agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last")
    shared = cut_lineage(shared.select(*SPAN, "_first"))
    later = spans.join(shared, SPAN).where(F.col("_id") > F.col("_first"))
    lists = cut_lineage(later.groupBy(F.col("_id").alias("_key")).agg(F.collect_set("_span").alias("_spans")))
    joined = texts.join(lists, "_key", "left").select("_id", "_text", "_spans")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                without(text, set(spans or ()))
                for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            kept, parts, gone = zip(*rows, strict=True) if rows else ((), (), ())
            arrays = [batch.column(0), pa.array(parts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_sentences", "n_removed", "text"])

    return joined.mapInArrow(cleaned, f"`{id_col}` long, n_sentences long, n_removed long, text string")
