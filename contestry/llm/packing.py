"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens. Full pieces need no company. The rest
are dealt at random into shards of bounded size; each shard is a packing problem of its own,
solved on several islands, each a row that one task evolves. Between rounds every island gets
the best solution of its neighbour. Only piece numbers and lengths move, never tokens.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contestry.llm.byte_bpe import REMEMBERED
from contestry.llm.common import keep, texts_of
from contestry.session import cut_lineage

#: Pieces of a shard, about; a shard wastes less than one sequence, so one in thousands.
SHARD_PIECES = 8_000
ISLANDS, POPULATION, ROUNDS, GENERATIONS = 2, 4, 2, 5


def _byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: itself if visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(0x100)).difference(visible))
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def cut_points(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: the first takes what is over, the others are full."""
    first = total % capacity or min(total, capacity)
    starts = [0, *range(first, total, capacity)] if total else []
    return [(s, (first if s == 0 else capacity)) for s in starts]


def word_encoder(tokenizer: str, pattern: str) -> Callable[[str], bytes]:
    """Ids of a text, as bytes, by a serialised byte-level tokenizer that splits by ``pattern``.

    Splitting first and encoding each different pre-token once gives the ids of the whole
    text, since no merge crosses pre-tokens. Added tokens of the tokenizer are found in the text
    before that, as it does itself. A tokenizer with steps besides byte letters and merges gets
    each pre-token as a text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder, told = Tokenizer.from_str(tokenizer), json.loads(tokenizer)
    split = regex.compile(pattern).findall
    added = sorted((t["content"] for t in told.get("added_tokens") or ()), key=len, reverse=True)
    between = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def words_of(text: str) -> list[str]:
        if between is None or not any(a in text for a in added):
            return split(text)
        # Every second part is an added token.
        return [w for i, part in enumerate(between.split(text)) for w in ([part] if i % 2 else split(part))]

    own = {t["content"]: struct.pack("<I", t["id"]) for t in told.get("added_tokens") or ()}
    merge = encoder.model.tokenize

    def encode(word: str) -> bytes:
        # A word is split already, so its bytes, as letters, go to the merges at once.
        found = merge(word.encode().decode("latin-1").translate(BYTE_LETTERS))
        return own.get(word) or struct.pack(f"<{len(found)}I", *[token.id for token in found])

    def encode_whole(word: str) -> bytes:
        return np.array(encoder.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    before = told.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
    plain = plain and told["model"]["type"] == "BPE" and not told.get("normalizer") and not told.get("post_processor")
    known = _Remembered(encode if plain else encode_whole)

    def ids_of(text: str) -> bytes:
        if len(known) > REMEMBERED:
            known.clear()
        return b"".join(map(known.__getitem__, words_of(text)))

    return ids_of


class _Remembered(dict):
    """Ids of pre-tokens, each encoded when it is first asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encode(word)
        return ids


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    end_id: int,
    capacity: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``_key``, (``ids``).

    ``_key`` numbers the rows: task and place within the task. Write the table before relying
    on it. A document is its ids and ``end_id``, so even an empty one has a piece.
    """
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = keep((word_encoder, shared.value, pattern), lambda: word_encoder(shared.value, pattern))
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(ids_of(text) + end, "<u4")
                for piece, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    own = ids[start : start + length]
                    row = (name, piece, start, length, zlib.crc32(own.tobytes()), key)
                    rows.append((*row, own) if with_ids else row)
                    key += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                    names=[id_col, *columns],
                )

    end = struct.pack("<I", end_id)
    columns = ["piece", "start", "length", "ids_crc32", "_key"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 4] + [pa.list_(pa.int64())] * with_ids
    schema = f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, _key long"
    return texts_of(docs, id_col, text_col).mapInArrow(cut, schema + ", ids array<long>" * with_ids)


class _Bins:
    """Open bins by the room they have left; finds the tightest that still fits."""

    def __init__(self, capacity: int, fills: np.ndarray | None = None):
        self.capacity, self.room, self.mask = capacity, [[] for _ in range(capacity + 1)], 0
        self.count = 0
        for fill in () if fills is None else fills.tolist():
            self._open(self.count, capacity - fill)
            self.count += 1

    def _open(self, number: int, room: int) -> None:
        self.room[room].append(number)
        self.mask |= 1 << room

    def put(self, size: int) -> int:
        above = self.mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            number = self.room[room].pop()
            if not self.room[room]:
                self.mask ^= 1 << room
        else:
            number, room = self.count, self.capacity
            self.count += 1
        self._open(number, room - size)
        return number


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item when items come in ``order``, each into the tightest bin that fits."""
    bins, place = _Bins(capacity), np.empty(len(sizes), np.int32)
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        place[item] = bins.put(size)
    return place


def _merit(place: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then more uneven fills; smaller is better."""
    fill = np.bincount(place, sizes) / capacity
    return len(fill), -float(np.square(fill).sum())


def _rebuilt(place: np.ndarray, gone: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """``place`` without the bins marked in ``gone``; their items come back by best fit."""
    number = np.cumsum(~gone) - 1
    loose = np.flatnonzero(gone[place])
    child = number[place].astype(np.int32)
    fills = np.bincount(place, sizes, minlength=len(gone))[~gone].astype(int)
    bins = _Bins(capacity, fills)
    loose = loose[np.argsort(-sizes[loose], kind="stable")]
    for item, size in zip(loose.tolist(), sizes[loose].tolist(), strict=True):
        child[item] = bins.put(size)
    return child


def crossover(giver, taker, sizes, capacity, draw) -> np.ndarray:
    """Inject whole well-filled bins of ``giver`` into ``taker``.

    Bins of ``taker`` that hold an injected item go, so nothing is there twice, and the items
    displaced with them are put back by best fit.
    """
    fill = np.bincount(giver, sizes)
    chosen = (fill >= np.quantile(fill, 0.5)) & (draw.random(len(fill)) < 0.2)
    injected = chosen[giver]
    moved = np.where(injected, 0, taker).astype(np.int32)
    count = int(taker.max()) + 1
    hit = np.zeros(count, bool)
    hit[taker[injected]] = True
    # Injected bins come behind those of the taker, under new numbers.
    fresh = np.cumsum(chosen) - 1 + count
    moved[injected] = fresh[giver[injected]]
    gone = np.concatenate([hit, np.zeros(int(chosen.sum()), bool)])
    return _rebuilt(moved, gone, sizes, capacity)


def mutation(place, sizes, capacity, draw) -> np.ndarray:
    """Dissolve the emptiest bins and a few at random."""
    fill = np.bincount(place, sizes)
    gone = draw.random(len(fill)) < 0.03
    gone[np.argsort(fill)[: max(1, len(fill) // 50)]] = True
    return _rebuilt(place, gone, sizes, capacity)


def evolve(population: list[np.ndarray], sizes, capacity, generations, seed) -> list[np.ndarray]:
    """Some generations on one island; the best come first and never get lost."""
    draw = np.random.default_rng(seed)
    ranked = sorted(population, key=lambda p: _merit(p, sizes, capacity))[:POPULATION]
    least = -(-int(sizes.sum()) // capacity)
    for _ in range(generations):
        if int(ranked[0].max()) + 1 == least:
            break  # no packing has fewer bins
        a, b = draw.integers(len(ranked), size=2)
        children = [crossover(ranked[a], ranked[b], sizes, capacity, draw)]
        children.append(mutation(ranked[0], sizes, capacity, draw))
        ranked = sorted([*ranked, *children], key=lambda p: _merit(p, sizes, capacity))[:POPULATION]
    return ranked


def _first_population(sizes, capacity, seed) -> list[np.ndarray]:
    draw = np.random.default_rng(seed)
    orders = [np.argsort(-sizes, kind="stable")]
    for spread in (0.05, 0.2, 1.0)[: POPULATION - 1]:
        orders.append(np.argsort(-sizes * (1 - spread * draw.random(len(sizes))), kind="stable"))
    return [best_fit(sizes, order, capacity) for order in orders]


def _islands(shards: DataFrame, capacity: int) -> DataFrame:
    """Evolve every island: a row with keys, sizes and (from the second round) solutions."""

    def live(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                sizes = np.asarray(row.sizes, np.int64)
                seed = [int(row.shard), int(row.island), int(row.round)]
                known = [np.asarray(p, np.int32) for p in row.solutions]
                known = known or _first_population(sizes, capacity, seed)
                out.append([p.tolist() for p in evolve(known, sizes, capacity, GENERATIONS, seed)])
            best = [_merit(np.asarray(p[0]), np.asarray(s), capacity) for p, s in zip(out, frame["sizes"], strict=True)]
            yield frame.assign(
                solutions=out, bins=[b for b, _ in best], evenness=[e for _, e in best]
            )

    schema = (
        "shard long, island int, round int, keys array<long>, sizes array<long>, "
        "solutions array<array<int>>, bins long, evenness double"
    )
    return shards.mapInPandas(live, schema)


def pack_lengths(pieces: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``_key``, ``sequence_id`` and ``offset`` for rows of ``_key`` (unique) and ``length``.

    Lengths run from 1 to ``capacity``. Every piece is placed; the number of shards follows the
    number of pieces, so the work of a task and the size of a row stay bounded.
    """
    full = pieces.where(F.col("length") >= capacity).select(
        "_key", (-1 - F.col("_key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    loose = pieces.where(F.col("length") < capacity).select("_key", "length")
    shards = max(1, -(-loose.count() // shard_pieces))
    dealt = loose.groupBy(F.pmod(F.xxhash64("_key"), F.lit(shards)).alias("shard")).agg(
        F.sort_array(F.collect_list(F.struct("_key", "length"))).alias("items")
    )
    state = dealt.select(
        "shard",
        F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
        F.lit(0).alias("round"),
        F.col("items._key").alias("keys"),
        F.col("items.length").alias("sizes"),
        F.array().cast("array<array<int>>").alias("solutions"),
        F.lit(0).cast("long").alias("bins"),
        F.lit(0.0).alias("evenness"),
    )
    tasks = min(shards * ISLANDS, 4096)
    for turn in range(ROUNDS):
        if turn:
            migrant = state.select(
                "shard",
                ((F.col("island") + 1) % ISLANDS).alias("island"),
                F.slice("solutions", 1, 1).alias("migrant"),
            )
            state = state.join(migrant, ["shard", "island"]).select(
                "shard", "island", F.lit(turn).alias("round"), "keys", "sizes",
                F.concat("solutions", "migrant").alias("solutions"), "bins", "evenness",
            )
        state = cut_lineage(_islands(state.repartition(tasks, "shard", "island"), capacity))
    best = state.groupBy("shard").agg(
        F.min_by(F.struct("keys", "sizes", "solutions"), F.struct("bins", "evenness", "island")).alias("s")
    )

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                keys, sizes = np.asarray(row.keys), np.asarray(row.sizes, np.int64)
                place = np.asarray(row.solution)
                order = np.lexsort((keys, place))
                ends = np.cumsum(sizes[order])
                first = np.searchsorted(place[order], place[order])
                offset = ends - sizes[order] - (ends - sizes[order])[first]
                yield pd.DataFrame(
                    {"_key": keys[order], "sequence_id": (int(row.shard) << 32) + place[order].astype(np.int64), "offset": offset}
                )

    chosen = best.select("shard", "s.keys", "s.sizes", F.col("s.solutions")[0].alias("solution"))
    return full.unionByName(chosen.mapInPandas(placed, "_key long, sequence_id long, offset long"))


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    end_id: int = 2,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Returns id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` and,
    on request, the piece's ``ids``. Only documents longer than ``capacity`` are cut. Null text
    is empty text and has one piece with the end id alone. Repeated rows and null ids are packed
    row by row like others; an empty table gives no rows; other columns are not read.
    """
    pieces = cut_lineage(token_pieces(docs, tokenizer, pattern, end_id, capacity, id_col, text_col, with_ids))
    placed = pack_lengths(pieces.select("_key", "length"), capacity)
    return pieces.join(placed, "_key").drop("_key")
