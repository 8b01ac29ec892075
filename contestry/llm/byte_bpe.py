"""Byte-level BPE through a sentencepiece model serialised straight from a rank vocabulary.

Every byte stands for one character, so any token is an ordinary piece of text. The model
holds all pieces, each with minus its rank as score, and normalises nothing: sentencepiece
then merges the best-scored neighbouring pair first, leftmost on a tie, which is merging by
rank. Pre-tokens are encoded one by one; decoding joins the bytes of the pieces.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from contestry.llm.common import texts_of

#: Encoded pre-tokens that a Python worker remembers; when full it starts anew, which changes no result.
REMEMBERED = 500_000
BYTE_BASE = 0x100


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


#: Byte b is the character BYTE_BASE + b: letters, none of them white space.
TO_PIECE = {b: chr(BYTE_BASE + b) for b in range(256)}


def as_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(TO_PIECE)


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece number rank + 1 is the token, piece 0 is unknown.

    Ranks must run from 0 without gaps. The fields are those of the public model format.
    """
    ordered = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    out = [_block(1, _block(1, "⁇unk⁇".encode()) + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))]
    for token in ordered:
        score = b"\x15" + struct.pack("<f", -float(ranks[token]))
        out.append(_block(1, _block(1, as_piece(token).encode()) + score + _number(3, 1)))
    trainer = _number(3, 2) + _number(4, len(ordered) + 1) + _number(40, 0)
    for absent in (41, 42, 43):  # no begin, end or padding piece
        trainer += _varint(absent << 3) + b"\xff" * 9 + b"\x01"
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join([*out, _block(2, trainer), _block(3, normalizer)])


class WordMemory:
    """Ids of whole texts from the ids of their pre-tokens, each encoded once and remembered.

    ``encode`` takes a list of pre-tokens and returns for each its ids as little-endian unsigned
    32-bit integers. Only pre-tokens are remembered, up to REMEMBERED, besides those of one text.
    """

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]]):
        self.split, self.encode, self.known = split, encode, {}

    def ids(self, text: str) -> bytes:
        words = self.split(text)
        known = self.known
        missing = set(words).difference(known)
        if missing:
            if len(known) + len(missing) > REMEMBERED:
                known.clear()
                missing = set(words)
            fresh = list(missing)
            known.update(zip(fresh, self.encode(fresh), strict=True))
        return b"".join([known[w] for w in words])


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes | None = None):
        import sentencepiece

        self.ranks = ranks
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model or serialize_model(ranks))
        self.tokens = sorted(ranks, key=ranks.get)
        self.encode_bytes = WordMemory(regex.compile(pattern).findall, self._encode_words).ids

    def _encode_words(self, words: list[str]) -> list[bytes]:
        raw = [word.encode() for word in words]
        encoded = self.pieces.encode([as_piece(w) for w in raw], num_threads=1)
        # A pre-token that is itself a token is that token, reachable by merges or not.
        return [
            struct.pack("<I", self.ranks[word])
            if word in self.ranks
            else (np.asarray(ids, "<u4") - np.uint32(1)).tobytes()
            for word, ids in zip(raw, encoded, strict=True)
        ]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the text that ``ids`` (little-endian) stand for."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode_documents(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per document: id, ``n_tokens``, digests of ids and decoded bytes, and the ids.

    Null text is empty text: no token and the digests of the empty string. Empty tables give no
    rows; repeated rows and null ids are encoded like any other; other columns are not read.
    The driver reads the vocabulary file and sends the model, of vocabulary size, to the tasks.
    No shuffle: each task streams through its documents.
    """
    spark = docs.sparkSession
    ranks = read_ranks(vocabulary)
    shared = spark.sparkContext.broadcast((ranks, serialize_model(ranks)))
    fields = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, model = shared.value
        bpe = ByteBpe(ranks, pattern, model)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode_bytes(text)
                digest = hashlib.sha256(ids).hexdigest()
                row = [len(ids) // 4, digest, hashlib.sha256(bpe.decode(ids)).hexdigest()]
                rows.append([*row, np.frombuffer(ids, "<u4")] if with_ids else row)
            columns = list(zip(*rows, strict=True)) or [[]] * (4 if with_ids else 3)
            arrays = [batch.column(0), pa.array(columns[0], pa.int64())]
            arrays += [pa.array(columns[i], pa.string()) for i in (1, 2)]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(columns[3], pa.list_(pa.int64())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = fields + (", token_ids array<long>" if with_ids else "")
    return texts_of(docs, id_col, text_col).mapInArrow(encoded, schema)


def decode_documents(
    tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "token_ids"
) -> DataFrame:
    """Id and ``decoded`` (binary) by inverse mapping; null ids decode to the empty string."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(sorted((r := read_ranks(vocabulary)), key=r.get))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            texts = [b"".join([table[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary())], names=[id_col, "decoded"]
            )

    return tokens.select(id_col, ids_col).mapInArrow(decoded, f"`{id_col}` long, decoded binary")
