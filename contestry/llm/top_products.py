"""Exact top-k inner products by buckets of vectors of like length.

Candidates are put in order of length and cut into buckets. A query that needs a score of at
least t asks a bucket for a cosine of t / (its own length x the longest length there). Above one
the bucket is passed over. A high cosine leaves each coordinate a narrow range around that of the
query, and vectors outside of it for any of a few coordinates go; a low one only bounds the
length. What is left is multiplied out exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.session import cut_lineage

#: Vectors of a bucket; of a group of buckets that one task reads, and queries of a block, at most about.
BUCKET, GROUP, BLOCK = 2048, 1 << 16, 4096
#: Local cosines from which on coordinates are compared instead of lengths; how many of them.
COORDINATE_COSINE, FOCUS = 0.85, 4
#: Lengths and cosines are floating-point numbers; bounds give way by this share.
SLACK = 1e-9
PACKED = "_part long, _longest double, _width long, _ids binary, _keys binary, _values binary"
NONE = np.iinfo(np.int64).min


@dataclass
class Block:
    """Vectors side by side: ids, row keys, whole numbers and lengths, longest first."""

    ids: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    lengths: np.ndarray = field(init=False)
    _order: dict[int, tuple[np.ndarray, np.ndarray]] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        floats = self.values.astype(np.float64)
        self.lengths = np.sqrt((floats * floats).sum(axis=1))

    @classmethod
    def of(cls, width: int, ids: bytes, keys: bytes, values: bytes) -> Block:
        ids_ = np.frombuffer(ids, np.int64)
        flat = np.frombuffer(values, f"i{len(values) // max(len(ids_) * width, 1)}") if width else np.zeros(0, np.int64)
        return cls(ids_, np.frombuffer(keys, np.int64), flat.reshape(len(ids_), width))

    def packed(self, part: int) -> tuple:
        """A row of ``PACKED``, in the narrowest whole numbers that hold all values."""
        most = max(int(self.values.max(initial=0)), -1 - int(self.values.min(initial=0)))
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
        narrow = np.ascontiguousarray(self.values, kind)
        longest = float(self.lengths.max(initial=0.0))
        return part, longest, self.values.shape[1], self.ids.tobytes(), self.keys.tobytes(), narrow.tobytes()

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors in the order of their coordinate ``f`` at length one, and those coordinates."""
        if f not in self._order:
            along = self.values[:, f] / np.maximum(self.lengths, 1e-300)
            order = np.argsort(along, kind="stable")
            self._order[f] = order, along[order]
        return self._order[f]


def _products(queries: Block, some: np.ndarray, block: Block, among: np.ndarray | slice) -> np.ndarray:
    """Exact inner products; shorter vectors end in zeros. Beyond 64 bits the nearest bound."""
    width = min(queries.values.shape[1], block.values.shape[1])
    a, b = queries.values[some, :width], block.values[among, :width]
    # No partial sum is larger than the product of both lengths.
    most = queries.lengths[some].max(initial=0.0) * block.lengths[among].max(initial=0.0)
    if most < 1 << 23:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T if width else np.zeros((len(a), len(b)), object)
    return np.clip(whole, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def _focused(query: np.ndarray, cosine: float, block: Block) -> np.ndarray:
    """Vectors that may have a cosine of ``cosine`` with a query of length one, by coordinates."""
    width = min(len(query), block.values.shape[1])
    rest = np.argsort(-np.abs(query[:width]))[:FOCUS]
    kept = None
    for f in rest.tolist():
        # The other coordinates give at most the product of both their lengths; a vector may lie
        # along the axis itself where the query is as near to it as the vector to the query.
        centre, reach = query[f] * cosine, np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - query[f] * query[f])))
        low = -1.0 if query[f] <= -cosine else centre - reach - 1e-7
        high = 1.0 if query[f] >= cosine else centre + reach + 1e-7
        if kept is None:
            order, along = block.coordinate(f)
            kept = order[np.searchsorted(along, low) : np.searchsorted(along, high, side="right")]
        else:
            along = block.values[kept, f] / np.maximum(block.lengths[kept], 1e-300)
            kept = kept[(along >= low) & (along <= high)]
    return np.arange(len(block.ids)) if kept is None else np.sort(kept)


class Best:
    """The best ``k`` of each query so far, and the score that a better one needs."""

    def __init__(self, queries: Block, k: int, floor: np.ndarray):
        self.queries, self.k, self.floor = queries, k, floor.copy()
        self.rows, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        rows, scores, ids = (np.concatenate(p) for p in ((self.rows, rows), (self.scores, scores), (self.ids, ids)))
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        begin = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - begin < self.k
        self.rows, self.scores, self.ids = rows[keep], scores[keep], ids[keep]
        full = np.flatnonzero(np.bincount(self.rows, minlength=len(self.floor)) == self.k)
        last = np.searchsorted(self.rows, full, side="right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.scores[last])

    def _taken(self, some: np.ndarray, block: Block, among: np.ndarray | slice) -> None:
        scores = _products(self.queries, some, block, among)
        ids, keys = block.ids[among], block.keys[among]
        # A row is not its own partner.
        at = np.argsort(ids, kind="stable")
        low, high = (np.searchsorted(ids[at], self.queries.ids[some], side=s) for s in ("left", "right"))
        for q in np.flatnonzero(high > low).tolist():
            same = at[low[q] : high[q]]
            scores[q, same[keys[same] == self.queries.keys[some[q]]]] = NONE
        least = np.maximum(self.floor[some], NONE + 1)
        many = np.flatnonzero((scores >= least[:, None]).sum(axis=1) > self.k)
        if len(many):
            least[many] = np.partition(scores[many], -self.k, axis=1)[:, -self.k]
        q, p = np.nonzero(scores >= least[:, None])
        self.add(some[q], scores[q, p], ids[p])

    def search(self, block: Block) -> None:
        """Take in the vectors of one bucket."""
        if not len(block.ids):
            return
        longest = block.lengths[0]
        floor = self.floor.astype(np.float64)
        bounded = floor > 0
        reach = self.queries.lengths * longest
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(bounded, floor / reach * (1 - SLACK), -1.0)
        open_ = ~bounded | (cosine <= 1)
        by_coordinate = open_ & bounded & (cosine >= COORDINATE_COSINE)
        for q in np.flatnonzero(by_coordinate).tolist():
            kept = _focused(self.queries.values[q] / self.queries.lengths[q], float(cosine[q]), block)
            if len(kept):
                self._taken(np.array([q]), block, kept)
        some = np.flatnonzero(open_ & ~by_coordinate)
        if len(some):
            with np.errstate(divide="ignore", invalid="ignore"):
                shortest = np.where(bounded[some], floor[some] / self.queries.lengths[some], 0.0) * (1 - SLACK)
            ahead = int(np.searchsorted(-block.lengths, -shortest.min(), side="right"))
            if ahead:
                self._taken(some, block, slice(0, ahead))


def _rows(column: pa.Array) -> np.ndarray:
    """Lists of whole numbers as a matrix; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _packer(size: int):
    """Rows (_id, _key, _vector) of a partition as rows of ``PACKED`` with up to ``size`` vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                block = Block(
                    piece.column(0).to_numpy(), piece.column(1).to_numpy(), _rows(pa.concat_arrays([piece.column(2)]))
                )
                order = np.argsort(-block.lengths, kind="stable")
                block = Block(block.ids[order], block.keys[order], block.values[order])
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("_part", "_longest", "_width", "_ids", "_keys", "_values"), block.packed(part), strict=True))],
                    schema=pa.schema([("_part", pa.int64()), ("_longest", pa.float64()), ("_width", pa.int64()),
                                      ("_ids", pa.binary()), ("_keys", pa.binary()), ("_values", pa.binary())]),
                )

    return pack


def _packed(rows: DataFrame, parts: int, size: int) -> DataFrame:
    """Rows in order of length, in ``parts`` parts, each in blocks; equal lengths go by id."""
    length = F.aggregate("_vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    dealt = rows.withColumn("_length", length).repartitionByRange(parts, F.desc("_length"), "_id", "_key")
    dealt = dealt.sortWithinPartitions(F.desc("_length"), "_id", "_key").select("_id", "_key", "_vector")
    return cut_lineage(dealt.mapInArrow(_packer(size), PACKED))


COLUMNS = ["_width", "_ids", "_keys", "_values"]
RESULT = ["query_id", "_key", "vec_id", "score"]


def top_products(
    vectors: DataFrame,
    asked: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bucket: int = BUCKET,
    group: int = GROUP,
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` highest integer inner products of each row where ``asked`` holds with all other rows.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the smaller id.
    ``vector_col`` holds whole numbers. A vector that is null or holds a null takes no part, nor
    does a row with a null id. Rows alike in id and vector are one row; different vectors with
    one id are different rows and partners of each other. Of vectors of unlike dimension the
    shorter ends in zeros; a score beyond 64 bits is the bound it passed. An empty table gives
    no rows; other columns are read by ``asked`` alone.

    Each block of queries meets each group of buckets that its scores can still reach, once and
    as packed matrices; the first bucket of all gives every query a score to start from. A task
    holds one block and one group. What is returned per meeting is ``k`` rows a query at most.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("_id"),
        F.col(vector_col).cast("array<long>").alias("_vector"),
        F.coalesce(asked, F.lit(False)).alias("_asked"),
    )
    rows = rows.where(F.col("_id").isNotNull() & F.coalesce(~F.exists("_vector", lambda x: x.isNull()), F.lit(False)))
    rows = rows.withColumn("_key", F.xxhash64("_id", "_vector")).dropDuplicates(["_id", "_key", "_vector"])
    rows = cut_lineage(rows)
    spark = vectors.sparkSession
    counts = rows.agg(F.count("*").alias("n"), F.count_if("_asked").alias("asked")).first()
    cores = spark.sparkContext.defaultParallelism
    # Small tables still give every core a part.
    buckets = _packed(rows.select("_id", "_key", "_vector"), max(min(cores, -(-counts.n // bucket)), -(-counts.n // group), 1), bucket)
    queries = _packed(rows.where("_asked").select("_id", "_key", "_vector"), max(-(-counts.asked // block), 1), block)
    first = buckets.orderBy(F.desc("_longest"), "_part").limit(1).select(*COLUMNS).collect()
    # One bucket, whatever the size of the table.
    shared = spark.sparkContext.broadcast([tuple(r) for r in first])

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_, floors, needs = batch.select(COLUMNS).to_pylist(), [], []
            for row in rows_:
                own = Block.of(*row.values())
                best = Best(own, k, np.full(len(own.ids), NONE, np.int64))
                for packed in shared.value:
                    best.search(Block.of(*packed))
                floors.append(best.floor.tobytes())
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(best.floor > 0, best.floor / own.lengths, 0.0)
                needs.append(float(need.min(initial=np.inf)) * (1 - SLACK))
            arrays = [*(batch.column(c) for c in COLUMNS), pa.array(floors, pa.binary()), pa.array(needs, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*COLUMNS, "_floor", "_need"])

    schema = "_width long, _ids binary, _keys binary, _values binary, _floor binary, _need double"
    ready = queries.select(*COLUMNS).mapInArrow(started, schema)
    ready = cut_lineage(ready.withColumn("_block", F.monotonically_increasing_id()))
    # A block of queries asks for the groups whose longest vector its lowest score can reach.
    reach = buckets.groupBy("_part").agg(F.max("_longest").alias("_most"))
    last = buckets.agg(F.max("_part")).first()[0] or 0
    parts = F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))
    asks = ready.select("_block", "_need", F.explode(parts).alias("_part")).join(reach, "_part")
    asks = asks.where(F.col("_most") >= F.col("_need")).select("_block", "_part")
    left = asks.join(ready.drop("_need"), "_block")
    again = asks.select(F.col("_block").alias("_to"), F.col("_part").alias("_part"))
    right = again.join(buckets, "_part").withColumnRenamed("_part", "_from")

    def met(ask: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        found = []
        some = some.sort_values("_longest", ascending=False)
        for i in range(len(ask)):
            own = Block.of(*(ask[c].iat[i] for c in COLUMNS))
            best = Best(own, k, np.frombuffer(ask["_floor"].iat[i], np.int64))
            for packed in zip(*(some[c] for c in COLUMNS), strict=True):
                best.search(Block.of(*packed))
            names = {"query_id": own.ids[best.rows], "_key": own.keys[best.rows], "vec_id": best.ids, "score": best.scores}
            found.append(pd.DataFrame(names))
        return pd.concat(found) if found else pd.DataFrame({c: np.zeros(0, np.int64) for c in RESULT})

    pairs = left.groupBy("_block", "_part").cogroup(right.groupBy("_to", "_from"))
    told = pairs.applyInPandas(met, "query_id long, _key long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id", "_key").orderBy(F.desc("score"), "vec_id"))
    return told.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(vector: Column, factor: float) -> Column:
    """floor(factor x) of every component as a whole number; null for a vector with a null or
    non-finite one."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long")))
