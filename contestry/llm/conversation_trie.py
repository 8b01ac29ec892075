"""Prefix tree of conversations, as double-array tries over ranges of the sorted conversations.

Conversations become sequences of turn codes; equal ones are one row. In the order of their
codes they are cut into ranges, so a range holds whole subtrees but for the nodes on the paths
to its first and last sequence. Each range packs its trie into BASE and CHECK arrays over turn
numbers of its own and returns a row for each node; nodes on those two paths come as parts and
are merged over all ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.session import cut_lineage

#: Bytes of a turn's code: a digest of role and text, then the code points of the text.
DIGEST, CODE = 16, 20
#: Sequences, and bytes of them, that one range holds, about.
SHARD_ROWS, SHARD_BYTES = 20_000, 1 << 23
#: Ids of conversations that are joined into one piece before the pieces of a node meet.
PIECE = 4096
#: Free places that a node with several children is tried at before it goes behind the last one.
PLACES = 16
NOBODY = hashlib.sha256().hexdigest()


def turn_sequences(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id`` and ``codes``: the turns of each conversation in order, as codes of 20 bytes.

    Null turn numbers come first, equal ones go by the code; null roles and texts are empty.
    Repeated rows are turns of their own; rows without a conversation are left out. One
    conversation is one row, 20 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    code = F.unhex(F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0")))
    own = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("_turn"), code.alias("_code"))
    listed = F.sort_array(F.collect_list(F.struct("_turn", "_code")))
    grouped = own.where("conv_id IS NOT NULL").groupBy("conv_id").agg(listed.alias("_turns"))
    return grouped.select("conv_id", F.transform("_turns", lambda t: t["_code"]).alias("codes"))


def with_heads(sequences: DataFrame, base: Column, count: Column, most: int) -> DataFrame:
    """Every conversation with its first ``count`` turns replaced by those of conversation ``base``.

    ``most`` bounds ``count``. A ``base`` with fewer turns gives what it has, an absent one none.
    """
    whole = cut_lineage(sequences)
    heads = whole.select(F.col("conv_id").alias("_base"), F.slice("codes", 1, most).alias("_head"))
    asked = whole.select("conv_id", "codes", base.alias("_base"), count.cast("int").alias("_count"))
    # Only heads that anyone asks for are carried.
    wanted = heads.join(asked.select("_base").distinct(), "_base", "left_semi")
    joined = asked.join(wanted, "_base", "left")
    head = F.slice(F.coalesce("_head", F.array().cast("array<binary>")), F.lit(1), F.col("_count"))
    tail = F.slice("codes", F.col("_count") + 1, F.greatest(F.size("codes") - F.col("_count"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, tail).alias("codes"))


class DoubleArray:
    """A static trie in two arrays: a child by code c of slot s is slot BASE[s] + c, if CHECK
    there is s. Slots are numbered as they are free; 0 is the root."""

    def __init__(self, sequences: list[bytes]):
        """``sequences``: different strings of codes, sorted."""
        self.base, self.check = [0], [0]
        self.depth, self.size = [0], [0]
        self.made = [0]
        self.number: dict[bytes, int] = {}
        self._free = 1
        open_ = [(0, 0, len(sequences))] if sequences else []
        while open_:
            slot, low, high = open_.pop()
            at = self.depth[slot] * CODE
            if low < high and len(sequences[low]) == at:  # ends here
                low += 1
            groups, last = [], None
            for i in range(low, high):
                code = sequences[i][at : at + CODE]
                if code != last:
                    groups.append((self.number.setdefault(code, len(self.number)), i))
                    last = code
            if not groups:
                continue
            self._place(slot, [c for c, _ in groups])
            for k, (code, first) in enumerate(groups):
                child = self.base[slot] + code
                self.size[child] = int.from_bytes(sequences[first][at + DIGEST : at + CODE], "big")
                open_.append((child, first, groups[k + 1][1] if k + 1 < len(groups) else high))

    def _place(self, slot: int, codes: list[int]) -> None:
        check, least = self.check, min(codes)
        while self._free < len(check) and check[self._free] >= 0:
            self._free += 1
        at = self._free
        if len(codes) > 1:
            for _ in range(PLACES):
                base = at - least
                if base >= 0 and all(base + c >= len(check) or check[base + c] < 0 for c in codes):
                    break
                at += 1
                while at < len(check) and check[at] >= 0:
                    at += 1
            else:
                at = max(len(check), least)
        base = at - least
        more = base + max(codes) + 1 - len(check)
        if more > 0:
            check += [-1] * more
            for column in (self.base, self.depth, self.size):
                column += [0] * more
        self.base[slot] = base
        for c in codes:
            check[base + c] = slot
            self.depth[base + c] = self.depth[slot] + 1
            self.made.append(base + c)

    def path(self, sequence: bytes) -> list[int]:
        """The slots from the root on to the node of ``sequence``."""
        slots = [0]
        for at in range(0, len(sequence), CODE):
            slot = self.base[slots[-1]] + self.number[sequence[at : at + CODE]]
            if not 0 < slot < len(self.check) or self.check[slot] != slots[-1]:
                raise KeyError(sequence)
            slots.append(slot)
        return slots


NODE = (
    "shard long, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, size long, ends string"
)
KINDS = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
FIELDS = pa.schema([(name, KINDS[kind]) for name, kind in (f.split() for f in NODE.split(", "))])


def shard_nodes(shard: int, sequences: list[bytes], counts: list[int], first: list[int], ends: list[str]) -> pa.RecordBatch:
    """The nodes of one range: whole ones, and with ``key`` the parts of those on its edges.

    A part counts only the children, leaves and tokens of whole nodes directly below it.
    """
    trie = DoubleArray(sequences)
    width = len(trie.check)
    convs, least, children, leaves, saved = ([0] * width for _ in range(5))
    ended: dict[int, str] = {}
    edge: dict[int, bytes] = {}
    for i, sequence in enumerate(sequences):
        path = trie.path(sequence)
        convs[path[-1]], least[path[-1]], ended[path[-1]] = counts[i], first[i], ends[i]
        if i in (0, len(sequences) - 1):
            edge |= {s: hashlib.md5(sequence[: d * CODE]).digest() for d, s in enumerate(path)}
    for slot in reversed(trie.made):
        if slot not in edge:
            leaves[slot] += not children[slot]
            saved[slot] += (convs[slot] - 1) * trie.size[slot]
        if slot:
            up = trie.check[slot]
            least[up] = min(least[up], least[slot]) if convs[up] else least[slot]
            convs[up] += convs[slot]
            if slot not in edge:
                children[up] += 1
                leaves[up] += leaves[slot]
                saved[up] += saved[slot]
    slots = trie.made
    parents = [trie.check[s] if s else None for s in slots]
    columns = {
        "shard": [shard] * len(slots),
        "key": [edge.get(s) for s in slots],
        "parent_key": [edge.get(p) for p in parents],
        "conv_id": [least[s] for s in slots],
        "depth": [trie.depth[s] for s in slots],
        "parent_conv_id": [None if p is None or p in edge else least[p] for p in parents],
        "n_convs": [convs[s] for s in slots],
        "n_children": [children[s] for s in slots],
        "n_leaves": [leaves[s] for s in slots],
        "saved_tokens": [saved[s] for s in slots],
        "size": [trie.size[s] for s in slots],
        "ends": [ended.get(s) for s in slots],
    }
    return pa.RecordBatch.from_pydict(columns, schema=FIELDS)


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """``seq`` (all codes in a row), ``n``, ``first`` and ``ends``: how many conversations are that
    sequence, the smallest id and a digest of all ids, ascending and joined by commas.

    Ids are joined in pieces of neighbouring ids while they are grouped, so a sequence that a
    third of all conversations share is a few pieces; its digest reads them one after another.
    """
    flat = F.unhex(F.array_join(F.transform("codes", lambda c: F.hex(c)), ""))
    rows = sequences.select("conv_id", flat.alias("seq"), F.floor(F.col("conv_id") / PIECE).alias("_piece"))
    pieces = rows.groupBy("seq", "_piece").agg(
        F.count("*").alias("n"),
        F.min("conv_id").alias("first"),
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("_ids"),
    )
    dealt = pieces.repartition("seq").sortWithinPartitions("seq", "_piece").select("seq", "n", "first", "_ids")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("seq", pa.binary()), ("n", pa.int64()), ("first", pa.int64()), ("ends", pa.string())])
        seq = digest = None
        n = first = 0
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] == seq:
                    n += row[1]
                    digest.update(b"," + row[3].encode())
                    continue
                if digest:
                    out.append({"seq": seq, "n": n, "first": first, "ends": digest.hexdigest()})
                seq, n, first, digest = row[0], row[1], row[2], hashlib.sha256(row[3].encode())
            yield pa.RecordBatch.from_pylist(out, schema=kind)
        if digest:
            yield pa.RecordBatch.from_pylist([{"seq": seq, "n": n, "first": first, "ends": digest.hexdigest()}], schema=kind)

    return dealt.mapInArrow(digested, "seq binary, n long, first long, ends string")


def subtree_sums(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """``nodes`` (``key``, ``parent_key``, ``columns``) with each column summed over the subtree.

    Pointers double: after k rounds a node has the sums of all nodes less than 2^k below it.
    """
    nodes = cut_lineage(nodes.withColumn("_up", F.col("parent_key")))
    while not nodes.where("_up IS NOT NULL").isEmpty():
        below = nodes.where("_up IS NOT NULL").groupBy(F.col("_up").alias("_to"))
        below = below.agg(*(F.sum(c).alias(f"_{c}") for c in columns))
        onward = nodes.select(F.col("key").alias("_at"), F.col("_up").alias("_next"))
        joined = nodes.join(below, nodes["key"] == below["_to"], "left").join(onward, F.col("_up") == F.col("_at"), "left")
        summed = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns]
        rest = [c for c in nodes.columns if c not in (*columns, "_up")]
        nodes = cut_lineage(joined.select(*rest, *summed, F.col("_next").alias("_up")))
    return nodes.drop("_up")


def prefix_trie(sequences: DataFrame, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per node of the prefix tree of ``conv_id``, ``codes``.

    A node is a different sequence of first turns; its members are the conversations that start
    with it. ``conv_id`` is the smallest member, ``parent_conv_id`` that of the node one turn
    shorter (null for the root), then ``depth``, ``n_convs``, ``n_children``, ``n_leaves`` (childless
    nodes in its subtree, itself included), ``saved_tokens`` (over its subtree, members but one
    times the code points of the last text) and ``ends_sha256`` (digest of the ids of members
    that end there, ascending, joined by commas). Conversations without turns are members of
    the root. No conversation at all gives no rows. Ids are unique; none is null.

    The ranges are even whatever prefix is frequent, as equal sequences are one row. The nodes
    on their edges are as many as the ranges are and as deep as the conversations.
    """
    rows = cut_lineage(distinct_sequences(sequences))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bytes")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # Small tables still give every core a range.
    shards = max(-(-total.n // shard_rows), -(-total.bytes // shard_bytes), min(cores, -(-total.n // 500)), 1)
    dealt = rows.repartitionByRange(shards, "seq").sortWithinPartitions("seq")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [[], [], [], []]
        for batch in batches:
            for column, values in zip(whole, batch.columns, strict=True):
                column += values.to_pylist()
        if whole[0]:
            yield shard_nodes(TaskContext.get().partitionId(), *whole)

    nodes = cut_lineage(dealt.select("seq", "n", "first", "ends").mapInArrow(packed, NODE))
    parts, done = nodes.where("key IS NOT NULL"), nodes.where("key IS NULL")
    merged = parts.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"),
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.first("size").alias("size"),
        F.max("ends").alias("ends"),
    )
    merged = cut_lineage(merged)
    # Children on an edge are counted once, however many ranges share them.
    more = merged.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("_more"))
    merged = merged.join(more, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0)))
    own = merged.drop("_more").withColumns(
        {
            "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"),
            "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"),
        }
    )
    summed = subtree_sums(own, ["n_leaves", "saved_tokens"])
    names = summed.select(F.col("key").alias("_key"), F.col("conv_id").alias("_conv"))
    upper = summed.join(names, F.col("parent_key") == F.col("_key"), "left").withColumn("parent_conv_id", F.col("_conv"))
    # Nodes right below an edge get its name from their own range's list, so no edge is a hot key.
    listed = parts.select(F.col("shard").alias("_shard"), F.col("key").alias("_key")).join(names, "_key")
    below = done.where("parent_key IS NOT NULL")
    below = below.join(listed, (F.col("shard") == F.col("_shard")) & (F.col("parent_key") == F.col("_key")))
    below = below.withColumn("parent_conv_id", F.col("_conv"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    every = done.where("parent_key IS NULL").select(columns).unionByName(below.select(columns)).unionByName(upper.select(columns))
    return every.withColumn("ends_sha256", F.coalesce("ends", F.lit(NOBODY))).drop("ends")
