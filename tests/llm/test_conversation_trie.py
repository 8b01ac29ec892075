"""Nodes of the prefix tree against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from contestry.llm.conversation_trie import CODE, DoubleArray, prefix_trie, turn_sequences
from contestry.llm.queries import op12_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, codes string, key int"


def nodes_of(conversations):
    """{conv_id: [(role, text), ...]} -> sorted node rows."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def totals(node):
        leaves, saved = (0, 0) if node in children else (1, 0)
        saved += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        for child in children.get(node, ()):
            more = totals(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(conversations[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, ())),
                    *totals(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def ordered(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}


def rebuilt(rows):
    own = ordered(rows)
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return out


def random_rows(draw, n, spread=7):
    rows = []
    for _ in range(n):
        c = draw.randrange(600)
        if any(r[0] == c for r in rows):
            continue
        turns = draw.randrange(1, 9)
        rows += [(c, t if t else draw.choice([0, None]), draw.choice(["user", None, "a"]), "ä" * draw.randrange(spread), "x", 1)
                 for t in range(turns)]
    draw.shuffle(rows)
    return rows


def found(df, **sizes):
    return sorted((tuple(r) for r in prefix_trie(turn_sequences(df), **sizes).collect()), key=repr)


@pytest.mark.parametrize("shard_rows", [3, 40, 20_000])
def test_equal_to_all_prefixes(spark, shard_rows):
    rows = random_rows(random.Random(2), 150, spread=2)
    rows += [(1000 + i, t, "user", "same", "", 0) for i in range(60) for t in range(3)]  # copies of one conversation
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(df, shard_rows=shard_rows) == nodes_of(ordered(rows))


def test_query_on_rebuilt_conversations(spark, tmp_path):
    rows = [r for r in random_rows(random.Random(9), 260) if r[0] != 300]  # a base that is absent
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in op12_conversation_trie(spark, str(tmp_path)).collect()), key=repr)
    want = nodes_of(rebuilt(rows))
    assert got == want
    assert any(len(t) == 0 for t in rebuilt(rows).values())  # turnless ones are members of the root


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x", "", 0), (1, None, None, None, None, None), (1, None, None, None, None, None), (2, 0, "ab", "c", "", 0),
            (3, 0, "a", "bc", "", 0), (4, 0, "", "abc", "", 0), (-5, 0, "a", "bc", "", 0), (6, 7, "a", "bc", "", 0)]
    rows += [(7, t, "u", "long " * 50, "", 0) for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == nodes_of(ordered(rows))
    assert found(df.limit(0)) == []


def test_double_array_holds_each_path_alone():
    draw = random.Random(4)
    codes = [bytes([i]) * 16 + i.to_bytes(4, "big") for i in range(30)]
    texts = sorted({b"".join(draw.choice(codes) for _ in range(draw.randrange(6))) for _ in range(400)})
    trie = DoubleArray(texts)
    prefixes = {t[:d] for t in texts for d in range(0, len(t) + 1, CODE)}
    assert len(trie.made) == len(set(trie.made)) == len(prefixes)
    assert len({trie.path(p)[-1] for p in prefixes}) == len(prefixes)
    with pytest.raises(KeyError):
        trie.path(texts[-1] + codes[0] * 9)
