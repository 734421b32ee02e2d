"""The trie against plain sets of prefixes, on copies, ties, nulls, long and empty conversations."""

import hashlib
import random
import zlib

import pytest

from millrace.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def _rebuilt(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), role, hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(r, x) for _, r, _, x in sorted(t)] for c, t in turns.items()}
    out = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - c % 100 if c >= 0 else -(-c - -c % 100)
        out[c] = tuple(own.get(base, [])[:h] + path[h:])
    return out


def _expected(paths):
    members = {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(conv)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = leaves.get(node, 0) + (node not in children)
        saved[node] = saved.get(node, 0) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        if node:
            up = node[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[node]
            saved[up] = saved.get(up, 0) + saved[node]
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if paths[c] == node)
        upper = min(members[node[:-1]]) if node else None
        out.append((
            min(convs), len(node), upper, len(convs), children.get(node, 0), leaves[node], saved[node],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def _some(seed, n, same=0):
    """Conversations that share beginnings, many of them one and the same."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        depth = 4 if c % 3 == 0 and same else rng.randrange(1, 8)
        for turn in range(depth):
            word = "é😀" if c % 3 == 0 and same else f"t{rng.randrange(3)}" * rng.randrange(1, 3)
            rows.append((c, turn, ("user", "assistant")[turn % 2], word))
    return rows


CASES = {
    "shared": _some(1, 250),
    "one conversation in a third": _some(2, 300, same=1),
    "nulls and ties": [
        (1, None, None, None), (1, 0, "a", "x"), (1, 0, "a", "y"), (1, 0, "a", "y"), (2, 3, None, "x"), (2, 3, "", "x"),
        (None, 0, "a", "x"), (-5, 1, "u", "x"), (-105, 1, "u", "x"), (-100, 0, "u", "y"), (100, 0, "a", ""), (101, 7, "a", ""),
    ],
    "base without turns left": [(c, t, "u", "v") for c in (200, 203, 207, 299, 301) for t in range(1 + c % 2)],
    "long": [(7, t, "u", str(t % 5)) for t in range(3000)] + [(8, t, "u", str(t % 5)) for t in range(2900)],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("shards", ["1", "7", "40"])
def test_against_sets_of_prefixes(spark, case, shards, monkeypatch):
    rows = CASES[case]
    if case == "long" and shards != "7":
        pytest.skip("one number of shards is enough")
    # Short skeletons, small chunks: all ways of combining parts are taken.
    monkeypatch.setattr(prefix_trie, "SKELETON_NODES", 100)
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        table = spark.createDataFrame(rows, SCHEMA).withColumn("path", prefix_trie.F.lit("extra")).repartition(3)
        found = [tuple(r) for r in prefix_trie.report(table).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(found, key=str) == _expected(_rebuilt(rows))


def test_texts_of_nodes(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, None, "c")]
    table = spark.createDataFrame(rows, SCHEMA)
    found = prefix_trie.with_texts(prefix_trie.nodes(prefix_trie.conversation_turns(table)), table)
    got = {(r["conv_id"], r["depth"]): (r["role"], r["text"], r["n_convs"]) for r in found.collect()}
    assert got == {(1, 0): (None, None, 2), (1, 1): ("user", "a", 2), (1, 2): ("bot", "b", 1), (2, 2): ("", "c", 1)}
