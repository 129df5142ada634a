import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sumforge.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a string, at string"


def plain(rows):
    """Every node by following every prefix."""
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(found)] for c, found in convs.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(c - rest, [])[:h] + mine[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        inner = {p[:-1] for p in below if p}
        ends = sorted(c for c in convs if built[c] == path)
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), sum(p != () and p[:-1] == path for p in below), sum(p not in inner for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie(spark, rows, partitions=5):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(partitions)
    got = prefix_trie.trie(*prefix_trie.grafted(prefix_trie.turns(df)))
    return sorted((tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_random_conversations(spark):
    import random

    rng = random.Random(5)
    rows = []
    for c in range(-12, 60):
        for t in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bé", "c", "", None])))
    rows += rng.sample(rows, 20) + [(None, 0, "user", "a")]
    rows += [(c, t, "user", "same") for c in range(1000, 1400) for t in range(3)]
    assert trie(spark, rows) == plain(rows)


def test_one_conversation_with_many_turns(spark):
    rows = [(5, t, "user", f"t{t % 7}") for t in range(700)] + [(6, t, "user", f"t{t % 7}") for t in range(350)] + [(7, 0, "user", "x")]
    assert trie(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert trie(spark, []) == []


def test_long_lists_of_ends(spark, monkeypatch):
    rows = [(c, 0, "user", "x") for c in range(0, 3000)]
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 3)
    assert trie(spark, rows) == plain(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = prefix_trie.op12(spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
    assert got.where(F.col("depth") == 0).count() == 1
