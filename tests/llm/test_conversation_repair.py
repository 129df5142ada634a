import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from sumforge.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, none string, at string, chunk string"
OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows, faults):
    """By a heap over (cost, audit): strings of edits are grown until one is complete; the first to end is the answer."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, roles, lines = heapq.heappop(heap)
        if (k, roles[-1:], len(roles) > 0) in seen:
            continue
        seen.add((k, roles[-1:], len(roles) > 0))
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        legal = lambda r: re.fullmatch("(s?(ua)*u?)?", roles + r) is not None
        for role in ("user", "assistant"):
            if legal(role[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", k, roles + role[0], (*lines, f"{role}:")))
        if k < len(rows):
            role, text = rows[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, roles, lines))
            if faults[k] in (1, 2):
                continue
            extra = faults[k] == 3
            if role[:1] in tuple("sua") and legal(role[:1]):
                heapq.heappush(heap, (cost + extra, audit + "K", k + 1, roles + role[0], (*lines, f"{role}:{text}")))
            for new in ("user", "assistant"):
                if legal(new[0]):
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", k + 1, roles + new[0], (*lines, f"{new}:{text}")))


def report(rows):
    """rows (turn, role, text) of one conversation, after the damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        inner = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append(1 if not inner else 2 if (role, text) in seen else 3 if inner[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, lines = cheapest([r[1:] for r in rows], faults)
    return gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain(rows):
    found = {}
    for c, t, role, text in rows:
        mine = found.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(((c, *report(mine)) for c, mine in found.items()), key=str)


def repaired(spark, rows, chunk=cr.CHUNK):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)
    found = cr.repair(cr.damaged(df), df.select(*cr._key("conv_id")), chunk=chunk)
    assert found.columns == OUT
    return sorted(map(tuple, found.collect()), key=str)


def some_rows(seed, convs=60):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sa"], ["Yes.", "No!", "a", "So\n", " \t", "", None, "é?", "Ok. \n", "x.y"]
    rows = [(c, rng.choice([t, t, 2 * t, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.") for c in [None, -7, *range(convs)] for t in range(rng.randint(1, 9))]
    return rows + rng.sample(rows, 9)


@pytest.mark.parametrize("chunk", [cr.CHUNK, 2])
def test_random_conversations(spark, chunk):
    rows = some_rows(chunk)
    assert repaired(spark, rows, chunk) == plain(rows)


def test_one_long_conversation(spark):
    rng = random.Random(1)
    rows = [(3, t, rng.choice(["user", "assistant"]), f"{t % 50}.") for t in range(600)] + [(4, 0, "user", "x."), (5, 0, "assistant", "x" * 100_000 + ".")]
    assert repaired(spark, rows, 64) == plain(rows)


def test_a_table_without_rows_and_conversations_that_vanish(spark):
    assert repaired(spark, []) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", cr.EMPTY)]


def test_bucket_queue_against_all_edits():
    rng = random.Random(3)
    for _ in range(300):
        codes = [rng.randrange(12) for _ in range(rng.randrange(7))]
        rows = [("suax"[c % 4], "t") for c in codes]
        cost, audit, _ = cheapest(rows, [(0, 1, 3)[c // 4] for c in codes])
        found = cr.distances(codes, cr.GOAL)
        assert (found[0], cr.walk(codes, found, cr.GOAL, 0)[1]) == (cost, audit)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, cr.op13(spark, sf).collect()), key=str) == plain(rows)
