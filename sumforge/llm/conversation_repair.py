"""Repair of conversations at least cost: which turns to keep, give another role, delete or insert.

A repaired conversation has the roles (s?(ua)+)?. The graph has a node for each number of turns used up and each state of
that pattern, and an arc for each edit. Costs are small integers, so distances to the goal come from a bucket queue
(Dial): nodes wait in the bucket of their distance, and buckets are emptied in order. Distances are recorded; then a walk
from the start takes, of the tight arcs (those on a cheapest path), the one whose letter is least, which gives the audit.

Long conversations are cut into chunks of CHUNK turns. Each chunk gives its 4 by 4 matrix of distances from the states
before it to those behind it; of a conversation, only these matrices meet, and give the distances to the goal behind
each chunk. With them chunks are walked by themselves, from each state in which they may be entered.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumforge.llm._shared import crc32_sql, table, written
from sumforge.operators.ranges import scanned

CHUNK = 4096
KEY = ["none", "conv"]
SPACE = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()
FAR = 1 << 30

#: Costs of the edits; a truncated turn that is not deleted costs CUT more.
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: States: nothing yet, after system, after user, after assistant (the goal; nothing yet is one too). A row of another
#: state follows each by a turn that is made up or given a role.
AFTER = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: By class of a role (system, user, assistant, other): where keeping a turn leads from each state; None: it does not fit.
KEEP = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)
BEFORE = tuple([r for r in range(4) if AFTER[r] == s] for s in range(4))
KEPT_BEFORE = tuple(tuple([r for r in range(4) if KEEP[c][r] == s] for s in range(4)) for c in range(4))
GOAL = (0, FAR, FAR, 0)
LETTERS = "abcdefghijkl"
#: Pairs of neighbouring classes that are in order.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def distances(codes: list[int], goal: tuple[int, ...]) -> list[int]:
    """Least cost from each node 4 * turns used up + state to the goal, which costs goal[state] more behind the last turn.

    codes: class of the role + 4 for turns that must go, or 8 for truncated ones.
    """
    n = len(codes)
    found = [FAR] * (4 * n + 4)
    buckets: list[list[int]] = []

    def put(node: int, cost: int) -> None:
        if cost < found[node]:
            found[node] = cost
            while len(buckets) <= cost - low:
                buckets.append([])
            buckets[cost - low].append(node)

    low = min(goal)  # the first bucket
    for state in range(4):
        if goal[state] < FAR:
            put(4 * n + state, goal[state])
    at = 0
    while at < len(buckets):
        for node in buckets[at]:  # arcs of cost 0 add to the bucket while it is emptied
            cost = at + low
            if found[node] != cost:
                continue
            turn, state = divmod(node, 4)
            for before in BEFORE[state]:
                put(4 * turn + before, cost + INSERT)
            if not turn:
                continue
            turn -= 1
            put(4 * turn + state, cost + DELETE)
            kind, role = divmod(codes[turn], 4)
            if kind != 1:
                cost += CUT * (kind == 2)
                for before in KEPT_BEFORE[role][state]:
                    put(4 * turn + before, cost)
                for before in BEFORE[state]:
                    put(4 * turn + before, cost + REROLE)
        at += 1
    return found


def walk(codes: list[int], found: list[int], goal: tuple[int, ...], state: int) -> tuple[int, str]:
    """The state behind the last turn and the least letters of tight arcs from state on; at the end of all, inserts too."""
    turn, n, out = 0, len(codes), []
    while turn < n or found[4 * turn + state] != goal[state]:
        here = found[4 * turn + state]
        if turn < n and here == DELETE + found[4 * turn + 4 + state]:
            out.append("D")
            turn += 1
            continue
        after = AFTER[state]
        if here == INSERT + found[4 * turn + after]:
            out.append("I")
            state = after
            continue
        kind, role = divmod(codes[turn], 4)
        kept = KEEP[role][state]
        if kept is not None and here == CUT * (kind == 2) + found[4 * turn + 4 + kept]:
            out.append("K")
            state = kept
        else:
            out.append("R")
            state = after
        turn += 1
    return state, "".join(out)


@lru_cache(maxsize=20_000)
def matrix(codes: str) -> tuple[int, ...]:
    """Least costs through a chunk: 4 * state before it + state behind it. FAR: no way."""
    codes = [LETTERS.index(c) for c in codes]
    columns = [distances(codes, tuple(0 if s == t else FAR for s in range(4)))[:4] for t in range(4)]
    return tuple(columns[t][s] for s in range(4) for t in range(4))


@lru_cache(maxsize=20_000)
def walks(codes: str, goal: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """For each state before a chunk, the state behind it and the letters; no letters where there is no way."""
    codes = [LETTERS.index(c) for c in codes]
    found = distances(codes, goal)
    ends = [walk(codes, found, goal, s) if found[s] < FAR else (0, "") for s in range(4)]
    return tuple(e[0] for e in ends), tuple(e[1] for e in ends)


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(none, conv, turn, role, text): the rows after the damage that crc32("conv:turn") % 20 does; null texts and roles are one space.

    0 drops a row, 1 empties its text, 2 takes its . ! ? away, 3 repeats it, 4 makes its role user. none: conv is null.
    """
    named = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col,)), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), F.lit(" ")))
    kind, space = F.crc32(named) % 20, F.lit(" ")
    rows = conversations.select(*_key(conv_col), F.col(turn_col).alias("turn"), F.coalesce(role_col, space).alias("role"), F.coalesce(text_col, space).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))).select(*KEY, "turn", role.alias("role"), text.alias("text"))


def _key(conv_col: str) -> list[Column]:
    return [F.col(conv_col).isNull().alias("none"), F.coalesce(F.col(conv_col).cast("long"), F.lit(0)).alias("conv")]


def faults(laid: DataFrame) -> DataFrame:
    """(none, conv, at, turn, class, fault) of turns (none, conv, at, turn, role, text): the first fault of each, or 0.

    1 blank, 2 seen earlier in its conversation with the same role and text, 3 truncated: its last character that is not
    white space is none of . ! ?
    """
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    content = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    slim = laid.select(*KEY, "at", "turn", kind.alias("class"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), content.alias("content"))
    again = slim.groupBy(*KEY, "content").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    slim = slim.join(again, [*KEY, "content"], "left")
    return slim.select(*KEY, "at", "turn", "class", F.when(F.col("blank"), 1).when(F.col("at") > F.col("first"), 2).when(F.col("cut"), 3).otherwise(0).alias("fault"))


def chunked(found: DataFrame, chunk: int) -> DataFrame:
    """(none, conv, chunk, codes, blank, duplicate, truncated, low, high): the turns of each chunk as a string of letters."""
    kind = F.when(F.col("fault").isin(1, 2), 4).when(F.col("fault") == 3, 8).otherwise(0)
    letter = F.substring(F.lit(LETTERS), F.col("class") + kind + 1, F.lit(1))
    rows = found.select(*KEY, F.floor((F.col("at") - 1) / chunk).alias("chunk"), "at", "turn", "fault", letter.alias("letter"))
    counts = [F.sum((F.col("fault") == k).cast("long")).alias(name) for k, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))]
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "")
    return rows.groupBy(*KEY, "chunk").agg(codes.alias("codes"), *counts, F.min("turn").alias("low"), F.max("turn").alias("high"))


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """df with its rows, as tuples, made into others by a function; batch by batch."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<array<int>>": pa.list_(pa.list_(pa.int32()))}
    kinds = [types[f.split()[1]] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = list(map(function, *(c.to_pylist() for c in batch.columns)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return df.mapInArrow(run, schema)


def _through(none, conv, chunk, codes):
    roles = [LETTERS.index(c) % 4 for c in codes]
    bad = sum(pair not in LEGAL for pair in zip(roles, roles[1:], strict=False))
    return none, conv, chunk, roles[0], roles[-1], bad, matrix(codes)


def _joined(none, conv, parts):
    """Of one conversation: pairs of roles out of order, its cost, and what the goal costs behind each chunk."""
    bad = sum(p["bad"] for p in parts) + sum((a["last"], b["first"]) not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
    goal, goals = GOAL, []
    for p in reversed(parts):
        goals.append(goal)
        m = p["matrix"]
        goal = tuple(min(FAR, *(m[4 * s + t] + goal[t] for t in range(4))) for s in range(4))
    return none, conv, bad, goal[0], goals[::-1]


def _walked(none, conv, chunk, codes, goal):
    return none, conv, chunk, *walks(codes, tuple(goal))


def _entered(none, conv, parts):
    """The state before each chunk, the letters of each, and of all."""
    state, states, letters = 0, [], []
    for p in parts:
        states.append(state)
        letters.append(p["letters"][state])
        state = p["ends"][state]
    return none, conv, states, letters


def audits(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of chunked(): (none, conv, illegal, cost) and (none, conv, states, letters), with an entry for each chunk."""
    key = "none boolean, conv long"
    through = _mapped(chunks.select(*KEY, "chunk", "codes"), _through, f"{key}, chunk long, first long, last long, bad long, matrix array<int>")
    parts = F.array_sort(F.collect_list(F.struct("chunk", "first", "last", "bad", "matrix")))
    costs = written(_mapped(through.groupBy(*KEY).agg(parts.alias("parts")), _joined, f"{key}, illegal long, cost long, goals array<array<int>>"), "repair-costs")
    goals = costs.select(*KEY, F.posexplode("goals").alias("chunk", "goal")).withColumn("chunk", F.col("chunk").cast("long"))
    ways = _mapped(chunks.select(*KEY, "chunk", "codes").join(goals, [*KEY, "chunk"]), _walked, f"{key}, chunk long, ends array<int>, letters array<string>")
    parts = F.array_sort(F.collect_list(F.struct("chunk", "ends", "letters")))
    ways = _mapped(ways.groupBy(*KEY).agg(parts.alias("parts")), _entered, f"{key}, states array<int>, letters array<string>")
    return costs.drop("goals"), written(ways, "repair-ways")


def repaired(laid: DataFrame, ways: DataFrame, chunk: int) -> DataFrame:
    """(none, conv, repaired_sha256): the repaired turns as role:text, joined by line feeds, hashed as a sorted stream.

    Letters come before the first turn of their chunk, so that a task holds one batch of turns and one chunk's letters.
    """
    pieces = ways.select(*KEY, F.posexplode(F.arrays_zip("states", "letters")).alias("chunk", "way"))
    pieces = pieces.select(*KEY, (F.col("chunk") * chunk + 1).cast("long").alias("at"), F.col("way.states").alias("state"), F.lit("").alias("role"), F.col("way.letters").alias("text"))
    rows = laid.select(*KEY, "at", F.lit(None).cast("int").alias("state"), "role", "text").unionByName(pieces)
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "at", F.col("state").desc_nulls_last())

    def hashed(batches):
        key, state, letters, used, sha = None, 0, "", 0, None

        def line(role: str, text: str) -> None:
            nonlocal first
            sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False

        def made_up() -> None:
            """What is inserted before the next turn."""
            nonlocal state, used
            while used < len(letters) and letters[used] == "I":
                state, used = AFTER[state], used + 1
                line(ROLE[state], "")

        first = True
        for batch in batches:
            done = []
            for none, conv, _, begins, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begins is not None:
                    if key is not None:
                        made_up()
                    if key != (none, conv):
                        if key is not None:
                            done.append((*key, sha.hexdigest()))
                        key, sha, first = (none, conv), hashlib.sha256(), True
                    state, letters, used = begins, text, 0
                    continue
                made_up()
                letter, used = letters[used], used + 1
                if letter == "K":
                    state = KEEP["sua".index(role[0])][state]
                    line(role, text)
                elif letter == "R":
                    state = AFTER[state]
                    line(ROLE[state], text)
            yield _hashes(done)
        if key is not None:
            made_up()
            yield _hashes([(*key, sha.hexdigest())])

    return rows.mapInArrow(hashed, "none boolean, conv long, repaired_sha256 string")


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.bool_(), pa.int64(), pa.string()), strict=True)], [*KEY, "repaired_sha256"])


def repair(rows: DataFrame, ids: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """The report of op13 on conversations' rows (none, conv, turn, role, text), for all ids (none, conv).

    Turns are in the order of turn, null first, then role and text. An id without rows has zeros, an empty audit and the
    hash of an empty string; a null conversation is one of its own; without ids there are no rows.
    """
    laid = written(scanned(rows, KEY, ["turn", "role", "text"], near=[F.col("turn"), F.substring("role", 1, 16), F.substring("text", 1, 16)]), "repair-turns")
    chunks = written(chunked(faults(laid), chunk), "repair-chunks")
    distinct = laid.where("turn IS NOT NULL").groupBy(*KEY, "turn").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.count("one").alias("distinct"))
    counts = chunks.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.min("low").alias("low"), F.max("high").alias("high"))
    costs, ways = audits(chunks)
    found = ids.distinct()
    for part in (counts, distinct, costs, ways.select(*KEY, F.array_join("letters", "").alias("audit")), repaired(laid, ways, chunk)):
        found = found.join(part, KEY, "left")
    zero = F.lit(0).cast("long")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), zero)
    numbers = [F.coalesce(F.col(c), zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.when(F.col("none"), None).otherwise(F.col("conv")).alias("conv_id"), gaps.alias("gaps"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of all conversations, each damaged first: a row for each original conv_id."""
    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations.select(*_key("conv_id")))


#: Edits row by row: for each state the cheapest letters so far, least first; before each row and at the end up to two inserts.
ORACLE_SQL = f"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
hurt AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM named WHERE kind <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM hurt),
judged AS (
    SELECT *, CASE WHEN core = '' THEN 1 WHEN pos > first THEN 2 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
    FROM (SELECT *, rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS core, min(pos) OVER (PARTITION BY conv_id, role, text) AS first, role[1] AS i, lead(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS next FROM placed)),
arcs(state, letters, cost, goes, i) AS (VALUES
    (0, 'D', 3, 0, NULL), (1, 'D', 3, 1, NULL), (2, 'D', 3, 2, NULL), (3, 'D', 3, 3, NULL),
    (0, 'K', 0, 1, 's'), (0, 'K', 0, 2, 'u'), (1, 'K', 0, 2, 'u'), (3, 'K', 0, 2, 'u'), (2, 'K', 0, 3, 'a'),
    (0, 'R', 2, 2, NULL), (1, 'R', 2, 2, NULL), (2, 'R', 2, 3, NULL), (3, 'R', 2, 2, NULL)),
inserts(state, letters, cost, goes) AS (VALUES
    (0, '', 0, 0), (1, '', 0, 1), (2, '', 0, 2), (3, '', 0, 3), (0, 'I', 2, 2), (1, 'I', 2, 2), (2, 'I', 2, 3), (3, 'I', 2, 2),
    (0, 'II', 4, 3), (1, 'II', 4, 3), (2, 'II', 4, 2), (3, 'II', 4, 3)),
best AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, 0 AS cost, '' AS audit FROM judged
    UNION ALL
    SELECT conv_id, pos, state, cost, audit FROM (
        SELECT b.conv_id, j.pos, arcs.goes AS state, b.cost + inserts.cost + arcs.cost + CASE WHEN j.fault = 3 AND arcs.letters <> 'D' THEN 1 ELSE 0 END AS cost, b.audit || inserts.letters || arcs.letters AS audit
        FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.pos = b.pos + 1 JOIN inserts ON inserts.state = b.state
        JOIN arcs ON arcs.state = inserts.goes AND (arcs.i IS NULL OR arcs.i = j.i) AND (arcs.letters = 'D' OR j.fault NOT IN (1, 2)))
    QUALIFY row_number() OVER (PARTITION BY conv_id, pos, state ORDER BY cost, audit) = 1),
ended AS (
    SELECT b.conv_id, b.cost + inserts.cost AS cost, b.audit || inserts.letters AS audit
    FROM best b JOIN (SELECT conv_id, max(pos) AS n FROM judged GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.n = b.pos JOIN inserts ON inserts.state = b.state
    WHERE inserts.goes IN (0, 3) QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + inserts.cost, b.audit || inserts.letters) = 1),
letters AS (SELECT conv_id, k, audit[k] AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM ended)),
used AS (SELECT *, sum((letter <> 'I')::BIGINT) OVER (PARTITION BY conv_id ORDER BY k) AS pos FROM letters),
kept AS (
    SELECT u.conv_id, u.k, u.letter, j.role, CASE WHEN u.letter = 'I' THEN '' ELSE j.text END AS text, j.i, row_number() OVER (PARTITION BY u.conv_id ORDER BY u.k) AS o
    FROM used u LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM u.conv_id AND j.pos = u.pos WHERE u.letter <> 'D'),
lines AS (
    SELECT conv_id, o, CASE WHEN letter = 'K' THEN role WHEN (o - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text AS line
    FROM (SELECT *, max((o = 1 AND letter = 'K' AND i = 's')::BIGINT) OVER (PARTITION BY conv_id) AS system FROM kept)),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY o) AS text FROM lines GROUP BY conv_id),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (next IS NOT NULL AND i || next NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(texts.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
