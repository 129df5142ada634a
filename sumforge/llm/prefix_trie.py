"""The trie of conversation prefixes: every distinct sequence of first turns once, with what its subtree holds.

A node is known by its depth and 128 bits that add up over its turns: each turn gives two hashes of its place and its
content, so that a prefix is a running sum, and a conversation can be cut anywhere. Every partition combines the
memberships it holds into a partial trie (a table of nodes: members, smallest member); partial tries are merged by node
key in two rounds, first those of one in MERGE partitions, then these. Lists of members that end in a node are merged in
blocks of ids, so nothing holds a whole list.

All nodes with the same smallest member lie below one another, as deeper nodes have fewer members: they are a chain. So
the trie is rolled up along chains, from the bottom: each chain hands its leaves and savings to the last node of every
chain above it, and running sums from the bottom of each chain do the rest. No step walks the trie level by level.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumforge.llm._shared import crc32_sql, table, written
from sumforge.operators.ranges import scanned

MERGE = 16
BLOCK_BITS = 8
KEY = ["depth", "a", "b"]
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, at, content, size): the turns of each conversation numbered from 1, with a SHA-256 of role and text and the text's bytes.

    By turn, null first, then by role and text. Null roles and texts are empty; rows without a conversation are no turns.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    content = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = rows.select("conv", "turn", "role", F.substring("text", 1, 64).alias("head"), content.alias("content"), F.octet_length("text").cast("long").alias("size"))
    found = scanned(rows, ["conv"], ["turn", "role", "head", "content"], near=[F.col("turn"), F.substring("role", 1, 16), F.substring("head", 1, 16)])
    return found.select("conv", "at", "content", "size")


def grafted(found: DataFrame, *, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Of turns(): each conversation's first h turns replaced by those of conv - conv % every; h is crc32(conv) % most.

    Gives (conv, n), the conversations with their new numbers of turns, and (conv, at, content, size), their turns. A
    conversation with fewer than h turns gives what it has, one that does not exist nothing.
    """
    counts = found.groupBy("conv").agg(F.max("at").alias("n"))
    h = (F.crc32(F.col("conv").cast("string")) % most).cast("long")
    plan = counts.select("conv", (F.col("conv") - F.col("conv") % every).alias("from"), h.alias("h"), "n")
    plan = plan.join(counts.select(F.col("conv").alias("from"), F.col("n").alias("there")), "from", "left")
    plan = written(plan.select("conv", "from", "h", "n", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")), "grafts")
    kept = found.join(plan.select("conv", "h", "taken"), "conv").where("at > h").select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "content", "size")
    heads = found.where(F.col("at") < most).select(F.col("conv").alias("from"), "at", "content", "size")
    taken = plan.where("taken > 0").select("conv", "from", "taken").join(heads, "from").where("at <= taken").select("conv", "at", "content", "size")
    return plan.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), kept.unionByName(taken)


def memberships(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv, depth, a, b, size, ends): a row for each conversation and each node that it starts with, the root included."""
    rows = rows.select("conv", F.col("at").alias("place"), F.xxhash64("at", "content").alias("a"), F.xxhash64("content", "at").alias("b"), "size")
    found = scanned(rows, ["conv"], ["place"], ["a", "b"], at="depth")
    found = found.join(convs.select("conv", "n"), "conv").select("conv", "depth", "a", "b", "size", (F.col("depth") == F.col("n")).alias("ends"))
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("size"), (F.col("n") == 0).alias("ends"))
    return written(found.unionByName(root), "memberships")


def merged(members: DataFrame) -> DataFrame:
    """Nodes (depth, a, b, conv_id, n_convs, size): partial tries of the partitions, merged by node key in two rounds."""
    part = F.spark_partition_id() % MERGE
    partial = members.groupBy(*KEY, part.alias("part")).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"))
    return partial.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("size").alias("size"))


def end_hashes(members: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes where conversations end: SHA-256 of their ids, ascending, joined by commas.

    Ids are joined in blocks of 2 ** BLOCK_BITS values, so that the list of a node reaches the task that hashes it as
    a sorted stream of short strings; it is never held as a whole.
    """
    blocks = members.where("ends").groupBy(*KEY, F.shiftright("conv", BLOCK_BITS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    blocks = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block")

    def hashed(batches):
        key, sha = None, None
        for batch in batches:
            done = []
            for *here, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if here == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = here, hashlib.sha256(ids.encode())
            yield _batch(done)
        if key is not None:
            yield _batch([(*key, sha.hexdigest())])

    def _batch(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])

    return blocks.mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def rolled_up(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (with a chain's conv_id) with parent_conv_id, n_children, n_leaves and saved_tokens."""
    saved = ((F.col("n_convs") - 1) * F.col("size")).alias("saved")
    chains = written(nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum(saved).alias("saved")), "chains")
    # the last node of each other chain on the way from the root to a chain
    way = members.select(F.col("conv").alias("chain"), *KEY).join(nodes.select(*KEY, "conv_id"), KEY).where("chain <> conv_id")
    above = way.groupBy("chain", "conv_id").agg(F.max("depth").alias("depth"))
    above = written(above.join(chains.select(F.col("conv_id").alias("chain"), "top", "saved"), "chain"), "above")
    parents = above.groupBy("chain").agg(F.max("conv_id").alias("parent"))  # the nearer to a chain, the larger the smallest member
    hangs = F.col("depth") == F.col("top") - 1
    kids = above.where(hangs).groupBy("conv_id", "depth").agg(F.count(F.lit(1)).alias("kids"))
    with_end = chains.join(kids.withColumnRenamed("depth", "bottom"), ["conv_id", "bottom"], "left")
    leaves = with_end.select(F.col("conv_id").alias("chain"), F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaf"))
    handed = above.join(leaves, "chain").groupBy("conv_id", "depth").agg(F.sum(F.when(hangs, 1).otherwise(0)).alias("kids"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("more"))
    rows = nodes.join(handed, ["conv_id", "depth"], "left").join(chains.select("conv_id", "top", "bottom"), "conv_id")
    kids, at_bottom = F.coalesce("kids", F.lit(0)), F.col("depth") == F.col("bottom")
    children = (kids + F.when(at_bottom, 0).otherwise(1)).cast("long")
    leaves = F.coalesce("leaves", F.lit(0)) + F.when(at_bottom & (kids == 0), 1).otherwise(0)
    more = (F.col("n_convs") - 1) * F.col("size") + F.coalesce("more", F.lit(0))
    rows = rows.select("conv_id", "depth", "a", "b", "n_convs", "top", children.alias("n_children"), (-F.col("depth")).alias("height"), leaves.cast("long").alias("n_leaves"), more.cast("long").alias("saved_tokens"))
    return scanned(rows, ["conv_id"], ["height"], ["n_leaves", "saved_tokens"]).join(parents.withColumnRenamed("chain", "conv_id"), "conv_id", "left")


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of the conversations convs (conv, n) with turns rows (conv, at, content, size), as op12 returns them.

    Conversations without turns end in the root; without conversations there is no node. Repeated conversations are
    members each; their order and number do not matter.
    """
    members = memberships(convs, rows)
    nodes = written(merged(members), "nodes")
    found = rolled_up(members, nodes).join(end_hashes(members), KEY, "left")
    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent"))
    return found.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of another: a row for each node."""
    return trie(*grafted(turns(table(spark, sf_dir, "conversations"))))


ORACLE_SQL = f"""
WITH own AS (
    SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, max(pos) AS n, {crc32_sql("c::VARCHAR")} % 9 AS h FROM own GROUP BY c),
plan AS (SELECT a.c, a.c - a.c % 5 AS p, a.h, a.n, least(a.h, coalesce(b.n, 0)) AS k FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 5),
built AS (
    SELECT own.c, pos - h + k AS d, r, t FROM own JOIN plan ON own.c = plan.c WHERE pos > h
    UNION ALL SELECT plan.c, pos, r, t FROM plan JOIN own ON own.c = plan.p AND pos <= k),
members AS (
    SELECT c, d, list(sha256(length(r) || ':' || r || t)) OVER (PARTITION BY c ORDER BY d) AS path, strlen(t) AS size FROM built
    UNION ALL SELECT c, 0, []::VARCHAR[], 0 FROM plan),
marked AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM members),
nodes AS (
    SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ids
    FROM marked GROUP BY path, d),
kids AS (SELECT path[:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
own_sums AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.path = nodes.path),
above AS (SELECT path[:unnest(range(d + 1))] AS path, n_children, saved FROM own_sums),
sums AS (SELECT path, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY path)
SELECT x.conv_id, x.d::BIGINT AS depth, up.conv_id AS parent_conv_id, x.n_convs, x.n_children, sums.n_leaves::BIGINT AS n_leaves, sums.saved_tokens::BIGINT AS saved_tokens, sha256(x.ids) AS ends_sha256
FROM own_sums x JOIN sums ON sums.path = x.path LEFT JOIN nodes up ON x.d > 0 AND up.path = x.path[:x.d - 1]
"""
