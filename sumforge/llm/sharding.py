"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts are a group, and a group's demand is its share of all bytes, tokens and rows. Each group goes to
the shard where the dot product of its demand with the residual capacity is highest. Groups of many rows or bytes are
cut into parts first; the few parts that are large are placed on the driver, where their number is bounded by the
threshold that makes them large. The rest is dealt into blocks by digest; each block packs its own groups, largest
first, into its share of what the large parts have left, so that blocks need not know of each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sumforge.llm._shared import table, written

SHARDS = 16
#: A group is large, and placed on the driver, from this share of one shard's capacity on: so at most 3 * SHARDS / LARGE are.
LARGE = 1 / 64
#: A group is cut into parts of at most this share of one shard's capacity.
CUT = 1 / 8
#: Weights of bytes, tokens and rows in the dot product; the law is that of bytes.
WEIGHTS = (10.0, 1.0, 1.0)
#: Groups of a block, on average.
BLOCK_GROUPS = 20_000


def place(demand: np.ndarray, residual: np.ndarray, weights: tuple[float, ...] | None = None) -> np.ndarray:
    """The bin of each demand (rows: items, in the order given; columns: resources); residual (bins x resources) shrinks.

    The bin with the highest dot product of weighted demand and residual capacity is taken, the lowest of equal ones;
    without weights, all resources count alike.
    """
    weighted = demand if weights is None else demand * np.array(weights)
    out = np.empty(len(demand), np.int32)
    for k, want in enumerate(demand):
        at = out[k] = int((residual @ weighted[k]).argmax())
        residual[at] -= want
    return out


def _largest_first(demand: np.ndarray) -> np.ndarray:
    return np.argsort(-demand.max(axis=1), kind="stable")


def assign(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, large: float = LARGE, cut: float = CUT, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """(doc_id, size, text_crc32, shard) of every row; shards nearly equal in bytes, in tokens (words) and in rows.

    size is the UTF-8 bytes of the text plus 1; a null text has none. Equal texts share a shard, but for groups above
    cut times a shard's capacity, which are cut into parts. Repeated rows are rows of their own; null ids are placed
    like others. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.size(F.array_remove(F.split(text, "[ \\t-\\r]+"), ""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), words.cast("long").alias("words"), F.sha2(text, 256).alias("digest"))
    rows = written(rows, "sharding-rows")
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.sum("words").alias("words"))
    groups = written(groups, "sharding-groups")
    n_groups, *totals = groups.agg(F.count(F.lit(1)), F.sum("bytes"), F.sum("words"), F.sum("rows")).first()
    totals = [max(1, t or 0) for t in totals]
    share = F.greatest(*(F.col(c) / F.lit(t) for c, t in zip(("bytes", "words", "rows"), totals, strict=True)))
    # at most 3 * shards / large groups can be that large
    limit = large / shards
    heavy = groups.withColumn("share", share).where(F.col("share") > limit)
    heavy = heavy.withColumn("parts", F.least(F.ceil(F.col("share") * shards / cut), F.col("rows")).cast("int")).select("digest", "parts").toPandas()
    residual = np.full((shards, 3), 1 / shards)
    spark = rows.sparkSession
    placed_heavy = spark.createDataFrame([], "digest string, part int, shard int, parts int")
    salt = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts").cast("long")).cast("int")
    if len(heavy):
        known = F.broadcast(spark.createDataFrame(heavy))
        parts = rows.join(known, "digest").withColumn("part", salt).groupBy("digest", "part", "parts").agg(F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows"))
        parts = parts.toPandas().sort_values(["digest", "part"], ignore_index=True)
        demand = parts[["bytes", "words", "rows"]].to_numpy(float) / totals
        order = _largest_first(demand)
        parts.loc[order, "shard"] = place(demand[order], residual, WEIGHTS)
        parts["shard"] = parts["shard"].astype(int)
        placed_heavy = spark.createDataFrame(parts[["digest", "part", "shard", "parts"]], placed_heavy.schema)
    blocks = max(1, -(-(n_groups - len(heavy)) // block_groups))
    light = groups.where(F.coalesce(share <= limit, F.lit(False)))
    block = F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("int")
    left = np.maximum(residual, 0)
    left = left / np.maximum(left.sum(axis=0), 1e-300)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("digest", ignore_index=True)
        demand = pdf[["bytes", "words", "rows"]].to_numpy(float)
        demand /= np.maximum(demand.sum(axis=0), 1)
        order = _largest_first(demand)
        at = np.empty(len(pdf), np.int32)
        at[order] = place(demand[order], left.copy(), WEIGHTS)
        return pd.DataFrame({"digest": pdf["digest"], "shard": at})

    light = light.select("digest", "bytes", "words", "rows", block.alias("block")).groupBy("block").applyInPandas(pack, "digest string, shard int")
    # the rows of large groups, which the broadcast list names, stay where they are
    others = rows.join(known, "digest", "left_anti") if len(heavy) else rows
    out = others.join(light, "digest").select("doc_id", "size", "text_crc32", "shard")
    if len(heavy):
        cut = rows.join(known, "digest").withColumn("part", salt)
        cut = cut.join(F.broadcast(placed_heavy.drop("parts")), ["digest", "part"]).select("doc_id", "size", "text_crc32", "shard")
        out = out.unionByName(cut)
    return out.withColumnRenamed("doc_id", id_col)


def with_slots(rows: DataFrame, *, id_col: str = "doc_id", run: int = 16_384) -> DataFrame:
    """rows with slot, gapless from 0 in each shard: runs of a shard's rows are numbered, then offset by those before.

    There are about rows / run runs, dealt by a hash of the id; only their counts are summed up in one place.
    """
    per_shard = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    runs = max(1, -(-per_shard // run))
    dealt = rows.withColumn("__run", F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(runs)).cast("int"))
    counts = dealt.groupBy("shard", "__run").count()
    before = counts.select("shard", "__run", (F.sum("count").over(Window.partitionBy("shard").orderBy("__run")) - F.col("count")).alias("__before"))
    within = Window.partitionBy("shard", "__run").orderBy(F.col(id_col).asc_nulls_first())
    numbered = dealt.withColumn("__at", F.row_number().over(within) - 1)
    return numbered.join(before, ["shard", "__run"]).withColumn("slot", (F.col("__at") + F.col("__before")).cast("long")).drop("__run", "__before", "__at")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document; the law is that of bytes."""
    placed = written(assign(table(spark, sf_dir, "documents")), "sharding-placed")
    out = with_slots(placed)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
