"""Vectors: exact top-k by cosine, analogies, retrieval metrics and contrastive losses.

Scores are rounded to six places before they are ranked, ties by id, so that every engine gives the same order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of vectors in a batch search.
BLOCK = 4096


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2(v: Column) -> Column:
    """v at unit length; a null vector stays as it is."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x / norm(v))).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def topk_one(corpus: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k rows of corpus(vec_id, embedding, ...) nearest to one vector: per-partition heaps, no shuffle of the corpus."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = corpus.withColumn("score", F.round(cosine(doubles(F.col("embedding")), q), 6))
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def topk(queries: DataFrame, corpus: DataFrame, k: int, *, exclude_self: bool = True, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank) for each row of queries(query_id, embedding) against all of corpus(vec_id, embedding).

    Both sides are cut into blocks, each pair of blocks is one matrix product that yields k rows for each query, and the
    k best of all blocks are ranked. The work is queries times corpus, a task's memory two blocks.
    """
    n_q, n_c = queries.count(), corpus.count()
    q_blocks, c_blocks = max(1, -(-n_q // block)), max(1, -(-n_c // block))
    q = queries.select(F.col("query_id").alias("id"), doubles(F.col("embedding")).alias("v"), F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("i"))
    c = corpus.select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(c_blocks)).alias("j"))
    q = q.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long")))).withColumn("is_query", F.lit(True))
    c = c.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long")))).withColumn("is_query", F.lit(False))

    def run(group: pa.Table) -> pa.Table:
        flag, ids = group.column("is_query").to_numpy(zero_copy_only=False), group.column("id").to_numpy()
        v = np.array(group.column("v").to_pylist(), float).reshape(len(ids), -1)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        qi, ci = ids[flag], ids[~flag]
        score = np.round(v[flag] @ v[~flag].T, 6)
        if exclude_self:
            score[qi[:, None] == ci[None, :]] = -np.inf
        out = []
        for row, at in zip(score, qi, strict=True):
            near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))  # all that tie with the last
            best = near[np.lexsort((ci[near], -row[near]))[:k]]
            best = best[np.isfinite(row[best])]
            out.append(pa.table({"query_id": np.full(len(best), at), "vec_id": ci[best], "score": row[best]}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    found = q.unionByName(c).groupBy("i", "j").applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def recall_at(ranked: DataFrame, ks: tuple[int, ...]) -> list[Column]:
    return [F.avg(F.col(f"hit_{k}")).alias(f"recall_{k}") for k in ks]


def per_query(ranked: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """One row per query of ranked(query_id, rank, hit boolean, ...): hits within k, reciprocal rank, average precision, NDCG@10."""
    w = Window.partitionBy("query_id").orderBy("rank")
    h = F.col("hit").cast("int")
    rows = ranked.withColumn("h", h).withColumn("seen", F.sum("h").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gain = lambda r: 1.0 / F.log2(r + F.lit(1.0))
    agg = rows.groupBy("query_id", *(c for c in ("family",) if c in ranked.columns)).agg(
        *(F.max(F.when(F.col("rank") <= k, F.col("h")).otherwise(0)).cast("double").alias(f"hit_{k}") for k in ks),
        *(F.sum(F.when(F.col("rank") <= k, F.col("h")).otherwise(0)).alias(f"matches_{k}") for k in ks),
        F.coalesce(1.0 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("reciprocal"),
        F.sum(F.when(F.col("hit"), F.col("seen") / F.col("rank")).otherwise(0.0)).alias("precisions"), F.sum("h").alias("matches"),
        F.sum(F.when(F.col("rank") <= 10, F.col("h") * gain(F.col("rank"))).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.when(F.col("matches_10") > 0, F.sequence(F.lit(1), F.col("matches_10").cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, r: s + gain(r))
    agg = agg.withColumn("average_precision", F.when(F.col("matches") > 0, F.col("precisions") / F.col("matches")).otherwise(0.0))
    return agg.withColumn("ndcg_10", F.when(F.col("matches_10") > 0, F.col("dcg") / ideal).otherwise(0.0))


def infonce(query: Column, positive: Column, negatives: Column, temperature: float = 0.07) -> Column:
    """-log softmax of the positive among it and the negatives, by cosine."""
    p = cosine(query, positive) / temperature
    total = F.aggregate(negatives, F.exp(p), lambda s, n: s + F.exp(cosine(query, n) / temperature))
    return F.log(total) - p


def separation(vectors: DataFrame) -> DataFrame:
    """Mean cosine within and between families of vectors(label, embedding), from the families' sums: linear, no pairs.

    The unit vectors of n rows with sum S have (|S|^2 - n) / 2 as the sum of their pairs' cosines.
    """
    unit = vectors.select("label", F.posexplode(l2(doubles(F.col("embedding")))).alias("d", "x"))
    per = unit.groupBy("label", "d").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    fam = per.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))
    whole = per.groupBy("d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))
    within = fam.agg(F.sum((F.col("ss") - F.col("n")) / 2).alias("intra_sum"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("intra_pairs"))
    both = within.join(F.broadcast(whole), F.lit(True))  # one row each
    intra = F.col("intra_sum") / F.col("intra_pairs")
    inter = ((F.col("ss") - F.col("n")) / 2 - F.col("intra_sum")) / (F.col("n") * (F.col("n") - 1) / 2 - F.col("intra_pairs"))
    return both.select(F.round(intra, 6).alias("intra_mean"), F.round(inter, 6).alias("inter_mean"), F.round(intra - inter, 6).alias("margin"))
