"""Training tuples: seed-level splits, sampled positives and cross-cluster negatives, all by hashes, so repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumforge.operators.ranges import scanned
from sumforge.operators.work import written

#: Rows of one task of a join or grouping of pairs.
PER_TASK = 1_000_000


def draw(*parts: Column) -> Column:
    """A number below 2^32 from the MD5 of the parts joined by bars."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def split(seeds: DataFrame, key: str, *, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """seeds with split: the first floor(n * train) in hashed order train, the next floor(n * val) val, the rest test.

    The rank of a seed is the number of seeds with a smaller hash: runs of the hash range are counted, then ranked within,
    so that no task sees all seeds.
    """
    if abs(train + val) > 1 + 1e-6:
        raise ValueError("ratios exceed 1")
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    rows = seeds.withColumn("__h", h).withColumn("__run", F.substring("__h", 1, 3))
    counts = rows.groupBy("__run").count()  # at most 4096 rows
    before = counts.select("__run", (F.sum("count").over(Window.orderBy("__run")) - F.col("count")).alias("__before"), F.sum("count").over(Window.partitionBy()).alias("__n"))
    rank = F.row_number().over(Window.partitionBy("__run").orderBy("__h", key)) - 1 + F.col("__before")
    at, n = F.col("__at"), F.col("__n")
    first, second = F.floor(n * train), F.floor(n * train) + F.floor(n * val)
    out = rows.join(F.broadcast(before), "__run").withColumn("__at", rank)
    return out.withColumn("split", F.when(at < first, "train").when(at < second, "val").otherwise("test")).select(*seeds.columns, "split")


def ordered_pairs(members: DataFrame, *, k: int = 70, threshold: int = 200) -> DataFrame:
    """(cluster, query_id, positive_id) of members(cluster, id): all ordered pairs of clusters below the threshold, in larger
    ones k positives for each query.

    Members are numbered in hashed order; the j-th positive of a query is the one j places further on, around the end. So
    pairs are built by an equi-join on (cluster, number), k for each row at most threshold - 1, and no cluster is expanded.
    Numbers come from ranges of (cluster, hash), so no task sees a whole cluster.
    """
    hashed = members.select("cluster", "id", F.md5(F.concat_ws("|", F.col("cluster").cast("string"), F.col("id").cast("string"))).alias("h"))
    rows = scanned(hashed, ["cluster"], ["h", "id"]).select("cluster", "id", (F.col("at") - 1).alias("at"))
    rows = rows.join(rows.groupBy("cluster").agg(F.max("at").alias("last")), "cluster").select("cluster", "id", "at", (F.col("last") + 1).alias("n")).where("n > 1")
    rows = written(rows, "members")
    steps = F.when(F.col("n") < threshold, F.col("n") - 1).otherwise(F.least(F.lit(k), F.col("n") - 1)).cast("int")
    parts = _parts(rows.agg(F.coalesce(F.sum(steps), F.lit(0))).first()[0])
    asked = rows.select("cluster", F.col("id").alias("query_id"), "at", "n", F.explode(F.sequence(F.lit(1), steps)).alias("j"))
    asked = asked.withColumn("at", F.pmod(F.col("at") + F.col("j"), F.col("n")))
    others = rows.select("cluster", "at", F.col("id").alias("positive_id"))
    return asked.repartition(parts, "cluster", "at").join(others.repartition(parts, "cluster", "at"), ["cluster", "at"]).select("cluster", "query_id", "positive_id")


def _parts(rows: int) -> int:
    """Tasks of a join or grouping that takes so many rows, so that none grows with them."""
    return max(1, -(-rows // PER_TASK))


def negatives(pairs: DataFrame, members: DataFrame, *, k: int = 3, seed: int = 42) -> DataFrame:
    """pairs with negatives array: k members of other clusters, each by a cluster draw that skips the own one, then a member
    draw; with replacement. Rows stay only if there is another cluster."""
    pairs = written(pairs, "pairs")
    parts = _parts(pairs.count() * k)
    numbered = scanned(members.select("cluster", "id"), ["cluster"], ["id"]).withColumn("at", F.col("at") - 1)
    clusters = scanned(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), [], ["cluster"], at="c").withColumn("c", F.col("c") - 1)
    total = F.broadcast(clusters.agg(F.count(F.lit(1)).alias("total")))  # one row
    own = pairs.join(clusters.select("cluster", "c"), "cluster").crossJoin(total).where("total > 1")
    slots = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    key = [F.lit(str(seed)), F.col("query_id").cast("string"), F.col("positive_id").cast("string"), F.col("j").cast("string")]
    drawn = draw(F.lit("c"), *key) % (F.col("total") - 1)
    slots = slots.withColumn("other", drawn + (drawn >= F.col("c")).cast("long")).withColumn("pick", draw(F.lit("m"), *key))
    far = clusters.select(F.col("c").alias("other"), F.col("cluster").alias("other_cluster"), "size")
    slots = slots.join(far, "other").withColumn("at", F.col("pick") % F.col("size"))
    others = numbered.select(F.col("cluster").alias("other_cluster"), "at", F.col("id").alias("negative_id"))
    found = slots.repartition(parts, "other_cluster", "at").join(others.repartition(parts, "other_cluster", "at"), ["other_cluster", "at"])
    return found.repartition(parts, "cluster", "query_id", "positive_id").groupBy("cluster", "query_id", "positive_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "negative_id"))), lambda x: x["negative_id"]).alias("negatives"))


def permutation_dedup(rows: DataFrame, text: str) -> DataFrame:
    """One row for each multiset of tokens: its least text.

    Equal texts are counted first, so that only different ones have their tokens sorted.
    """
    key = F.array_join(F.array_sort(F.split(text, " ")), " ")
    texts = rows.groupBy(text).agg(F.count(F.lit(1)).alias("n"))
    return texts.groupBy(key.alias("tokens")).agg(F.min(text).alias(text), F.sum("n").alias("n"))
