"""Queries over embeddings, with their SQL. The queries of a batch search are the rows whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sumforge.operators import vector as V
from sumforge.operators.cells import CellIndex
from sumforge.operators.store import seeded_sample
from sumforge.operators.work import folder
from sumforge.sources.tables import table

K = 20


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _first(vectors: DataFrame) -> list[float]:
    return vectors.orderBy("vec_id").select("embedding").first()[0]


def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return V.topk_one(v, _first(v), 10).select("vec_id", "label", "score")


def _removed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id")).distinct()


def vector_topk_postfilter(spark: SparkSession, d: str) -> DataFrame:
    """Removed rows are taken out after the search, so there may be fewer than k."""
    v = _vectors(spark, d)
    return V.topk_one(v, _first(v), 10).join(_removed(spark, d), "vec_id", "left_anti").select("vec_id", "label", "score")


def vector_topk_prefilter(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return V.topk_one(v.join(_removed(spark, d), "vec_id", "left_anti"), _first(v), 10).select("vec_id", "label", "score")


def batch_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return V.topk(_queries(v), v, K).select("query_id", "vec_id", "score", "rank")


def index_topk(spark: SparkSession, d: str) -> DataFrame:
    """batch_topk() by a stored index, to which every tenth vector comes later."""
    v = _vectors(spark, d)
    index = CellIndex(spark, folder(spark, "index"))
    index.build(v.where("vec_id % 10 <> 3"))
    index.add(v.where("vec_id % 10 = 3"))
    return index.search(_queries(v), K).found.select("query_id", "vec_id", "score", "rank")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    label = v.select("vec_id", "label")
    found = V.topk(_queries(v), v, K).join(label, "vec_id")
    return found.join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("family")), "query_id").withColumn("hit", F.col("label") == F.col("family"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return V.per_query(_ranked(spark, d))


def retrieval_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).agg(*(F.round(F.avg(f"hit_{k}"), 6).alias(f"recall_{k}") for k in (1, 5, 10, 20)))


def retrieval_mrr(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).agg(F.round(F.avg("reciprocal"), 6).alias("mrr"))


def retrieval_map(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).agg(F.round(F.avg("average_precision"), 6).alias("map"))


def retrieval_ndcg10(spark: SparkSession, d: str) -> DataFrame:
    """The ideal order is that of what was retrieved."""
    return _metrics(spark, d).agg(F.round(F.avg("ndcg_10"), 6).alias("ndcg_10"))


def tier1_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Recall and reciprocal rank of 1,000 sampled queries against all rows."""
    v = _vectors(spark, d)
    asked = seeded_sample(v.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", 1000, 42)
    label = v.select("vec_id", "label")
    found = V.topk(asked, v, K).join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("family")), "query_id")
    per = V.per_query(found.withColumn("hit", F.col("label") == F.col("family")))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("hit_10"), 6).alias("recall_10"), F.round(F.avg("reciprocal"), 6).alias("mrr"))


def family_purity(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).agg(*(F.round(F.avg(F.col(f"matches_{k}") / k), 6).alias(f"purity_{k}") for k in (1, 5, 10)))


def per_family_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).groupBy("family").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("hit_10"), 6).alias("recall_10"), F.round(F.avg("reciprocal"), 6).alias("mrr"))


def top_families(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(15)


def family_separation(spark: SparkSession, d: str) -> DataFrame:
    return V.separation(_vectors(spark, d))


def _tuples(spark: SparkSession, d: str) -> DataFrame:
    """Each row with the next of its family as positive, and the first of the two families after its own as negatives."""
    v = _vectors(spark, d).select("vec_id", "label", V.doubles(F.col("embedding")).alias("e"))
    nxt = Window.partitionBy("label").orderBy("vec_id")
    rows = v.withColumn("p", F.lead("e").over(nxt)).where("p is not null")
    first = v.groupBy("label").agg(F.min_by("e", "vec_id").alias("first"))
    at = first.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("at"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))  # labels only
    first = first.join(at, "label")
    # the labels after the own one, around the end
    step = lambda k: first.select(F.pmod(F.col("at") - k, F.col("n")).alias("at"), F.when(F.col("n") > k, F.col("first")).alias(f"n{k}"))
    rows = rows.join(at, "label").join(step(1), "at").join(step(2), "at")
    return rows.withColumn("negatives", F.array_compact(F.array("n1", "n2")))


def infonce_loss(spark: SparkSession, d: str) -> DataFrame:
    t = _tuples(spark, d).withColumn("loss", V.infonce(F.col("e"), F.col("p"), F.col("negatives")))
    return t.agg(F.round(F.avg("loss"), 6).alias("loss"), F.count(F.lit(1)).alias("n"))


def _similarities(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, pos, neg): each tuple's cosine with its positive, and the mean of those with its negatives."""
    t = _tuples(spark, d).select("vec_id", V.cosine(F.col("e"), F.col("p")).alias("pos"), F.transform("negatives", lambda n: V.cosine(F.col("e"), n)).alias("neg"))
    return t.select("vec_id", "pos", (F.aggregate("neg", F.lit(0.0), lambda s, x: s + x) / F.size("neg")).alias("neg"))


def embedding_quality_batches(spark: SparkSession, d: str) -> DataFrame:
    """As a test run reports it: the mean of the batches' means, each batch 64 ids, so short batches weigh as much as full ones."""
    per = _similarities(spark, d).groupBy(F.floor(F.col("vec_id") / 64).alias("batch")).agg(F.avg("pos").alias("pos"), F.avg("neg").alias("neg"))
    return per.agg(F.count(F.lit(1)).alias("batches"), F.round(F.avg("pos"), 6).alias("pos_mean"), F.round(F.avg("neg"), 6).alias("neg_mean"), F.round(F.avg(F.col("pos") - F.col("neg")), 6).alias("margin"))


def embedding_quality(spark: SparkSession, d: str) -> DataFrame:
    t = _similarities(spark, d)
    return t.agg(F.round(F.avg("pos"), 6).alias("pos_mean"), F.round(F.avg("neg"), 6).alias("neg_mean"), F.round(F.avg("pos") - F.avg("neg"), 6).alias("margin"))


def _analogies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A : B = C : D with A, C the query rows, B and D the rows after them; the target vector is C + (B - A)."""
    v = _vectors(spark, d).select("vec_id", "label", V.doubles(F.col("embedding")).alias("e"))
    step = lambda name, of: v.select(F.col("vec_id").alias(f"{name}_id"), F.col("e").alias(name), *(F.col("label").alias(x) for x in of))
    a = step("a", []).where("a_id % 100 = 0")
    rows = a.join(step("b", []), F.col("b_id") == F.col("a_id") + 1).join(step("c", ["family"]), F.col("c_id") == F.col("a_id") + 2).join(step("dd", []).drop("dd"), F.col("dd_id") == F.col("a_id") + 3)
    target = F.zip_with("c", F.zip_with("b", "a", lambda x, y: x - y), lambda x, y: x + y)
    return rows.select(F.col("a_id").alias("query_id"), "dd_id", "family", target.alias("embedding")), v.select("vec_id", F.col("e").alias("embedding"))


def analogy_topk(spark: SparkSession, d: str) -> DataFrame:
    q, v = _analogies(spark, d)
    return V.topk(q, v, 10, exclude_self=False).select("query_id", "vec_id", "score", "rank")


def analogy_accuracy(spark: SparkSession, d: str) -> DataFrame:
    q, v = _analogies(spark, d)
    found = V.topk(q, v, 10, exclude_self=False).join(q.select("query_id", "dd_id", "family"), "query_id").withColumn("hit", F.col("vec_id") == F.col("dd_id"))
    each = found.groupBy("query_id", "family").agg(*(F.max(F.when(F.col("hit") & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias(f"h{k}") for k in (1, 5, 10)))
    return each.groupBy("family").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(f"h{k}"), 6).alias(f"accuracy_{k}") for k in (1, 5, 10)))


QUERIES = {f.__name__: f for f in (
    vector_topk_cosine, vector_topk_postfilter, vector_topk_prefilter, batch_topk, index_topk, retrieval_recall_at_k, retrieval_mrr, retrieval_map, retrieval_ndcg10,
    family_purity, tier1_evaluation, per_family_metrics, top_families, family_separation, infonce_loss, embedding_quality, embedding_quality_batches, analogy_topk, analogy_accuracy,
)}

_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_ONE = f"{_V}, q AS (SELECT e FROM v ORDER BY vec_id LIMIT 1)"
_SCORED = "SELECT vec_id, label, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, q"
_REMOVED = "SELECT doc_id FROM labels WHERE toxic = 1"
_TOPK = f"""{_V}, s AS (
  SELECT a.vec_id AS query_id, a.label AS family, b.vec_id, b.label, round(list_cosine_similarity(a.e, b.e), 6) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s), t AS (SELECT *, label = family AS hit FROM r WHERE rank <= {K})"""
_PER = f"""{_TOPK}, u AS (SELECT *, sum(hit::INT) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM t), m AS (
  SELECT query_id, family,
    {", ".join(f"max(CASE WHEN rank <= {k} THEN hit::INT ELSE 0 END)::DOUBLE AS hit_{k}, sum(CASE WHEN rank <= {k} THEN hit::INT ELSE 0 END) AS matches_{k}" for k in (1, 5, 10, 20))},
    coalesce(1.0 / min(CASE WHEN hit THEN rank END), 0) AS reciprocal,
    CASE WHEN sum(hit::INT) > 0 THEN sum(CASE WHEN hit THEN seen::DOUBLE / rank ELSE 0 END) / sum(hit::INT) ELSE 0 END AS ap,
    sum(CASE WHEN rank <= 10 THEN hit::INT / log2(rank + 1) ELSE 0 END) AS dcg
  FROM u GROUP BY ALL
)"""
_TUPLES = f"""{_V}, f AS (SELECT label, arg_min(e, vec_id) AS e FROM v GROUP BY label), w AS (
  SELECT vec_id, label, e, lead(e) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM v
), n AS (
  SELECT w.vec_id, w.e, w.p, f.e AS neg, row_number() OVER (PARTITION BY w.vec_id ORDER BY f.label < w.label, f.label) AS rn
  FROM w JOIN f ON f.label <> w.label WHERE w.p IS NOT NULL
), c AS (
  SELECT vec_id, any_value(list_cosine_similarity(e, p)) AS pos, sum(exp(list_cosine_similarity(e, neg) / 0.07)) AS negs, avg(list_cosine_similarity(e, neg)) AS neg
  FROM n WHERE rn <= 2 GROUP BY vec_id
)"""
_ANALOGY = f"""{_V}, q AS (
  SELECT a.vec_id AS query_id, d.vec_id AS d_id, c.label AS family, list_transform(range(1, len(a.e) + 1), lambda i: c.e[i] + (b.e[i] - a.e[i])) AS e
  FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id + 2 JOIN v d ON d.vec_id = a.vec_id + 3 WHERE a.vec_id % 100 = 0
), s AS (SELECT query_id, d_id, family, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""

ORACLE_SQL = {
    "vector_topk_cosine": f"WITH {_ONE} {_SCORED} ORDER BY score DESC, vec_id LIMIT 10",
    "vector_topk_postfilter": f"WITH {_ONE}, t AS ({_SCORED} ORDER BY score DESC, vec_id LIMIT 10) SELECT * FROM t WHERE vec_id NOT IN ({_REMOVED})",
    "vector_topk_prefilter": f"WITH {_ONE} {_SCORED} WHERE vec_id NOT IN ({_REMOVED}) ORDER BY score DESC, vec_id LIMIT 10",
    "batch_topk": f"WITH {_TOPK} SELECT query_id, vec_id, score, rank::INT AS rank FROM t",
    "index_topk": f"WITH {_TOPK} SELECT query_id, vec_id, score, rank::INT AS rank FROM t",
    "retrieval_recall_at_k": f"WITH {_PER} SELECT {', '.join(f'round(avg(hit_{k}), 6) AS recall_{k}' for k in (1, 5, 10, 20))} FROM m",
    "retrieval_mrr": f"WITH {_PER} SELECT round(avg(reciprocal), 6) AS mrr FROM m",
    "retrieval_map": f"WITH {_PER} SELECT round(avg(ap), 6) AS map FROM m",
    "retrieval_ndcg10": f"WITH {_PER} SELECT round(avg(CASE WHEN matches_10 > 0 THEN dcg / list_sum(list_transform(range(1, matches_10::BIGINT + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END), 6) AS ndcg_10 FROM m",
    "family_purity": f"WITH {_PER} SELECT {', '.join(f'round(avg(matches_{k}::DOUBLE / {k}), 6) AS purity_{k}' for k in (1, 5, 10))} FROM m",
    "per_family_metrics": f"WITH {_PER} SELECT family, count(*) AS queries, round(avg(hit_10), 6) AS recall_10, round(avg(reciprocal), 6) AS mrr FROM m GROUP BY family",
    "top_families": "SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 15",
    "family_separation": f"""WITH {_V}, p AS (SELECT a.label = b.label AS same, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id < b.vec_id)
SELECT round(avg(c) FILTER (same), 6) AS intra_mean, round(avg(c) FILTER (NOT same), 6) AS inter_mean, round(avg(c) FILTER (same) - avg(c) FILTER (NOT same), 6) AS margin FROM p""",
    "infonce_loss": f"WITH {_TUPLES} SELECT round(avg(ln(exp(pos / 0.07) + negs) - pos / 0.07), 6) AS loss, count(*) AS n FROM c",
    "embedding_quality": f"WITH {_TUPLES} SELECT round(avg(pos), 6) AS pos_mean, round(avg(neg), 6) AS neg_mean, round(avg(pos) - avg(neg), 6) AS margin FROM c",
    "embedding_quality_batches": f"WITH {_TUPLES}, b AS (SELECT vec_id // 64 AS batch, avg(pos) AS pos, avg(neg) AS neg FROM c GROUP BY ALL) SELECT count(*) AS batches, round(avg(pos), 6) AS pos_mean, round(avg(neg), 6) AS neg_mean, round(avg(pos - neg), 6) AS margin FROM b",
    "tier1_evaluation": "WITH " + _PER.replace("a.vec_id % 100 = 0", "a.vec_id IN (SELECT vec_id FROM v ORDER BY md5('42|' || vec_id), vec_id LIMIT 1000)") + " SELECT count(*) AS queries, round(avg(hit_10), 6) AS recall_10, round(avg(reciprocal), 6) AS mrr FROM m",
    "analogy_topk": f"WITH {_ANALOGY} SELECT query_id, vec_id, score, rank::INT AS rank FROM r WHERE rank <= 10",
    "analogy_accuracy": f"""WITH {_ANALOGY}, e AS (SELECT query_id, family, {', '.join(f'max(CASE WHEN vec_id = d_id AND rank <= {k} THEN 1.0 ELSE 0.0 END)::DOUBLE AS h{k}' for k in (1, 5, 10))} FROM r WHERE rank <= 10 GROUP BY ALL)
SELECT family, count(*) AS n, {', '.join(f'round(avg(h{k}), 6) AS accuracy_{k}' for k in (1, 5, 10))} FROM e GROUP BY family""",
}
