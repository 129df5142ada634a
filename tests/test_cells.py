import numpy as np
import pytest
from pyspark.sql import functions as F

from sumforge.operators import cells, vector

SCHEMA = "vec_id long, embedding array<double>"


def clustered(seed, n, clusters=20, dimensions=16, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dimensions))
    return [(int(k), (centres[c] + spread * rng.normal(size=dimensions)).tolist()) for k, c in enumerate(rng.integers(0, clusters, n))]


def same(spark, index, queries, corpus, k):
    got = index.search(queries, k)
    want = vector.topk(queries, corpus, k)
    columns = ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.found.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    return got


@pytest.mark.parametrize("block", [cells.BLOCK, 16])
def test_clusters_are_searched_exactly_and_in_part(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(cells, "BLOCK", block)
    rows = clustered(1, 900) + [(1000 + k, [1.0] + [0.0] * 15) for k in range(60)] + [(2000, None), (2001, [0.0] * 16)]
    corpus = spark.createDataFrame(rows, SCHEMA)
    index = cells.CellIndex(spark, str(tmp_path / "index"))
    index.build(corpus)
    usable = corpus.where("vec_id < 2000")
    queries = usable.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = same(spark, index, queries, usable, 7)
    assert got.share < 0.5 and got.rounds > 1


def test_vectors_come_later(spark, tmp_path):
    first, later = clustered(2, 300), [(5000 + k, v) for k, v in clustered(3, 200, clusters=5)]
    index = cells.CellIndex(spark, str(tmp_path / "index"))
    one = index.build(spark.createDataFrame(first, SCHEMA))
    two = index.add(spark.createDataFrame(later, SCHEMA))
    whole = spark.createDataFrame(first + later, SCHEMA)
    queries = whole.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    same(spark, index, queries, whole, 5)
    assert two > one and index.kept.table("vectors", one).count() == 300 and index.kept.table("vectors").count() == 500
    assert index.kept.table("cells").agg(F.sum("n")).first()[0] == 500


def test_nothing_and_fewer_than_k(spark, tmp_path):
    index = cells.CellIndex(spark, str(tmp_path / "index"))
    index.build(spark.createDataFrame([], SCHEMA))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert index.search(queries, 3).found.count() == 0
    index.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], SCHEMA))
    assert [tuple(r) for r in index.search(queries, 3).found.collect()] == [(1, 2, 0.0, 1)]
    assert index.search(queries.limit(0), 3).found.count() == 0
