import numpy as np
import pytest
from pyspark.sql import functions as F

from sumforge.operators import dataset, ranges
from sumforge.streaming import limits


def test_ranges_against_plain_series(spark):
    rng = np.random.default_rng(0)
    steps = sorted(rng.choice(5000, 700, replace=False).tolist())
    rows = [(name, s, float(v)) for name in "ab" for s, v in zip(steps, rng.random(700), strict=True)]
    series = spark.createDataFrame(rows, "name string, step long, value double")
    for name in "ab":
        values = [v for n, _, v in rows if n == name]
        last, want = values[0], []
        for v in values:
            last = 0.9 * last + 0.1 * v
            want.append(last)
        got = limits.ema(series, width=64).where(F.col("name") == name).orderBy("step").collect()
        assert np.allclose([r.ema for r in got], want)
        least = ranges.running(series, "step", "value", of=F.min, merge=F.least, by=("name",), width=64).where(F.col("name") == name).orderBy("step").collect()
        assert [r.so_far for r in least] == np.minimum.accumulate(values).tolist()
        at = ranges.numbered(series, "step", by=("name",), width=64).where(F.col("name") == name).orderBy("step").collect()
        assert [r["at"] for r in at] == list(range(700))


@pytest.mark.parametrize("kind", ["sparse", "crowded", "nulls", "timestamps"])
def test_scans_against_plain_running_sums(spark, kind):
    rng = np.random.default_rng(1)
    n = 3000
    order = {"sparse": rng.integers(0, 2**60, n), "crowded": rng.integers(0, 5, n), "nulls": rng.integers(0, 100, n), "timestamps": rng.integers(0, 10**9, n)}[kind].tolist()
    keys = [None if k == 0 else "hot" if k < 6 else f"k{k}" for k in rng.integers(0, 10, n).tolist()]
    rows = [(k, None if kind == "nulls" and o < 30 else o, i, int(v)) for i, (k, o, v) in enumerate(zip(keys, order, rng.integers(-(2**62), 2**62, n), strict=True))]
    df = spark.createDataFrame(rows, "key string, o long, id long, v long").repartition(5)
    if kind == "timestamps":
        df = df.withColumn("o", F.timestamp_seconds("o"))
    found = ranges.scanned(df.withColumn("__part", F.lit("x")), ["key"], ["o", "id"], ["v"], near=[F.col("o"), F.col("id")], partitions=16)
    assert found.columns == ["key", "o", "id", "v", "__part", "at"]
    want, state = {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        at, total = state.get(k, (0, 0))
        state[k] = want[i] = (at + 1, (total + v + 2**63) % 2**64 - 2**63)
    assert {r.id: (r["at"], r.v) for r in found.collect()} == want


def test_a_scan_of_one_key_is_spread(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("key"), F.pow("id", F.lit(3)).cast("long").alias("o"), F.lit(1).cast("long").alias("v"))
    found = ranges.scanned(df, ["key"], ["o"], ["v"], partitions=10)
    assert found.where("at <> v").count() == 0 and found.agg(F.max("at")).first()[0] == 20_000
    sizes = [r["n"] for r in spark.read.parquet(found.inputFiles()[0].rsplit("/", 1)[0]).groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_scans_of_nothing_and_without_keys(spark):
    assert ranges.scanned(spark.createDataFrame([], "o long"), [], ["o"]).collect() == []
    found = ranges.scanned(spark.range(100).withColumnRenamed("id", "o"), [], ["o"], at="n", partitions=7).collect()
    assert sorted((r.o, r.n) for r in found) == [(k, k + 1) for k in range(100)]


@pytest.mark.parametrize("kind", ["sparse", "crowded", "nulls", "timestamps"])
def test_ranges_of_any_order_are_even(spark, kind):
    rng = np.random.default_rng(2)
    n = 20_000
    order = {"sparse": rng.integers(0, 2**50, n), "crowded": rng.integers(10**6, 10**6 + 3000, n), "nulls": np.arange(n), "timestamps": 1_600_000_000 + rng.permutation(n) ** 2}[kind].tolist()
    df = spark.createDataFrame([(k, None if kind == "nulls" and k < 500 else o) for k, o in enumerate(order)], "id long, o long")
    if kind == "timestamps":
        df = df.withColumn("o", F.timestamp_seconds("o"))
    found, name = ranges.ranged(df.withColumn("__range", F.lit(0)), "o", width=1000)
    sizes = [r["count"] for r in found.where("o IS NOT NULL").groupBy(name).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert found.where("o IS NULL").select(name).distinct().count() == (kind == "nulls")
    got = {r.id: r["at"] for r in ranges.numbered(df, "o", width=1000).collect()}
    values = {r.id: r.o for r in df.collect()}
    places = sorted(got, key=got.get)
    assert sorted(got.values()) == list(range(n))
    assert all(values[a] is None or values[a] <= values[b] for a, b in zip(places, places[1:], strict=False))


def test_moving_average_across_ranges(spark):
    rng = np.random.default_rng(3)
    steps = sorted(rng.choice(10**9, 400, replace=False).tolist())
    values = rng.random(400).tolist()
    series = spark.createDataFrame([(n, s, v) for n in "ab" for s, v in zip(steps, values, strict=True)], "name string, step long, value double")
    for rows in (50, 3, 10_000):
        got = limits.moving_average(series, 7, rows=rows).where("name = 'b'").orderBy("step").collect()
        assert [r.step for r in got] == steps[:394]
        assert np.allclose([r["mean"] for r in got], [np.mean(values[k : k + 7]) for k in range(394)])
    assert limits.moving_average(series.limit(0), 7).count() == 0


def test_tasks_of_pairs_follow_the_number_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(dataset, "PER_TASK", 100)
    members = spark.range(60).select((F.col("id") % 2).alias("cluster"), "id")
    pairs = dataset.ordered_pairs(members)
    assert pairs.count() == 2 * 30 * 29 and pairs.rdd.getNumPartitions() == 18
    assert dataset.negatives(pairs, members).rdd.getNumPartitions() == 53
