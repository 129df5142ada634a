from pyspark.sql import functions as F

from sumforge.operators import store


def test_variants_stay_whole(spark):
    start = r"\int_{0}^{\infty}\frac{1}"
    variants = [start + tail for tail in ("{x^2 + 1} dx", "{1 + x^2} dx", "{1 + x^2} dx")]
    rows = [(k, "h", "c", "f", "definite", k, v) for k, v in enumerate(variants)]
    instances = spark.createDataFrame(rows, "instance_id long, hash string, canonical string, family string, kind string, question_id long, variant string")
    assert [r.variants for r in store.groups(instances).collect()] == ["|".join(sorted(set(variants)))]


def test_first_variants_of_a_group_with_very_many(spark):
    rows = spark.range(100_000).select(F.lit("hot").alias("hash"), F.format_string("%06d", (F.col("id") * 7919) % 100_000).alias("variant")).unionByName(spark.createDataFrame([("b", "x"), ("b", "x"), ("b", None)], "hash string, variant string"))
    found = store.firsts(rows, ["hash"], "variant", 10, name="v")
    assert {r.hash: r.v for r in found.collect()} == {"hot": [f"{k:06}" for k in range(10)], "b": ["x"]}
    assert found._jdf.queryExecution().toString().count("WindowGroupLimit") >= 2  # before and behind the shuffle
