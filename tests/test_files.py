from sumforge.sources import files


def test_json_lines_seeds_clusters_and_tuples(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a", "raw_latex": "x"}\n\n{bad\n{"id": "b"}\n')
    rows, bad = files.json_lines(spark, str(tmp_path / "r.jsonl"), files.RAW_FORMULA)
    rows = rows.cache()
    assert sorted(r.id for r in rows.collect()) == ["a", "b"]
    (tmp_path / "s.txt").write_text("# head\n x+1 \n\nsin(x)\n")
    assert sorted(r.seed for r in files.seeds(spark, str(tmp_path / "s.txt")).collect()) == ["sin(x)", "x+1"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "0a1b.txt").write_text("# SEED: x\nadd x 0\nmul 1 x\n")
    assert [tuple(r) for r in files.clusters(spark, str(tmp_path / "c")).collect()] == [("0a1b", "x", ["add x 0", "mul 1 x"])]
    t = spark.createDataFrame([("train", "q", "p", ["n", "m"])], "split string, query string, positive string, negatives array<string>")
    files.write_tuples(t, str(tmp_path / "t"))
    assert [tuple(r) for r in files.tuples(spark, str(tmp_path / "t/split=train")).collect()] == [("q", "p", ["n", "m"])]
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "t/_metadata")).select("split", "tuples", "queries", "columns").collect()] == [("train", 1, 1, 4)]
    files.write_routed(t, str(tmp_path / "routed"), "split")
    assert (tmp_path / "routed/split=train").exists()
    (tmp_path / "blob").mkdir()
    (tmp_path / "blob/a").write_bytes(b"plain")
    (tmp_path / "blob/b").write_bytes(b"\x00\xff")
    assert sorted(r.body for r in files.blobs(spark, str(tmp_path / "blob")).collect()) == ["AP8=", "plain"]


def test_json_lines_clusters_and_seed_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, raw_latex string")
    files.write_json_lines(rows, str(tmp_path / "out/one"))
    files.write_json_lines(rows, str(tmp_path / "out/one"), append=True)
    files.write_json_lines(rows, str(tmp_path / "out/two"))
    assert files.stage_output(spark, str(tmp_path / "out"), "id string, raw_latex string").count() == 6
    files.write_clusters(spark.createDataFrame([("0a", "x", ["add x 0"])], "seed_hash string, seed string, equivalents array<string>"), str(tmp_path / "clusters"))
    assert files.clusters(spark, str(tmp_path / "clusters")).first().equivalents == ["add x 0"]
    files.write_frozen_seeds(spark.createDataFrame([("s2", "synthetic"), ("s1", "synthetic"), ("d", "database")], "seed string, origin string"), str(tmp_path / "seeds"))
    lines = [line for place in (0, 1) for f in sorted((tmp_path / f"seeds/place={place}").glob("*.txt")) for line in f.read_text().split()]
    assert [x for x in lines if x != "#"] == ["synthetic", "s1", "s2", "database", "d"]
    assert sorted(r.seed for r in files.seeds(spark, str(tmp_path / "seeds")).collect()) == ["d", "s1", "s2"]


def test_rebuild_keeps_the_curation_log(spark, tmp_path):
    from pyspark.sql import functions as F

    from sumforge.operators import stages

    groups = spark.createDataFrame([("h", "x", "pow")], "hash string, canonical string, family string")
    instances = spark.createDataFrame([(1, "h", "x", "definite", 7), (2, "h", "y", "indefinite", None)], "instance_id long, hash string, variant string, kind string, question_id long")
    store = files.Store(spark, str(tmp_path / "store"))
    store.rebuild(stages.store_tables(groups, instances))
    store.log(spark.range(1).select(F.lit(1).cast("long").alias("id"), F.lit("remove").alias("action"), F.lit("instance").alias("target_type"), F.lit("1").alias("target_id"), F.lit("bad").alias("reason"), F.lit(None).cast("string").alias("context"), F.current_timestamp().alias("created_at")))
    store.rebuild(stages.store_tables(groups, instances.where("instance_id = 1")))
    assert [store.table(n).count() for n in ("integrand_groups", "integral_instances", "mse_metadata", "curation_log")] == [1, 1, 1, 1]
    store.drop()
    assert not (tmp_path / "store/curation_log").exists()


def test_index_cache(spark, tmp_path):
    cache = files.IndexCache(spark, str(tmp_path))
    cache.save("one", spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>"), "tfidf")
    assert [tuple(r) for r in cache.names().collect()] == [("one", "tfidf", 1, 2)] and cache.load("one").count() == 1
    assert cache.delete("one") and not (tmp_path / "one").exists()


def test_prefix_conversion_failures(spark):
    from sumforge.functions import expressions as E
    from sumforge.operators import stages

    good, bad = stages.prefixed(spark.createDataFrame([("x+1",), ("9**9**9",)], "seed string"), E.describe("seed")["prefix"])
    assert [r.prefix for r in good.collect()] == ["add 1 x"] and [r.failure_type for r in bad.collect()] == ["prefix_conversion"]
