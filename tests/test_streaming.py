from sumforge.streaming import limits


def test_sliding_log_edges():
    log = limits.SlidingLog(30, 60)
    assert all(log.admit(k * 0.1) for k in range(30)) and not log.admit(3.0)
    assert not log.admit(60.0)  # exactly as old as the window: still counts
    assert log.admit(60.05)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, k % 3, 1000 + k * 7.0) for k in range(120)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s double").selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    batch = sorted(map(tuple, limits.rate_limited(events, limit=2, seconds=60).collect()))
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = limits.rate_limited_stream(stream, limit=2, seconds=60).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM limited").collect())) == batch


def test_keep_first_across_batches(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([("a",), ("b" if k else "a",)], "checksum string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("checksum string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = limits.keep_first_stream(stream, "checksum").writeStream.format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.checksum for r in spark.sql("SELECT * FROM firsts").collect()) == ["a", "b"]


def _run(stream, name, folder):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", folder).start()
    query.processAllAvailable()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    return spark_rows(query, name), sizes


def spark_rows(query, name):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sql(f"SELECT * FROM {name}").collect()


def test_state_of_streams_stays_flat(spark, tmp_path):
    batches = 30
    for k in range(batches):
        rows = [(k * 10 + j, k * 10 + j % 7, 1_600_000_000 + k * 600 + j) for j in range(10)] + ([(-k, k * 10 - 10, 1_600_000_000 + k * 600 - 500)] if k else [])
        spark.createDataFrame(rows, "event_id long, user_id long, s long").selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts").coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")

    def stream():
        return spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    kept, sizes = _run(limits.keep_first_stream(stream(), "user_id", time="ts", within="20 minutes"), "kept", f"{tmp_path}/a")
    assert sorted(r.user_id for r in kept) == sorted(k * 10 + j for k in range(batches) for j in range(7))
    assert max(sizes[10:]) <= max(sizes[:10]) < 60
    held, sizes = _run(limits.rate_limited_stream(stream(), limit=2, seconds=120), "held", f"{tmp_path}/b")
    assert max(sizes[10:]) <= max(sizes[:10]) < 60 and {r.event_id for r in held if r.event_id >= 0} == set(range(batches * 10))  # late rows (below 0) may be gone


def test_rows_without_those_removed_later(spark, tmp_path):
    at = 1_600_000_000
    for k in range(6):
        spark.createDataFrame([(k, at + k * 3600)], "id long, s long").selectExpr("id", "timestamp_seconds(s) AS ts").coalesce(1).write.parquet(f"{tmp_path}/rows/{k}")
        log = [(k, "remove" if k % 2 else "restore", at + k * 3600 + 60)]
        spark.createDataFrame(log, "id long, action string, s long").selectExpr("id", "action", "timestamp_seconds(s) AS seen").coalesce(1).write.parquet(f"{tmp_path}/log/{k}")
    rows = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows/*")
    log = spark.readStream.schema("id long, action string, seen timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log/*")
    found, _ = _run(limits.without_curated(rows, log, "id", time="ts", log_time="seen", within="30 minutes"), "clean", f"{tmp_path}/c")
    ids = {r.id for r in found}
    assert {0, 2} <= ids and not ids & {1, 3, 5}
