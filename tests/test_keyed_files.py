import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sumforge.sources import files, keyed_files


def test_clusters_are_read_as_they_were_written(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = [(f"{k:04x}", f"x+{k}", [f"add x {k}", "é"] * (k % 3)) for k in range(50)]
    files.write_clusters(spark.createDataFrame(rows, "seed_hash string, seed string, equivalents array<string>").repartition(4), path)
    assert sorted(map(tuple, files.clusters(spark, path).collect())) == rows
    about = keyed_files.about(path)
    assert about["files"] == 50 and about["lines"] == 50 + sum(len(r[2]) for r in rows)
    listed = {r.file: r for r in keyed_files.manifest(spark, path).collect()}
    for file in tmp_path.glob("c/data/*/*/*.txt"):
        assert listed[file.name].sha256 == hashlib.sha256(file.read_bytes()).hexdigest() and listed[file.name].bytes == file.stat().st_size
    assert len(listed) == 50
    files.write_clusters(spark.createDataFrame(rows[:2], "seed_hash string, seed string, equivalents array<string>"), path)
    assert sorted(map(tuple, files.clusters(spark, path).collect())) == rows[:2]
    assert len(list((tmp_path / "c/data").iterdir())) == 1  # what was replaced is gone


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.range(100).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("x").alias("line"))
    keyed_files.write(rows, path, key="key", line="line", order=[])
    broken = spark.range(100, 300).select(F.when(F.col("id") < 299, F.concat(F.lit("k"), "id")).alias("key"), F.lit("y").alias("line"))
    with pytest.raises(PySparkException):
        keyed_files.write(broken, path, key="key", line="line", order=[], overwrite=False)
    assert keyed_files.about(path)["files"] == 100 and keyed_files.read(spark, path).where("value like 'y%'").count() == 0
    assert len(list((tmp_path / "c/data").iterdir())) == 1
    keyed_files.write(broken.where("key IS NOT NULL"), path, key="key", line="line", order=[], overwrite=False)
    assert keyed_files.about(path)["files"] == 299 and keyed_files.read(spark, path).count() == 299


def test_blobs_of_any_bytes_and_names(spark, tmp_path):
    rows = [("a/b c+%", b"plain\n"), ("bin", b"\x00\xff"), ("empty", b""), ("é", "漢字\r\n".encode())]
    files.write_blobs(spark.createDataFrame(rows, "key string, content binary"), str(tmp_path / "b"))
    assert sorted((r.key, bytes(r.content)) for r in files.read_blobs(spark, str(tmp_path / "b")).collect()) == sorted(rows)
    files.write_blobs(spark.createDataFrame([("more", b"m")], "key string, content binary"), str(tmp_path / "b"))
    assert files.read_blobs(spark, str(tmp_path / "b")).count() == 5


def test_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    keyed_files.write(spark.createDataFrame([], "key string, line string"), path, key="key", line="line", order=[])
    assert keyed_files.about(path) == {"files": 0, "lines": 0, "bytes": 0}
    assert keyed_files.read(spark, path).count() == 0 and keyed_files.manifest(spark, path).count() == 0
