import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sumforge.sources import files
from sumforge.sources.snapshots import Conflict, Snapshots

NAMES = files.Store.TABLES


def numbers(spark, n):
    return {name: spark.range(n).withColumn("of", F.lit(name)) for name in NAMES}


def test_a_rebuild_that_fails_leaves_the_old_store_whole(spark, tmp_path):
    store = files.Store(spark, str(tmp_path))
    first = store.rebuild(numbers(spark, 3))
    broken = numbers(spark, 5)
    broken[NAMES[1]] = spark.range(5).withColumn("of", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(PySparkException):
        store.rebuild(broken)
    assert [store.table(n).count() for n in NAMES] == [3, 3, 3] and store.kept.version() == first
    second = store.rebuild(numbers(spark, 7))
    assert [store.table(n).count() for n in NAMES] == [7, 7, 7]
    assert [store.table(n, first).count() for n in NAMES] == [3, 3, 3]
    old = store.table(NAMES[0], first)
    assert old.count() == 3 and second > first


def test_readers_keep_their_version_and_old_ones_expire(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path / "s"))
    assert kept.version() == 0 and kept.tables() == {} and kept.expire() == 0
    one = kept.replace({"a": spark.range(2), "b": spark.range(1)})
    pinned = kept.table("a")
    two = kept.append({"a": spark.range(10, 14)})
    three = kept.replace({"a": spark.range(1)})
    assert (pinned.count(), kept.table("a", two).count(), kept.table("a").count(), kept.table("b").count()) == (2, 6, 1, 1)
    assert kept.versions() == [one, two, three]
    assert kept.expire(keep=1) == 1  # what version two added; the first write still has table b
    assert kept.versions() == [three] and kept.table("b").count() == 1
    with pytest.raises(ValueError):
        kept.tables(one)
    with pytest.raises(KeyError):
        kept.table("c")


def test_only_one_of_two_writers_wins_and_a_dead_one_blocks_nobody(spark, tmp_path, monkeypatch):
    kept, other = Snapshots(spark, str(tmp_path)), Snapshots(spark, str(tmp_path))
    kept.replace({"a": spark.range(1)})
    create = kept._create

    def late(path, text):
        if "/manifests/" in path:
            other.replace({"a": spark.range(2)})
        create(path, text)

    monkeypatch.setattr(kept, "_create", late)
    with pytest.raises(Conflict):
        kept.replace({"a": spark.range(3)})
    assert kept.table("a").count() == 2
    (tmp_path / "commits" / "0000000009").write_text("")  # died while it wrote its commit
    assert other.replace({"a": spark.range(4)}) == 10 and kept.table("a").count() == 4
