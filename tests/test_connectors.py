import urllib.error

import pytest

from pyspark.sql import functions as F

from sumforge.operators import egraph, stages
from sumforge.sources import backends, files, web
from sumforge.streaming import progress


def test_a_page_is_tried_again_unless_the_client_is_at_fault():
    asked = []

    def fails(url):
        asked.append(url)
        if url == "gone":
            raise urllib.error.HTTPError(url, 404, "not found", None, None)
        if len(asked) < 4:
            raise TimeoutError("slow")
        return 200, "body"

    assert web.tried("gone", fails, wait=0)[1:3] == (404, None) and asked == ["gone"]
    assert web.tried("late", fails, wait=0) == ("late", 200, "body", None) and len(asked) == 4
    asked.clear()
    assert web.tried("late", fails, attempts=2, wait=0) == ("late", None, None, "TimeoutError: slow")


def test_pages_as_a_source_and_by_a_table_of_urls(spark, tmp_path):
    for k in (1, 2, 3):
        (tmp_path / f"p{k}.html").write_text(f"page {k}")
    web.register(spark)
    address = f"file://{tmp_path}/p{{page}}.html"
    rows = spark.read.format("web_pages").option("last", 4).option("perTask", 2).option("wait", 0).load(address).collect()
    assert [(r.status, r.body) for r in rows] == [(200, "page 1"), (200, "page 2"), (200, "page 3"), (None, None)] and rows[3].error
    urls = spark.createDataFrame([(address.replace("{page}", "2"),), (None,)], "url string")
    assert [(r.body, r.error) for r in web.fetched(urls, wait=0, parts=2).collect()] == [("page 2", None)]


def test_backends_are_known_by_name(spark):
    def make():
        def answer(page, content):
            if not content:
                raise ValueError("empty")
            return f"{page}:{len(content)}"

        return answer

    backends.register("lengths", make)
    with pytest.raises(ValueError, match="registered already"):
        backends.register("lengths", make)
    with pytest.raises(ValueError, match="lengths"):
        backends.backend("other")
    pages = spark.createDataFrame([("a", bytearray(b"xy")), ("b", bytearray())], "page string, content binary")
    assert sorted(map(tuple, backends.read(pages, "lengths").collect())) == [("a", "a:2", None), ("b", None, "ValueError: empty")]


def test_progress_and_observed_counts(spark):
    p = progress.Progress(total=30)
    assert p.add(10, 5.0)["seconds_left"] == 4.0 and p.add(30, 5.0)["seconds_left"] == 0.0 and p.add(1, 0.0)["seconds_left"] is None
    rows, seen = progress.observed(spark.range(10), "numbers", small=F.col("id") < 3)
    assert len(rows.collect()) == 10 and seen.get == {"rows": 10, "small": 3}


def test_a_stage_goes_on_where_it_was(spark, tmp_path):
    source, target, done = (str(tmp_path / n) for n in ("in", "out", "done"))

    def run():
        return progress.append_stage(spark, source, "x int", target, done, lambda rows: rows.where("x % 2 = 0"))

    spark.createDataFrame([(1,), (2,)], "x int").coalesce(1).write.json(source)
    assert run() == 2
    spark.createDataFrame([(3,), (4,)], "x int").coalesce(1).write.mode("append").json(source)
    assert run() == 2 and run() == 0
    assert sorted(r.x for r in spark.read.json(target).collect()) == [2, 4]


def test_backfill_fills_only_what_is_missing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (None, None)], "id int, author string")
    found = spark.createDataFrame([(1, "z"), (2, "c"), (2, "b"), (None, "n")], "id int, author string")
    assert sorted(map(tuple, stages.backfilled(rows, found, "id", "author").collect()), key=repr) == [(1, "a", False), (2, "b", True), (3, None, False), (None, None, False)]
    path = str(tmp_path / "filled")
    assert files.write_backfilled(rows, found, "id", "author", path, dry_run=True) == 1 and not (tmp_path / "filled").exists()
    assert files.write_backfilled(rows, found, "id", "author", path) == 1
    empty = rows.limit(0)
    assert stages.backfilled(empty, found, "id", "author").count() == 0 and stages.backfilled(rows, found.limit(0), "id", "author").where("filled").count() == 0


def test_configurations_of_a_folder(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "one.yaml").write_text("tags: [a, b]\n")
    (tmp_path / "two.yml").write_text("")
    assert files.configurations(str(tmp_path)) == {"one": {"tags": ["a", "b"]}, "two": {}}
    (tmp_path / "two.yml").write_text("- a\n")
    with pytest.raises(ValueError, match="two"):
        files.configurations(str(tmp_path))


def test_runs_are_reported_by_seed(spark):
    rows = {r.seed: r for r in egraph.reports(spark.createDataFrame([("x + 0",), ("eval('1')",), (None,)], "seed string").where("seed is not null")).collect()}
    assert rows["x + 0"].stop in ("saturated", "iterations") and rows["x + 0"].nodes >= 1 and rows["x + 0"].error is None
    assert rows["eval('1')"].stop is None and rows["eval('1')"].error
