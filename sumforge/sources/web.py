"""Pages fetched over HTTP, as a Python data source and as an operator on a table of URLs."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = "url string, status int, body string, error string"
Reply = tuple[int, str]
Fetch = Callable[[str], Reply]


def get(url: str, timeout: float = 30.0) -> Reply:
    with urllib.request.urlopen(url, timeout=timeout) as reply:  # noqa: S310
        return reply.status or 200, reply.read().decode("utf-8", "replace")


def tried(url: str, fetch: Fetch = get, *, attempts: int = 3, wait: float = 1.0) -> tuple[str, int | None, str | None, str | None]:
    """(url, status, body, error). Refusals of the client's making are final; others are tried again, each after twice the wait."""
    error = None
    for k in range(attempts):
        try:
            return (url, *fetch(url), None)
        except urllib.error.HTTPError as e:
            if 400 <= e.code < 500 and e.code != 429:
                return url, e.code, None, str(e)
            error = e
        except (OSError, ValueError) as e:
            error = e
        if k + 1 < attempts:
            time.sleep(wait * 2**k)
    return url, getattr(error, "code", None), None, f"{type(error).__name__}: {error}"


def fetched(urls: DataFrame, *, fetch: Fetch = get, attempts: int = 3, wait: float = 1.0, parts: int | None = None) -> DataFrame:
    """PAGE of each row of urls(url). Each task asks for one page at a time, so parts bounds the requests at one time."""

    def run(batches):
        for pdf in batches:
            rows = pd.DataFrame([tried(u, fetch, attempts=attempts, wait=wait) for u in pdf["url"]], columns=["url", "status", "body", "error"])
            yield rows.astype({"status": "Int32"})

    dealt = urls.select("url").where("url is not null")
    return (dealt.repartition(parts, "url") if parts else dealt).mapInPandas(run, PAGE)


class Chunk(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class Reader(DataSourceReader):
    def __init__(self, options):
        first, last = int(options.get("first", 1)), int(options.get("last", 1))
        self.urls = [options["path"].replace("{page}", str(k)) for k in range(first, last + 1)]
        self.per_task, self.attempts, self.wait = int(options.get("pertask", 10)), int(options.get("attempts", 3)), float(options.get("wait", 1.0))

    def partitions(self) -> list[InputPartition]:
        return [Chunk(self.urls[k : k + self.per_task]) for k in range(0, len(self.urls), self.per_task)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in partition.urls:
            yield tried(url, attempts=self.attempts, wait=self.wait)


class Pages(DataSource):
    """spark.read.format("web_pages").option("last", 5).load("https://host/list?page={page}"): pages first to last."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)
