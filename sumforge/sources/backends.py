"""Backends that read records from page images, known by name; a backend is a function of batches of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: A backend turns (page, content) into the raw JSON of its answer.
Backend = Callable[[str, bytes], str]
_known: dict[str, Callable[[], Backend]] = {}


def register(name: str, make: Callable[[], Backend]) -> None:
    """make is called once in each task, so that a model is loaded where it is used. A name is taken only once."""
    if name in _known:
        raise ValueError(f"backend {name!r} is registered already")
    _known[name] = make


def names() -> list[str]:
    return sorted(_known)


def backend(name: str) -> Callable[[], Backend]:
    if name not in _known:
        raise ValueError(f"no backend {name!r}; there are {', '.join(names()) or 'none'}")
    return _known[name]


def read(pages: DataFrame, name: str) -> DataFrame:
    """(page, raw, error) of each row of pages(page, content); a page that fails has an error and no raw."""
    make = backend(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = make()

        def one(page: str, content: bytes) -> tuple:
            try:
                return page, answer(page, content), None
            except Exception as e:  # noqa: BLE001 - whatever a backend raises is that page's error
                return page, None, f"{type(e).__name__}: {e}"

        for pdf in batches:
            yield pd.DataFrame([one(p, bytes(c)) for p, c in zip(pdf["page"], pdf["content"], strict=True)], columns=["page", "raw", "error"])

    return pages.select("page", "content").mapInPandas(run, "page string, raw string, error string")
