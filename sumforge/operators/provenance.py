"""Where records come from: checksums of their content, and authors from the stored answers of an API."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What is read of a stored answer; whatever else it holds is skipped by the parser.
ITEMS = "items array<struct<question_id: long, answer_id: long, owner: struct<display_name: string, link: string>>>"


def _plain(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


@F.pandas_udf(StringType())
def _compatible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(_plain, na_action="ignore")


def _digests(texts: pa.Array) -> pa.Array:
    return pa.array((None if t is None else "sha256:" + hashlib.sha256(_plain(t).encode()).hexdigest() for t in (t.as_py() for t in texts)), pa.string())


#: Beside its batch a worker holds one text at a time, and gives back digests alone.
_digest = F.arrow_udf(_digests, StringType())


def canonical(text: Column) -> Column:
    """text in compatibility form (NFKC), each run of white space one space, trimmed; null stays null."""
    return _compatible(text)


def checksum(text: Column) -> Column:
    """sha256:<hex> of the canonical text; null for a null or empty text."""
    return F.when(F.length(text) > 0, _digest(text))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(blob, body): whole files below path by their names."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("blob"), F.col("value").alias("body"))


def blob_items(blobs: DataFrame) -> DataFrame:
    """(blob, position, question_id, answer_id, name, link) of blobs(blob, body); a body that is no such JSON has no items."""
    items = blobs.select("blob", F.posexplode(F.from_json("body", ITEMS)["items"]).alias("position", "item"))
    return items.select("blob", "position", "item.question_id", "item.answer_id", F.col("item.owner.display_name").alias("name"), F.col("item.owner.link").alias("link"))


def authors(records: DataFrame, items: DataFrame) -> DataFrame:
    """records(record_id, blob, item_id, origin) with author and author_link.

    A record whose origin speaks of an answer is looked up among the answers of its blob, any other among the questions;
    of several items with its id the first counts. Both are null where the blob, the item or its owner is missing.
    """
    kind, owner = F.when(F.contains(F.col("origin"), F.lit("answer")), "a").otherwise("q"), F.struct("name", "link")
    both = F.array(F.struct(F.lit("q").alias("kind"), F.col("question_id").alias("id")), F.struct(F.lit("a").alias("kind"), F.col("answer_id").alias("id")))
    known = items.select("blob", "position", owner.alias("owner"), F.inline(both)).where("id is not null")
    known = known.groupBy("blob", "kind", "id").agg(F.min_by("owner", "position").alias("owner"))
    known = known.select(F.col("blob").alias("k_blob"), F.col("kind").alias("k_kind"), F.col("id").alias("k_id"), "owner")
    asked = (records["blob"] == known["k_blob"]) & (kind == known["k_kind"]) & (records["item_id"] == known["k_id"])
    return records.join(known, asked, "left").select(*(records[c] for c in records.columns), known["owner"]["name"].alias("author"), known["owner"]["link"].alias("author_link"))
