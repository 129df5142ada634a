"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Texts are equal when they are identical after white space is deleted. The full normalised text is part of every
grouping key, beside its digest, so that contents are compared at every stage and a digest collision cannot join two
texts:

1. each map task combines its own copies (the partial aggregation before the shuffle),
2. salted digest groups are merged: a text of any number of copies reaches at most one row per map task and salt,
3. the winners of the salts are combined globally.

The rows then get their group's winner by digest. Where a digest holds several contents, which only a collision can
cause, these rows are joined on the content itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sumforge.llm._shared import fresh, table, written

#: Deleted before texts are compared.
WHITE_SPACE = " \t\n\x0b\f\r"
#: Above any code point count times this there is room for any 64-bit id.
ID_SPAN = "20000000000000000000"


def normalised(text: Column) -> Column:
    """text without white space; null counts as empty."""
    return reduce(lambda c, space: F.replace(c, F.lit(space), F.lit("")), WHITE_SPACE, F.coalesce(text, F.lit("")))


def _preference(n_chars: Column, doc_id: Column) -> Column:
    """One number that is larger the more code points, then the smaller the id; a null id comes after all others."""
    span = F.lit(ID_SPAN).cast("decimal(20,0)")
    id_part = F.coalesce(F.lit("9223372036854775808").cast("decimal(20,0)") - doc_id.cast("decimal(19,0)"), F.lit(0).cast("decimal(20,0)"))
    return (n_chars.cast("decimal(10,0)") * span + id_part).cast("decimal(38,0)")


def _rows(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("content"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    return rows.select("doc_id", F.sha2("content", 256).alias("digest"), "content", salt.alias("salt"), _preference(F.col("n_chars"), F.col("doc_id")).alias("best"))


def _combined(rows: DataFrame) -> DataFrame:
    """(digest, content, best, group_size): one row for each different content, after the three stages."""
    merged = rows.groupBy("digest", "salt", "content").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("group_size"))
    return merged.groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"))


def _keep_id(best: Column) -> Column:
    """The id inside a preference; null where only null ids stood."""
    rest = best % F.lit(ID_SPAN).cast("decimal(20,0)")
    return F.when(rest > 0, (F.lit("9223372036854775808").cast("decimal(20,0)") - rest).cast("long"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256), one row for each row of docs, dropped ones too.

    Of equal texts the row with the most code points in the original, then the smallest id stays; a null id comes last
    and is never kept. A null text is an empty one, and empty texts are equal. Rows repeated with the same id and text
    each count in group_size and are marked alike. Other columns are not read. salts: into so many parts the rows of a
    digest are dealt before they meet.
    """
    rows = _rows(docs, id_col, text_col, salts)
    by_digest = _combined(rows).groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("best").alias("best"), F.max("group_size").alias("group_size"))
    found = written(by_digest, "exact-groups")
    marked = rows.select("doc_id", "digest").join(found.where("contents = 1"), "digest").select("doc_id", "digest", "best", "group_size")
    collided = found.where("contents > 1").select("digest")
    if not collided.isEmpty():  # never seen with SHA-256; the contents decide then
        full = rows.join(collided, "digest", "left_semi")
        several = full.select("doc_id", "digest", "content").join(_combined(full), ["digest", "content"])
        marked = marked.unionByName(several.select("doc_id", "digest", "best", "group_size"))
    keep = _keep_id(F.col("best"))
    return marked.select(F.col("doc_id").alias(id_col), keep.alias("keep_id"), "group_size", F.coalesce(keep == F.col("doc_id"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that dedup() keeps, with all their columns; of rows repeated with one id and text, one.

    Rows without an id all stay, unless a row with an id has the same text.
    """
    marks = dedup(docs, id_col=id_col, text_col=text_col)
    key, sha, rank = fresh(docs.columns, "key", "sha", "rank")
    kept = marks.where("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(sha)).distinct()
    unnamed = marks.where(F.col(id_col).isNull() & F.col("keep_id").isNull()).select(F.col("text_sha256").alias(sha)).distinct()
    marked = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    # of rows with one id and one content, the longest original stays, as dedup() has it
    first = Window.partitionBy(id_col, sha).orderBy(F.length(text_col).desc_nulls_last())
    named = marked.join(kept, (F.col(id_col) == kept[key]) & (marked[sha] == kept[sha]), "left_semi").withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1)
    rest = marked.where(F.col(id_col).isNull()).join(unnamed, sha, "left_semi")
    return named.select(docs.columns).unionByName(rest.select(docs.columns))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
