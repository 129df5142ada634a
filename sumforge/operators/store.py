"""The store of expression groups, instances, metadata and curation log, as DataFrames.

instances: instance_id, hash, canonical, family, kind, question_id, variant; removed: instance_id. Every view is a
join or an aggregate; nothing is looked up row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def short_hash(text: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def record_id(prefix: str, *parts: Column) -> Column:
    """prefix-<first 12 hexadecimal digits of SHA-1 of the parts joined by colons>."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(F.concat_ws(":", *parts)), 1, 12))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, nulls first; other columns may have any names."""
    name = "__n"
    while name in rows.columns:
        name += "_"
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) == 1).drop(name)


def firsts(rows: DataFrame, keys: list[str], value: str, n: int, *, name: str) -> DataFrame:
    """keys and name: the n least distinct values of each key, ascending; nulls are none.

    Every task keeps its own n least of each key, and of these the n least are found again behind the shuffle, so a key
    with any number of values costs as much as n of them.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    some = rows.where(F.col(value).isNotNull()).select(*keys, value).distinct().withColumn("__rank", rank).where(F.col("__rank") <= n)
    return some.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(name))


def groups(instances: DataFrame, *, variants: int = 10, keys: list[str] | None = None) -> DataFrame:
    """One row per hash (or other keys), null and empty hashes left out: first family, counts by kind, distinct questions, first variants, whole."""
    keys = ["hash"] if keys is None else keys
    some = instances.where(F.coalesce(F.col("hash"), F.lit("")) != "")
    counts = some.groupBy(*keys).agg(
        F.min_by("family", "instance_id").alias("family"), F.count_if(F.col("kind") == "definite").alias("definite"), F.count_if(F.col("kind") != "definite").alias("indefinite"),
        F.count_distinct(F.when(F.col("question_id") != 0, F.col("question_id"))).alias("questions"), F.min("instance_id").alias("first_id"),
    )
    found = counts.join(firsts(some, keys, "variant", variants, name="variants"), keys, "left")
    return found.withColumn("variants", F.coalesce(F.array_join("variants", "|"), F.lit("")))


def without_removed(instances: DataFrame, removed: DataFrame) -> DataFrame:
    return instances.join(removed, "instance_id", "left_anti")


def group_counts(instances: DataFrame, removed: DataFrame) -> DataFrame:
    """Groups in all, without those that have any removed instance, and without those of which all are removed."""
    flags = instances.where("hash is not null").join(removed.withColumn("gone", F.lit(1)), "instance_id", "left").groupBy("hash").agg(F.count("gone").alias("gone"), F.count(F.lit(1)).alias("n"))
    return flags.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("gone") == 0).alias("n_without_any"), F.count_if(F.col("gone") < F.col("n")).alias("n_without_all"))


def oldest_reason(log: DataFrame) -> DataFrame:
    """target_id and the reason of its oldest entry."""
    return log.groupBy("target_id").agg(F.min_by("reason", F.struct("created_at", "id")).alias("reason"))


def page(rows: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(order).offset(offset).limit(limit)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same in every engine."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def closed_forms(forms: DataFrame) -> DataFrame:
    """(form) of forms(instance_order, position, form) without integrals, references and limits; the first of equal ones."""
    fit = forms.where(~F.col("form").rlike(r"\\int|\\eqref|\\ref|\\lim"))
    return keep_first(fit, ["form"], ["instance_order", "position"])


def upsert_failures(events: DataFrame) -> DataFrame:
    """One row per (key, failure_type): attempts, the first message, the first and last time."""
    return events.groupBy("key", "failure_type").agg(F.count(F.lit(1)).alias("attempts"), F.min_by("message", F.struct("ts", "event_id")).alias("message"), F.min("ts").alias("first_attempt"), F.max("ts").alias("last_attempt"))
