"""Document fingerprints as threshold-scaled sketches, with DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the text, sketches of
parts merge by union, and containment can be estimated between very unequal documents. A text whose hashes all lie
above the threshold keeps its smallest hash, so that only texts without words have an empty sketch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sumforge.llm._shared import table, written

#: One in so many shingle hashes is retained.
SCALE = 8
SHINGLE = 5

Get = Callable[[str], Column]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, where body uses it more than once or inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _threshold(scale: int) -> Column:
    """The lowest 1/scale of the signed 64-bit range lies below this."""
    return F.lit(-(2**63) + 2**64 // scale)


def sketch(text: Column, *, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """array<bigint>, ascending: the retained hashes of the word shingles of text.

    Words are runs of anything but ASCII white space, unchanged. A text of fewer words than a shingle is one shingle; a
    text without words, or null, has an empty sketch.
    """
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashed: _sketch_of_words(hashed, shingle, scale))


def _sketch_of_words(hashed: Column, shingle: int, scale: int) -> Column:
    """Each word is hashed once; a shingle's hash is that of its words' hashes."""

    def of_shingles(shingles: Column) -> Column:
        kept = F.array_sort(F.array_distinct(F.filter(shingles, lambda h: h < _threshold(scale))))
        return F.when(F.size(hashed) == 0, F.array().cast("array<bigint>")).when(F.size(kept) == 0, F.array(F.array_min(shingles))).otherwise(kept)

    starts = F.sequence(F.lit(0), F.greatest(F.size(hashed) - shingle, F.lit(0)))
    # beyond the end get() gives null, which the hash skips
    return _let(F.transform(starts, lambda i: F.xxhash64(*(F.get(hashed, i + k) for k in range(shingle)))), of_shingles)


def merged(one: Column, other: Column, *, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""

    def of_both(both: Column) -> Column:
        below = F.filter(both, lambda h: h < _threshold(scale))
        return F.when(F.size(both) == 0, both).when(F.size(below) == 0, F.array(F.array_min(both))).otherwise(F.array_sort(below))

    return _let(F.array_union(one, other), of_both)


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; two empty ones are alike."""
    union = F.size(F.array_union(one, other))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(one, other)) / union)


def containment(part: Column, whole: Column, *, scale: int = SCALE) -> Column:
    """Estimated share of the part's shingles that the whole has, from the hashes below the threshold; 1 for an empty part.

    A part that has none there is judged by its smallest hash: 1 where the whole kept that too, 0 where every hash of the
    whole is larger, and null where the whole may have had it without keeping it.
    """

    def of_part(p: Column) -> Column:
        below, least = F.filter(p, lambda h: h < _threshold(scale)), F.get(p, F.lit(0))
        judged = F.when(F.array_contains(whole, least), F.lit(1.0)).when((F.size(whole) == 0) | (F.array_min(whole) > least), F.lit(0.0))
        return F.when(F.size(p) == 0, F.lit(1.0)).when(F.size(below) > 0, F.size(F.array_intersect(below, whole)) / F.size(below)).otherwise(judged)

    return _let(part, of_part)


def as_string(one: Column) -> Column:
    """Hexadecimal hashes, joined by commas."""
    return F.array_join(F.transform(one, lambda h: F.lower(F.hex(h))), ",")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """(id_col, sketch array<bigint>, fingerprint string) of every row; no shuffle. A null text is an empty one."""
    made = docs.select(F.col(id_col), sketch(F.col(text_col), shingle=shingle, scale=scale).alias("sketch"))
    return made.withColumn("fingerprint", as_string(F.col("sketch")))


def with_next(rows: DataFrame, columns: list[str], *, id_col: str = "doc_id", per_bucket: int = 100_000, asks: dict[str, Column] | None = None, lends: Callable[[Get, Get], dict[str, Column]] | None = None) -> DataFrame:
    """(id_col, columns, next_<name>): each row and what the one that follows in ascending id lends it, the first's after the last.

    asks are expressions over a row that the next one is told; lends(own, asked) makes what the next one gives from its own
    columns and from what it is asked, by default all its columns. So rows are dealt out once, and only what is lent
    goes on to the row before.

    The order is found from ids and hashes of the columns alone: Spark deals them into ranges of about per_bucket rows by
    a sample of them, so that neither null nor far ids crowd a range, and only the last of each range is looked at
    together. Rows then meet the one before by its id and hash. Null ids come first; rows with one id are in the order
    of their hashes; rows repeated with one id and equal columns take one place and have the same successor.
    """
    asks = asks or {}
    lends = lends or (lambda own, asked: {c: own(c) for c in columns})
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("__key"), F.xxhash64(F.col(id_col).isNull(), *columns).alias("__tag")]
    small = rows.select(F.col(id_col).alias("__id"), *key, *(c.alias(f"__ask_{name}") for name, c in asks.items()))
    found = small.groupBy("__key", "__tag").agg(F.min("__id").alias("__id"), F.count(F.lit(1)).alias("copies"), *(F.first(f"__ask_{name}").alias(f"__ask_{name}") for name in asks))
    places = written(found, "next-places")
    dealt = places.repartitionByRange(max(1, -(-places.count() // per_bucket)), "__key", "__tag")
    dealt = written(dealt.withColumn("part", F.spark_partition_id()), "next-ranges")
    at = F.struct(F.col("__key").alias("key"), F.col("__tag").alias("tag"), *(F.col(f"__ask_{name}").alias(name) for name in asks))
    everywhere = Window.partitionBy(F.lit(0)).orderBy("part")
    whole = everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = dealt.groupBy("part").agg(F.max_by(at, F.struct("__key", "__tag")).alias("last"))  # one row for per_bucket rows
    earlier = lasts.select("part", F.coalesce(F.lag("last").over(everywhere), F.last("last").over(whole)).alias("earlier"))
    places = dealt.withColumn("before", F.lag(at).over(Window.partitionBy("part").orderBy("__key", "__tag"))).join(earlier, "part")
    places = places.select("__id", "__key", "__tag", "copies", F.coalesce("before", "earlier").alias("before"))
    once = rows.select(*key, *(F.col(c).alias(f"__{k}") for k, c in enumerate(columns))).dropDuplicates(["__key", "__tag"])
    held = once.join(places, ["__key", "__tag"])
    lent = lends(lambda c: F.col(f"__{columns.index(c)}"), lambda name: F.col(f"before.{name}"))
    lent_rows = held.select(F.col("before.key").alias("__key"), F.col("before.tag").alias("__tag"), *(c.alias(f"__lent_{name}") for name, c in lent.items()))
    met = held.join(lent_rows, ["__key", "__tag"]).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return met.select(F.col("__id").alias(id_col), *(F.col(f"__{k}").alias(c) for k, c in enumerate(columns)), *(F.col(f"__lent_{name}").alias(f"next_{name}") for name in lent))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are.

    The edited text has the last half of the code points replaced by the first as many of the next document.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs, ["text"], asks={"half": half}, lends=lambda own, asked: {"start": F.substring(own("text"), F.lit(1), asked("half")), "sketch": sketch(own("text"))})
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.col("next_start"))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "text", F.col("next_sketch").alias("s_next"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *(sketch(F.col(c)).alias(f"s_{c}") for c in ("text", "edited")), "s_next")
    own, new, after = F.col("s_text"), F.col("s_edited"), F.col("s_next")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_string(own).alias("fingerprint"), as_string(new).alias("edited_fingerprint"),
        likeness(own, new).alias("near_edited"), likeness(own, after).alias("near_next"),
    )
