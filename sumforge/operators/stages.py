"""The stages between raw formulas and training data, as DataFrame operators.

Records are columns, never objects; what a stage rejects stays beside what it accepts, with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumforge.functions import latex
from sumforge.operators import ranges
from sumforge.operators.store import short_hash

API_PAGE = "items array<struct<question_id:bigint,answer_id:bigint,title:string,body:string,owner:struct<display_name:string,link:string>>>, quota_remaining int, error_message string"
OCR_PAGE = "integrals array<struct<integrand_latex:string,variable:string,lower_limit_latex:string,upper_limit_latex:string,solution_latex:string,conditions:string,label:string>>"


def chain_positions(rows: DataFrame, key: str) -> DataFrame:
    """(key, chain_position, form): the leading expression at 0, its equivalents behind."""
    return rows.select(key, F.posexplode(F.concat(F.array("leading_expression"), F.coalesce("equivalent_forms", F.array().cast("array<string>")))).alias("chain_position", "form"))


def without_equivalents_of_inequalities(rows: DataFrame) -> DataFrame:
    """Equivalents are cleared where the raw text has an inequality."""
    return rows.withColumn("equivalent_forms", F.when(latex.inequality(F.col("raw_latex")), F.array().cast("array<string>")).otherwise(F.col("equivalent_forms")))


def filter_report(rows: DataFrame, reason: Column, key: str, *, examples: int = 3) -> DataFrame:
    """(reason, n, examples) of the rejected rows: how many there are, and the first few keys, by a bounded aggregate."""
    marked = rows.select(F.col(key), reason.alias("reason")).where("reason is not null")
    parts = 256  # each part keeps its first few, so that no reason's rows meet in one task
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    first = Window.partitionBy("reason", "part").orderBy(key)
    some = marked.withColumn("part", part).withColumn("at", F.row_number().over(first)).where(F.col("at") <= examples)
    shown = some.groupBy("reason").agg(F.slice(F.sort_array(F.collect_list(key)), 1, examples).alias("examples"))
    return marked.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).join(shown, "reason")


def evaluated(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose expression holds no sum or integral that was left unevaluated."""
    return rows.where(~F.col(column).contains("Sum(") & ~F.col(column).contains("Integral("))


def lines(rows: DataFrame, order: str, *, start: int = 0, limit: int | None = 100) -> DataFrame:
    """The rows numbered from start on, limit of them, in the order of a column of integers."""
    at = ranges.numbered(rows, order, name="line").where(F.col("line") >= start)
    return at if limit is None else at.where(F.col("line") < start + limit)


def without_failures(seeds: DataFrame, failures: DataFrame, failure_type: str) -> DataFrame:
    """Seeds whose key has no failure of this type; failures(key, failure_type)."""
    return seeds.join(failures.where(F.col("failure_type") == failure_type).select("key"), "key", "left_anti")


def frozen_seeds(synthetic: DataFrame, stored: DataFrame, *, max_tokens: int = 8) -> DataFrame:
    """(seed, origin) of at most max_tokens tokens; a seed in both is synthetic."""
    both = synthetic.select("seed", F.lit("synthetic").alias("origin")).unionByName(stored.select("seed", F.lit("database").alias("origin")))
    return both.where(F.size(F.split(F.trim("seed"), r"\s+")) <= max_tokens).groupBy("seed").agg(F.max("origin").alias("origin"))


def filled_family(rows: DataFrame) -> DataFrame:
    """family where it is missing and there is a canonical form."""
    return rows.withColumn("family", F.when(F.col("family").isNull() & F.col("canonical").isNotNull(), latex.family(F.col("canonical"))).otherwise(F.col("family")))


def api_formulas(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """(checksum, latex, origin, item_id) of pages(body) of JSON: display formulas of titles and bodies, the first of equal ones.

    seen(checksum) are left out.
    """
    item = pages.select(F.explode(F.from_json("body", API_PAGE)["items"]).alias("i"))
    item_id = F.coalesce("i.answer_id", "i.question_id")
    kind = F.when(F.col("i.answer_id").isNotNull(), "answer").otherwise("question")
    texts = item.select(item_id.alias("item_id"), kind.alias("kind"), F.explode(F.array(F.struct(F.lit("title").alias("part"), F.col("i.title").alias("text")), F.struct(F.lit("body").alias("part"), F.col("i.body").alias("text")))).alias("t"))
    found = texts.where("t.text is not null").select("item_id", F.concat_ws("_", "kind", "t.part").alias("origin"), F.explode(latex.display_math(F.col("t.text"))).alias("m"))
    found = found.select("item_id", "origin", F.col("m.latex").alias("latex"), F.concat(F.lit("sha256:"), F.sha2("m.latex", 256)).alias("checksum"))
    first = found.groupBy("checksum").agg(F.min(F.struct("item_id", "origin", "latex")).alias("f"))
    return first.join(seen, "checksum", "left_anti").select("checksum", "f.latex", "f.origin", "f.item_id")


def ocr_records(pages: DataFrame) -> DataFrame:
    """(page, label, integral) of pages(page, raw) of a model's JSON; label is page-position where the model gave none."""
    rows = pages.select("page", F.posexplode(F.from_json("raw", OCR_PAGE)["integrals"]).alias("position", "integral"))
    return rows.select("page", F.coalesce("integral.label", F.concat_ws("-", F.col("page").cast("string"), (F.col("position") + 1).cast("string"))).alias("label"), "integral")


def backfilled(rows: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """rows with column taken from found(key, column) where it is null, and whether it was; of several values the least."""
    one = found.groupBy(F.col(key).alias("__key")).agg(F.min(column).alias("__value"))
    joined = rows.join(one, F.col(key) == F.col("__key"), "left")
    fills = F.col(column).isNull() & F.col("__value").isNotNull()
    return joined.withColumns({"filled": fills, column: F.coalesce(F.col(column), F.col("__value"))}).drop("__key", "__value")


def unread(pages: DataFrame, done: DataFrame, content: str) -> DataFrame:
    """pages, with the SHA-256 of their content, whose content is not among done(sha256)."""
    return pages.withColumn("sha256", F.sha2(F.col(content), 256)).join(done.select("sha256").distinct(), "sha256", "left_anti")


def guarded(rows: DataFrame, query: str, k: str, group: str, *, longest: int = 200, most: int = 20) -> DataFrame:
    """rows with refused, what is wrong with a request, null where nothing is: its query, the number asked for, its group's hash."""
    text = F.trim(F.coalesce(F.col(query), F.lit("")))
    why = F.when(text == "", "empty query").when(F.length(text) > longest, "long query").when(~F.coalesce(F.col(k).between(1, most), F.lit(False)), "k")
    return rows.withColumn("refused", why.when(~F.coalesce(F.col(group).rlike("^[a-f0-9]{12}$"), F.lit(False)), "hash"))


def blob_paths(rows: DataFrame) -> DataFrame:
    """(id, blob_paths) of raw formulas that have any."""
    return rows.where(F.coalesce(F.size("blob_paths"), F.lit(0)) > 0).select("id", "blob_paths")


def store_tables(groups: DataFrame, instances: DataFrame) -> dict[str, DataFrame]:
    """The store's three tables; only instances with a question have metadata."""
    return {
        "integrand_groups": groups.select("hash", "canonical", "family"),
        "integral_instances": instances.select("instance_id", "hash", "variant", "kind"),
        "mse_metadata": instances.where(F.coalesce("question_id", F.lit(0)) != 0).select("instance_id", "question_id"),
    }


def records_of(instances: DataFrame, ids: DataFrame) -> DataFrame:
    """All instances of the groups that the instances in ids(instance_id) belong to."""
    hashes = instances.join(ids, "instance_id", "left_semi").select("hash").distinct()
    return instances.join(hashes, "hash", "left_semi")


def prefixed(seeds: DataFrame, prefix: Column) -> tuple[DataFrame, DataFrame]:
    """(seeds with a prefix form, failures) by whether the conversion gave one."""
    made = seeds.withColumn("prefix", prefix)
    failed = made.where("prefix is null").select(short_hash(F.col("seed"), 8).alias("key"), "seed", F.lit("prefix_conversion").alias("failure_type"))
    return made.where("prefix is not null"), failed
