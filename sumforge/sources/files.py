"""File formats: JSON lines with bad lines counted, seed lists, cluster files, TSV tuples, routed and split writes."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumforge.operators.stages import backfilled
from sumforge.sources import keyed_files
from sumforge.sources.snapshots import Snapshots

RAW_FORMULA = "id string, raw_latex string, source string, source_url string, latex_origin string, context_snippet string, license map<string,string>, scrape_timestamp timestamp, blob_paths map<string,string>, provenance struct<extractor:string,item_id:bigint,origin:string,math_type:string,pattern_index:int>, checksum string, created_at timestamp"
NORMALIZED_FORMULA = "id string, raw_latex string, source_id string, accepted boolean, leading_expression string, equivalent_forms array<string>, parametric_conditions string, rejection_reason string, checksum string, created_at timestamp"


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): blank lines are skipped, malformed ones kept apart."""
    rows = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad"), rows.where("_bad is not null").select("_bad")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments."""
    return spark.read.text(path).select(F.trim("value").alias("seed")).where("seed <> '' AND NOT startswith(seed, '#')")


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(seed_hash, seed, equivalents): one file each, named by hash, headed by '# SEED: ...'; as write_clusters() writes them, or loose in a folder."""
    places = keyed_files.folders(path) or [path]
    lines = F.split("value", "\n")
    body = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    seed = F.trim(F.regexp_extract("value", r"(?m)^# SEED:(.*)$", 1))
    rows = spark.read.option("pathGlobFilter", "*.txt").text(places, wholetext=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("seed_hash"), seed.alias("seed"), body.alias("equivalents"))


def tuples(spark: SparkSession, path: str) -> DataFrame:
    """(query, positive, negatives) of TSV lines with at least three columns."""
    cols = F.split("value", "\t")
    return spark.read.text(path).where(F.size(cols) >= 3).select(cols[0].alias("query"), cols[1].alias("positive"), F.slice(cols, 3, 2**31 - 1).alias("negatives"))


def write_tuples(rows: DataFrame, path: str) -> None:
    """One folder of TSV for each split, and in _metadata a row for each: its tuples, queries and columns."""
    line = F.concat_ws("\t", "query", "positive", F.array_join("negatives", "\t"))
    rows.select("split", line.alias("value")).write.partitionBy("split").mode("overwrite").text(path)
    about = rows.groupBy("split").agg(F.count(F.lit(1)).alias("tuples"), F.count_distinct("query").alias("queries"), F.max(F.size("negatives") + 2).alias("columns"))
    about.write.mode("overwrite").json(f"{path}/_metadata")


def write_routed(rows: DataFrame, path: str, by: str) -> None:
    """One folder for each value of a column: accepted or not, definite or indefinite."""
    rows.write.partitionBy(by).mode("overwrite").parquet(path)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, body): text where the bytes are UTF-8 without NUL, else base64."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.is_valid_utf8(F.col("content").cast("string")) & ~F.contains(F.col("content").cast("string"), F.lit("\0"))
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.when(text, F.col("content").cast("string")).otherwise(F.base64("content")).alias("body"))


def write_json_lines(rows: DataFrame, path: str, *, append: bool = False) -> None:
    """Rows as JSON lines; what is there is replaced, or kept if append."""
    rows.write.mode("append" if append else "overwrite").json(path)


def stage_output(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON lines in a stage's folder, those of folders within it too."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)


def write_clusters(rows: DataFrame, path: str) -> None:
    """rows(seed_hash, seed, equivalents) as clusters() reads them: a file for each, all or none."""
    head = F.struct(F.lit(-1).alias("at"), F.concat(F.lit("# SEED: "), "seed").alias("line"))
    body = F.transform("equivalents", lambda x, k: F.struct(k.alias("at"), x.alias("line")))
    lines = rows.select("seed_hash", F.explode(F.concat(F.array(head), F.coalesce(body, F.array()))).alias("x"))
    keyed_files.write(lines.select("seed_hash", "x.at", "x.line"), path, key="seed_hash", line="line", order=["at"])


def write_blobs(rows: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """rows(key, content binary), a file for each key: the text where the bytes are UTF-8 without NUL, else base64 behind a mark; all or none."""
    text = F.is_valid_utf8(F.col("content").cast("string")) & ~F.contains(F.col("content").cast("string"), F.lit("\0"))
    body = F.when(text, F.concat(F.lit("text\n"), F.col("content").cast("string"))).otherwise(F.concat(F.lit("base64\n"), F.base64("content")))
    keyed_files.write(rows.select("key", body.alias("body")), path, key="key", line="body", order=[], overwrite=overwrite)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(key, content) of what write_blobs() wrote."""
    rows = keyed_files.read(spark, path)
    rest = F.substring("value", F.locate("\n", F.col("value")) + 1, F.length("value"))
    rest = F.substring(rest, F.lit(1), F.length(rest) - 1)  # without the line feed that ends the file
    content = F.when(F.startswith("value", F.lit("text\n")), F.encode(rest, "UTF-8")).otherwise(F.unbase64(rest))
    return rows.select(F.regexp_replace("key", r"\.txt$", "").alias("key"), content.alias("content"))


def write_frozen_seeds(rows: DataFrame, path: str) -> None:
    """rows(seed, origin) as text with a header for each origin, the synthetic ones first; sorted by Spark, in one file for each."""
    order = F.when(F.col("origin") == "synthetic", 0).otherwise(1)
    heads = rows.select("origin").distinct().select(F.col("origin"), F.concat(F.lit("# "), "origin").alias("value"), F.lit(0).alias("line"), F.lit("").alias("seed"))
    lines = heads.unionByName(rows.select("origin", F.col("seed").alias("value"), F.lit(1).alias("line"), "seed"))
    lines.withColumn("place", order).repartition("place").sortWithinPartitions("place", "line", "seed").select("place", "value").write.partitionBy("place").mode("overwrite").text(path)


class Store:
    """The store as versioned tables in a folder. A rebuild replaces groups, instances and metadata at once, and never the curation log."""

    LOG = "id long, action string, target_type string, target_id string, reason string, context string, created_at timestamp"
    TABLES = ("integrand_groups", "integral_instances", "mse_metadata")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.kept = spark, path.rstrip("/"), Snapshots(spark, path)

    def create(self) -> None:
        """An empty curation log, where there is none."""
        if "curation_log" not in self.kept.tables():
            self.kept.replace({"curation_log": self.spark.createDataFrame([], self.LOG)})

    def drop(self) -> None:
        _deleted(self.spark, self.path)

    def rebuild(self, tables: dict[str, DataFrame]) -> int:
        """The new version. Until all three tables are written, readers have the old ones."""
        self.create()
        return self.kept.replace({name: tables[name] for name in self.TABLES})

    def log(self, rows: DataFrame) -> int:
        self.create()
        return self.kept.append({"curation_log": rows.select(*(c.split()[0] for c in self.LOG.split(", ")))})

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.kept.table(name, version)


class IndexCache:
    """Embedded corpora kept by name: vectors as Parquet, beside one row of what they were made with."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, name: str, vectors: DataFrame, model: str) -> None:
        vectors.write.mode("overwrite").parquet(f"{self.path}/{name}/vectors")
        about = self.spark.read.parquet(f"{self.path}/{name}/vectors").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dimensions"))
        about.select(F.lit(name).alias("name"), F.lit(model).alias("model"), "n", "dimensions").write.mode("overwrite").parquet(f"{self.path}/{name}/about")

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/vectors")

    def names(self) -> DataFrame:
        """(name, model, n, dimensions) of all that is kept."""
        return self.spark.read.parquet(f"{self.path}/*/about")

    def delete(self, name: str) -> bool:
        return _deleted(self.spark, f"{self.path}/{name}")


def configurations(path: str) -> dict[str, dict]:
    """The YAML files of a folder by their names, read on the driver: a few small files that people write."""
    import yaml

    found = {}
    for file in sorted(Path(path).glob("*.y*ml")):
        read = yaml.safe_load(file.read_text(encoding="utf-8"))
        if read is not None and not isinstance(read, dict):
            raise ValueError(f"{file}: not a mapping")
        found[file.stem] = read or {}
    return found


def write_backfilled(rows: DataFrame, found: DataFrame, key: str, column: str, path: str, *, dry_run: bool = False) -> int:
    """Writes rows to a new path with column filled from found(key, column); how many rows that fills.

    What was there stays as it is, so the input is the backup.
    """
    filled = backfilled(rows, found, key, column)
    if dry_run:
        return filled.where("filled").count()
    filled.write.mode("errorifexists").json(path)
    return rows.sparkSession.read.schema(filled.schema).json(path).where("filled").count()


def _deleted(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
