"""Tables of a directory, and small tables of constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, per_task: int = 2500) -> DataFrame:
    """rows in tasks of about per_task rows each, for long work in Python: a small file would else be one task, however many rows it has."""
    return rows.repartition(max(1, -(-rows.count() // per_task)))


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)
