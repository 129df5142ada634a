"""Tables that a job writes for itself in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session without it gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_dir()
    return base.rstrip("/")


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="sumforge-")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables of this application.

    All of them are in one folder, which goes when the driver's Python ends; a driver that is killed leaves it, under the
    application's id.
    """
    own = f"{shared_dir(spark)}/sumforge-{spark.sparkContext.applicationId}"
    _removed_at_exit(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as a table in the shared folder and read again: cuts the lineage, survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(*tables: DataFrame) -> DataFrame:
    """The rows of tables of one schema, each from written() or from here, as one table: a plan that reads it has one scan, not one for each."""
    first = tables[0]
    return first.sparkSession.read.schema(first.schema).parquet(*(f for t in tables for f in t.inputFiles()))


@lru_cache(maxsize=None)
def _removed_at_exit(path: str) -> None:
    atexit.register(remove, path)


def remove(path: str) -> None:
    """Removes a folder through Spark's file system; without a running session there is nothing to do it with."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
