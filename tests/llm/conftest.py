import os
import tempfile

import pytest
from pyspark.sql import SparkSession

#: Texts that break careless code.
HARD = [None, "", " ", "\n\t ", "a", "a b", "A  B\n", "é ü 漢字  x", "x" * 5000, "word " * 3000, "<|endoftext|> it's", "tab\tand\r\nfeeds\x0b\x0c", "😀 emoji 👩‍👩‍👧", "a b", "a b", " a b"]


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TZ", "UTC")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="sumforge-test-")).config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture()
def documents(spark):
    """Makes a documents table of texts, with ids from 0, more columns and clashing names."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        schema = "doc_id long, text string, lang string, source string, n_chars long, content string, digest string, best string"
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in zip(ids, texts, strict=True)], schema)

    return make
