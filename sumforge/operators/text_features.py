"""TF-IDF of character n-grams: counted text by text, weighted with DataFrame functions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sumforge.sources.snapshots import Snapshots


#: Rows of a batch of n-grams.
BATCH = 100_000


def char_ngrams(docs: DataFrame, id_col: str, text_col: str, sizes: tuple[int, ...] = (1, 2, 3), *, among: Collection[str] | None = None) -> DataFrame:
    """(id, term, tf): how often each n-gram of characters occurs in each text, case kept; among: only these terms.

    A text is counted where it lies, so what is shuffled are its different terms; texts of one id count as one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([rows.schema["id"], StructField("term", StringType()), StructField("tf", LongType())])
    wanted = None if among is None else frozenset(among)

    def run(batches):
        for batch in batches:
            places, terms, counts = [], [], []
            for k, text in enumerate(batch.column(1)):
                found = _counted(text.as_py() or "", sizes)
                if wanted is not None:
                    found = {t: n for t, n in found.items() if t in wanted}
                places += [k] * len(found)
                terms += found.keys()
                counts += found.values()
                if len(terms) >= BATCH:
                    yield _batch(batch, places, terms, counts)
                    places, terms, counts = [], [], []
            if terms:
                yield _batch(batch, places, terms, counts)

    return rows.mapInArrow(run, schema).groupBy("id", "term").agg(F.sum("tf").alias("tf"))


def _counted(text: str, sizes: tuple[int, ...]) -> Counter:
    """How often each n-gram occurs: those of a size are those of the size below, each with the next character."""
    found, grams = Counter(), list(text)
    for k in range(1, max(sizes) + 1):
        if k > 1:
            grams = list(map(add, grams, text[k - 1 :]))
        if k in sizes:
            found.update(grams)
    return found


def _batch(batch: pa.RecordBatch, places: list[int], terms: list[str], counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["id", "term", "tf"])


class Vectoriser:
    """What TF-IDF learns from texts: how often each term occurs (total), in how many texts (df), and how many texts there are.

    All terms are kept, not only those that are used, so that what was learnt from two corpora can be added up exactly.
    """

    def __init__(self, terms: DataFrame, texts: DataFrame):
        self.terms, self.texts = terms, texts

    @classmethod
    def fit(cls, docs: DataFrame, id_col: str, text_col: str) -> Vectoriser:
        """From docs, a text for each id; null texts count as texts without terms."""
        terms = char_ngrams(docs, id_col, text_col).groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
        return cls(terms, docs.agg(F.count(F.lit(1)).alias("n_docs")))

    def merged(self, other: Vectoriser) -> Vectoriser:
        """As if learnt from the texts of both, which have to be different ones."""
        terms = self.terms.unionByName(other.terms).groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
        return Vectoriser(terms, self.texts.unionByName(other.texts).agg(F.sum("n_docs").alias("n_docs")))

    def save(self, spark: SparkSession, path: str) -> int:
        """The version it is kept as; until all is written the one before is the current one."""
        return Snapshots(spark, path).replace({"terms": self.terms, "texts": self.texts})

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> Vectoriser:
        kept = Snapshots(spark, path)
        return cls(kept.table("terms", version), kept.table("texts", version))

    def vocabulary(self, features: int = 384) -> DataFrame:
        """(term, idf): the most frequent terms, ties by term; smooth idf ln((1 + n) / (1 + df)) + 1."""
        kept = self.terms.orderBy(F.desc("total"), "term").limit(features)
        return kept.crossJoin(F.broadcast(self.texts)).select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row

    def weights(self, docs: DataFrame, id_col: str, text_col: str, *, features: int = 384) -> DataFrame:
        """(id, term, weight): the terms of docs that are in the vocabulary, at unit length; texts without any have no rows."""
        vocabulary = self.vocabulary(features)
        terms = [r["term"] for r in vocabulary.select("term").collect()]  # as many rows as features
        known = char_ngrams(docs, id_col, text_col, among=terms).join(F.broadcast(vocabulary), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
        norms = known.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return known.join(norms, "id").select("id", "term", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))


def tfidf(docs: DataFrame, id_col: str, text_col: str, *, features: int = 384) -> DataFrame:
    """(id, term, weight): fitted to docs and applied to them."""
    return Vectoriser.fit(docs, id_col, text_col).weights(docs, id_col, text_col, features=features)
