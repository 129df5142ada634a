"""Quality classifier by positive-unlabelled learning.

Trusted positives are the rows labelled good; unlabelled web text is a sample of all documents, good and bad. With the
class prior p, the risk of taking good text for bad is known from the positives and that of taking bad text for good is
the unlabelled risk less the positives' share of it, which must not fall below zero: the non-negative unbiased risk
p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)). It is minimised over an additive logistic model of
binned text statistics. The logistic loss is proper, so the minimum is at the probability of good text, which is the
score; rows labelled bad serve only to estimate the prior.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumforge.llm._shared import table

#: A bounded number of labelled rows to fit with; the rows with the lowest hashes of their ids.
SAMPLE = 20_000
#: A bounded number of rows over which the risk of unlabelled text is averaged, picked likewise from all documents.
UNLABELLED = 20_000
BINS = 20
#: Where bins end, as shares of all documents: equal bins, and narrow ones in the tails, where rare bad text lies.
CUTS = tuple(sorted([k / BINS for k in range(1, BINS)] + [0.005, 0.015, 0.03, 0.97, 0.985, 0.995]))
#: Bits of a statistic that are dropped before its values are counted: 11 of a float's mantissa stay, 1 part in 2,048.
DROPPED = 12
#: Of good text, where no label says bad.
PRIOR = 0.8
HELD_OUT = (4, 2)
THRESHOLD = 0.7

FEATURES = ("chars", "words", "word_length", "word_spread", "letters", "digits", "upper", "spaces", "marks", "symbols", "distinct_words", "top_word", "distinct_pairs", "entropy", "lines", "line_length", "repeated_lines", "top_line", "closed_lines", "longest_word", "one_letter", "wide", "top_char", "marked_words", "tags")
_END = tuple(".!?…:;\"'”)»")
_KIND = np.full(128, 4, np.int64)  # 0 letter, 1 digit, 2 space, 3 ordinary mark, 4 symbol
for _c in range(128):
    _KIND[_c] = 0 if chr(_c).isalpha() else 1 if chr(_c).isdigit() else 2 if chr(_c).isspace() else 3 if chr(_c) in ".,;:!?'\"()-" else 4


def statistics(text: str) -> list[float]:
    """One number for each of FEATURES, from the whole text."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_ = codes[codes < 128]
    counts = np.bincount(ascii_, minlength=128)
    kinds = np.bincount(_KIND, counts, 5)
    wide = n - len(ascii_)
    words = text.split()
    m = len(words)
    lengths = np.fromiter(map(len, words), np.int64, m) if m else np.zeros(1, np.int64)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    line_counts = Counter(lines)
    used = counts[counts > 0] / n
    pairs = len(set(zip(words, words[1:], strict=False)))
    sample = max(1, m)
    return [
        np.log1p(n), np.log1p(m), float(lengths.mean()), float(lengths.std()), (kinds[0] + wide) / n, kinds[1] / n, counts[65:91].sum() / n, kinds[2] / n,
        kinds[3] / n, kinds[4] / n, len(seen) / sample, max(seen.values(), default=0) / sample, pairs / max(1, m - 1), float(-(used * np.log(used)).sum()),
        np.log1p(len(lines)), n / max(1, len(lines)), 1 - len(line_counts) / max(1, len(lines)), max(line_counts.values(), default=0) / max(1, len(lines)),
        sum(x.rstrip().endswith(_END) for x in lines) / max(1, len(lines)), np.log1p(int(lengths.max())), float((lengths == 1).mean()), wide / n, counts[33:].max() / n,
        sum(not w.isalpha() for w in words) / sample, (counts[60] + counts[62] + counts[123] + counts[125]) / n,
    ]


class Model:
    """An additive model: each statistic falls in one of BINS bins, and the weights of its bins are summed."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, offset: float):
        self.edges, self.weights, self.offset = edges, weights, offset

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Column numbers of the bins; x is rows by statistics."""
        n = self.edges.shape[1] + 1
        return np.stack([np.searchsorted(e, x[:, k], side="right") + k * n for k, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(x)].sum(axis=1) + self.offset

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, edges: np.ndarray | None = None, steps: int = 400, rate: float = 0.05, ridge: float | None = None) -> Model:
    """Minimises the non-negative unbiased risk with the logistic loss; statistics by rows.

    edges are the inner ends of the bins, a row for each statistic; without them they come from the rows given.
    """
    if edges is None:
        edges = np.quantile(np.concatenate([positive, unlabelled]), CUTS, axis=0).T
    ridge = max(2e-4, 0.2 / len(positive)) if ridge is None else ridge
    model = Model(edges, np.zeros(edges.shape[0] * (edges.shape[1] + 1)), 0.0)
    bp, bu = model.bins(positive), model.bins(unlabelled)
    size = len(model.weights)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        fp, fu = model.weights[bp].sum(1) + model.offset, model.weights[bu].sum(1) + model.offset
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        # gradients of the logistic loss with respect to the raw scores
        as_good, p_as_bad, u_as_bad = prior * (sp - 1) / len(fp), prior * sp / len(fp), su / len(fu)
        gp, gu = (as_good - p_as_bad, u_as_bad) if negative >= 0 else (p_as_bad, -u_as_bad)  # below zero: only climb back
        g = np.append(np.bincount(bp.ravel(), np.repeat(gp, bp.shape[1]), size) + np.bincount(bu.ravel(), np.repeat(gu, bu.shape[1]), size) + ridge * model.weights, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model.weights -= move[:-1]
        model.offset -= move[-1]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id must not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


def value_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(statistic, value, n): how many of all rows have each value of each statistic, values cut to 1 part in 2,048.

    Counted within each task before the shuffle. There are as many rows as different values: of shares and logarithms at
    most some ten thousand for each statistic, however many documents there are. A null text is an empty one.
    """

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            x = np.abs(np.array([statistics(t or "") for t in batch.column(0).to_pylist()], np.float32)).reshape(-1, len(FEATURES))  # no -0.0
            cells = (x.view(np.uint32) >> DROPPED).astype(np.int64) + (np.arange(len(FEATURES), dtype=np.int64) << 32)
            seen.update(dict(zip(*(a.tolist() for a in np.unique(cells, return_counts=True)), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["cell", "n"])

    cells = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return cells.select(F.shiftright("cell", 32).cast("int").alias("statistic"), F.col("cell").bitwiseAND(0xFFFFFFFF).alias("value"), "n")


def bin_edges(counts: DataFrame) -> np.ndarray | None:
    """The value below which each share of CUTS lies, for each statistic of value_counts; None where there are no rows."""
    rows = counts.toArrow().sort_by([("statistic", "ascending"), ("value", "ascending")])  # statistics are not negative, so their bits are in order
    at, n = rows.column("statistic").to_numpy(), rows.column("n").to_numpy()
    value = (rows.column("value").to_numpy().astype(np.uint32) << DROPPED).view(np.float32).astype(float)
    if not len(at):
        return None
    found = []
    for k in range(len(FEATURES)):
        so_far = np.cumsum(n[at == k])
        found.append(value[at == k][np.searchsorted(so_far, np.multiply(CUTS, so_far[-1]))])
    return np.array(found)


def _sample_ids(rows: DataFrame, limit: int) -> DataFrame:
    """The limit ids with the lowest hashes: the same rows whatever the partitions."""
    return rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model | None:
    """A model fitted to at most sample labelled rows and unlabelled others; None without a trusted positive or any document.

    Only labels of ids that are not held out are learnt from, and of an id labelled twice the higher one. The prior, if
    not given, is estimated as the share of good rows among those (PRIOR where none is bad); the unlabelled rows are
    sampled from all documents. Of an id with several texts, the least is learnt from.
    """
    ids = docs.select(F.col(id_col).alias("doc_id"))
    known = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = known.unionByName(_sample_ids(ids, unlabelled).withColumn("y", F.lit(-1)))
    # at most sample + unlabelled rows of 12 bytes
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")  # one text for an id, however often it is repeated

    def measure(batches):
        for batch in batches:
            found = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = texts.mapInArrow(measure, "doc_id long, y int, x array<double>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    y = rows.column("y").to_numpy()
    x = np.array(rows.column("x").to_pylist(), float).reshape(len(y), len(FEATURES))
    good, labelled = y == 1, y >= 0
    if not good.any() or not (y == -1).any():
        return None
    if prior is None:
        prior = float(good[labelled].mean()) if (~good[labelled]).any() else PRIOR
    return fit(x[good], x[y == -1], min(0.99, max(0.01, prior)), edges=bin_edges(value_counts(docs, text_col)))


def _scores(model: Model | None, texts: list[str | None]) -> np.ndarray:
    """Without a model every text is taken for good."""
    if model is None or not texts:
        return np.ones(len(texts))
    return model.score(np.array([statistics(t or "") for t in texts]))


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, score, predicted) of every row, in one pass; a null text is an empty one. Other columns are not read."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            s = _scores(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, score double, predicted int").withColumnRenamed("doc_id", id_col)


def keep_good(docs: DataFrame, model: Model | None, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that the model takes for good."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
