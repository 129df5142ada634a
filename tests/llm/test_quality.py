import zlib

import numpy as np
import pytest

from sumforge.llm import quality
from tests.llm.conftest import HARD


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("etaoinshr"), k)) for k in rng.integers(2, 9, 400)]
    texts, good = [], []
    for k in range(600):
        words = list(rng.choice(vocabulary, rng.integers(30, 200)))
        bad = k % 6 == 0
        texts.append(" ".join(["%%%" + w for w in words] if bad else words) + ".")
        good.append(int(not bad))
    return texts, good


def test_held_out_accuracy_and_no_use_of_held_out_labels(spark, documents, tmp_path):
    texts, good = corpus()
    docs = documents(texts + HARD)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # labels of held-out rows are wrong on purpose: they must not be learnt from
    out = [zlib.crc32(str(k).encode()) % 4 == 2 for k in range(len(texts))]
    labels = [(k, 1 - g if out[k] else g, 0) for k, g in enumerate(good) if k % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r for r in quality.op9(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts) + len(HARD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert [rows[k].held_out for k in range(len(texts))] == out
    assert np.mean([rows[k].predicted == g for k, g in enumerate(good) if out[k]]) > 0.97


def test_bins_end_where_all_documents_say(spark, documents):
    texts, _ = corpus()
    docs = documents(texts + HARD + [None, "word " * 200_000, "x" * 1_000_000]).repartition(7)
    edges = quality.bin_edges(quality.value_counts(docs))
    every = np.array([quality.statistics(r.text or "") for r in docs.collect()])
    plain = np.quantile(every, quality.CUTS, axis=0, method="inverted_cdf").T
    assert edges.shape == plain.shape
    assert (edges <= plain * (1 + 1e-6)).all() and (edges >= plain * (1 - 1 / 2048) - 1e-6).all()
    assert quality.bin_edges(quality.value_counts(documents([]))) is None
    assert (quality.bin_edges(quality.value_counts(docs.repartition(2))) == edges).all()


def test_unlabelled_rows_are_bounded_by_their_own_parameter(spark, documents):
    texts, good = corpus()
    docs = documents(texts)
    labels = spark.createDataFrame([(k, g) for k, g in enumerate(good) if k % 5], "doc_id long, quality int")
    for bound in (150, 20_000):
        rows = quality.score(docs, quality.train(docs, labels, unlabelled=bound)).collect()
        assert np.mean([r.predicted == good[r.doc_id] for r in rows]) > 0.95


@pytest.mark.parametrize("texts", [[], HARD])
def test_without_labels_all_stay(spark, documents, texts):
    docs = documents(texts)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert model is None
    assert quality.keep_good(docs, model).count() == len(texts)
    assert quality.score(docs, model).count() == len(texts)


def test_risk_uses_no_negatives():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, (6000, 2)), rng.normal(-2, 1, (1000, 2))
    model = quality.fit(good[:3000], np.concatenate([good[3000:], bad]), 0.75)
    assert (model.score(good[3000:]) > 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.9


def test_minimum_of_the_risk_against_plain_descent():
    """On one statistic with few values the weights can be found by plain gradient descent over the score of each value."""
    rng = np.random.default_rng(1)
    values = np.arange(4.0)
    positive = rng.choice(values, 4000, p=[0.1, 0.2, 0.3, 0.4])[:, None]
    bad = rng.choice(values, 1500, p=[0.6, 0.3, 0.05, 0.05])[:, None]
    unlabelled = np.concatenate([rng.choice(values, 3500, p=[0.1, 0.2, 0.3, 0.4])[:, None], bad])
    prior = 0.7
    model = quality.fit(positive, unlabelled, prior, steps=3000, ridge=0.0)
    p, u = (np.array([(x == v).mean() for v in values]) for x in (positive, unlabelled))
    raw = np.zeros(4)

    def risk(raw):
        minus = u @ np.logaddexp(0, raw) - prior * p @ np.logaddexp(0, raw)
        return prior * p @ np.logaddexp(0, -raw) + max(0.0, minus)

    for _ in range(20_000):
        s = 1 / (1 + np.exp(-raw))
        minus = u @ np.logaddexp(0, raw) - prior * p @ np.logaddexp(0, raw)
        raw -= 0.5 * (prior * p * (s - 1) + (u * s - prior * p * s if minus >= 0 else 0))
    found = model.raw(values[:, None])
    assert risk(found) < risk(raw) + 2e-3
