import zlib

import numpy as np
import pytest

from sumforge.llm import sharding
from tests.llm.conftest import HARD


def run(spark, documents, path, texts):
    documents(texts).write.parquet(f"{path}/documents.parquet")
    return sharding.op6(spark, str(path)).collect()


@pytest.mark.parametrize("texts", [[], [None], HARD, ["hot copy " * 50] * 400 + [f"text {k} " * (k % 90) for k in range(1200)]])
def test_rows_sizes_and_slots(spark, documents, tmp_path, texts):
    rows = run(spark, documents, tmp_path, texts)
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    slots = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert 0 <= r.shard < 16
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_balance_with_a_group_of_a_third(spark, documents, tmp_path):
    rng = np.random.default_rng(1)
    texts = ["hot copy " * 50] * 700 + [" ".join(["w"] * int(k)) for k in rng.integers(1, 400, 1400)]
    rows = run(spark, documents, tmp_path, texts)
    sizes = np.bincount([r.shard for r in rows], [r.size for r in rows], 16)
    assert sizes.max() / sizes.mean() < 1.01
    light = {}
    for r in rows:
        light.setdefault(texts[r.doc_id], set()).add(r.shard)
    total = sum(len(t) + 1 for t in texts)
    words = sum(len(t.split()) for t in texts)
    for t, shards in light.items():
        n = texts.count(t)
        if max(n * (len(t) + 1) / total, n * len(t.split()) / words, n / len(texts)) <= sharding.CUT / 16:
            assert len(shards) == 1


def test_dot_product_rule():
    residual = np.array([[0.5, 0.1], [0.2, 0.9]])
    assert sharding.place(np.array([[1.0, 0.0], [0.0, 1.0]]) * 0.1, residual).tolist() == [0, 1]
    assert np.allclose(residual, [[0.4, 0.1], [0.2, 0.8]])


def test_placing_against_plain_python():
    rng = np.random.default_rng(2)
    demand, residual = rng.random((60, 3)) / 100, np.full((5, 3), 0.2)
    want, left = [], residual.copy().tolist()
    for item in demand.tolist():
        products = [sum(w * d * r for w, d, r in zip(sharding.WEIGHTS, item, row, strict=True)) for row in left]
        at = products.index(max(products))
        want.append(at)
        left[at] = [r - d for r, d in zip(left[at], item, strict=True)]
    assert sharding.place(demand, residual, sharding.WEIGHTS).tolist() == want and np.allclose(residual, left)
