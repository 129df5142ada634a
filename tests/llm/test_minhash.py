import random

import numpy as np
import pytest

from sumforge.llm.graph import components
from sumforge.llm.minhash import near_groups, shingle_set, signatures
from tests.llm.conftest import HARD


def brute(texts, k):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


def families():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
            base = copy if rng.random() < 0.5 else base  # chains, where the ends are not alike
    return texts


@pytest.mark.parametrize("texts", [[], HARD, families() + HARD])
def test_against_brute_force(documents, texts):
    got = sorted(tuple(r) for r in near_groups(documents(texts), shingle=2).collect())
    assert got == brute(texts, 2)


def test_signatures_estimate_and_early_stop():
    rng = np.random.default_rng(1)
    for size in (3, 40, 400, 5000):
        pool = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
        a, b = np.unique(pool[: int(1.5 * size)]), np.unique(pool[size // 2 :])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = signatures([a, b, a[:0]])
        assert abs((s[0] == s[1]).mean() - true) < 0.16
        assert (signatures([b])[0] == s[1]).all()  # a set's signature does not depend on its neighbours


def test_shingles():
    assert len(shingle_set("A b a B a", 2)) == 2 and len(shingle_set("a", 2)) == 1 and len(shingle_set(" ", 2)) == 0


def test_components(spark):
    edges = [(k + 1, k) for k in range(50)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 200: 100, 300: 100}
