import hashlib
import random

import numpy as np
import pytest

from sumforge.llm import repeats, substring_dedup, suffix_dedup
from tests.llm.conftest import HARD


def corpus(seed=0):
    rng = random.Random(seed)
    words = [f"w{k}x" for k in range(500)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [make(rng.randrange(45, 200)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [make(rng.randrange(0, 90))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p))
            parts += [p[a : a + rng.randrange(10, 200)], make(rng.randrange(0, 40))]
        texts.append(" ".join(w for part in parts for w in part))
    long = " ".join(make(700))
    return texts + [long, long[:2500] + "!" + long[2500:], long, "ab" * 700, "z" * 900, texts[3] + " " + texts[3]] + HARD


def brute(symbols, size, anywhere):
    """Covered symbols of each sequence."""
    seen = {}
    for d, s in enumerate(symbols):
        for p in range(len(s) - size + 1):
            seen.setdefault(tuple(s[p : p + size]) if isinstance(s, list) else s[p : p + size], []).append(d)
    out = []
    for d, s in enumerate(symbols):
        gone = [False] * len(s)
        for p in range(len(s) - size + 1):
            where = seen[tuple(s[p : p + size]) if isinstance(s, list) else s[p : p + size]]
            if len(where) > 1 if anywhere else where[0] < d:
                gone[p : p + size] = [True] * size
        out.append(gone)
    return out


@pytest.mark.parametrize(("hot", "very"), [(4096, 20_000), (2, 20_000), (2, 2)])
def test_suffix_dedup(documents, monkeypatch, hot, very):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "VERY_HOT", very)
    texts = corpus()
    data = [(t or "").encode() for t in texts]
    rows = {r.doc_id: r for r in suffix_dedup.dedup(documents(texts)).collect()}
    assert len(rows) == len(texts)
    for d, gone in enumerate(brute(data, 400, True)):
        kept = bytes(b for b, g in zip(data[d], gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (rows[d].n_bytes, rows[d].n_removed, rows[d].n_spans, rows[d].kept_sha256) == (len(data[d]), sum(gone), spans, hashlib.sha256(kept).hexdigest()), d


@pytest.mark.parametrize(("hot", "very"), [(4096, 20_000), (2, 2)])
def test_substring_dedup(documents, monkeypatch, hot, very):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "VERY_HOT", very)
    texts = corpus(1)
    words = [(t or "").encode().split() for t in texts]
    rows = {r.doc_id: r for r in substring_dedup.dedup(documents(texts)).collect()}
    for d, gone in enumerate(brute(words, 50, False)):
        kept = b" ".join(w for w, g in zip(words[d], gone, strict=True) if not g)
        assert (rows[d].n_words, rows[d].n_removed, rows[d].kept_sha256) == (len(words[d]), sum(gone), hashlib.sha256(kept).hexdigest()), d


@pytest.mark.parametrize("hot", [4096, 20])
def test_a_key_many_times_in_a_text(documents, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    tables = {}
    monkeypatch.setattr(repeats, "written", lambda df, name, put=repeats.written: tables.setdefault(name, put(df, name)))
    texts = ["a b " * n + f"end {n} " + "a b " * 40 for n in range(200, 230)] + ["c d " * 300]
    words = [t.encode().split() for t in texts]
    rows = {r.doc_id: r for r in repeats.removed(documents(texts), suffix_dedup.WORDS, suffix_dedup._nothing, id_col="doc_id", text_col="text").collect()}
    for d, gone in enumerate(brute(words, 50, True)):
        assert rows[d].n_removed == sum(gone), d
    keys = [(r.k, r.key) for r in tables["suffix-words-keys"].collect()]
    kind = suffix_dedup.WORDS
    grams = [repeats.gram_hashes(kind.parse(t)[1], kind.gram) for t in texts]
    at = [g[repeats.anchors(g, kind.window - kind.gram + 1)[0]].view(np.int64).tolist() for g in grams]
    assert sorted(keys) == sorted((d, key) for d, own in enumerate(at) for key in set(own))
    assert {r.key: r.n for r in tables["suffix-words-shared"].collect()}.items() >= {key: n for own in at for key in own if (n := sum(x.count(key) for x in at)) > 1}.items()


def test_empty_tables(documents):
    assert suffix_dedup.dedup(documents([])).collect() == []
    assert substring_dedup.dedup(documents([])).collect() == []


@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for n in [0, 1, 2, 3, 10, 50, 300]:
        for _ in range(20):
            s = rng.integers(0, letters, n)
            assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_anchors_own_every_window():
    rng = np.random.default_rng(0)
    for letters in (1, 2, 200):
        grams = rng.integers(0, letters, 90).astype(np.uint64)
        at, first, last = repeats.anchors(grams, 7)
        got = {p: a for a, f, l in zip(at, first, last, strict=True) for p in range(f, l + 1)}
        assert got == {p: p + int(np.argmin(grams[p : p + 7])) for p in range(84)}
