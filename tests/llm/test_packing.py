import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sumforge.llm.packing import WINDOW, fill, pack
from tests.llm.conftest import HARD


@pytest.mark.parametrize("texts", [[], [None], HARD, [f"topic{k % 7} " * 300 + str(k) for k in range(60)]])
def test_every_id_once_without_padding(documents, texts):
    rows = pack(documents(texts), shard_tokens=20_000).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in enumerate(texts)}
    covered = {k: 0 for k in ids}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == covered[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert covered == {k: len(v) for k, v in ids.items()}
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= WINDOW and at & (at - 1) == 0


def test_seed_is_followed_by_its_nearest():
    rng = np.random.default_rng(0)
    topics = [rng.integers(1000 * k, 1000 * k + 60, (6, 300)) for k in range(4)]
    docs = [topics[k % 4][k // 4].astype("<u2") for k in range(24)]
    idf = np.ones(5000, np.float32)
    first = [d for d, _, _ in fill(docs, idf, 300.0)[0]]
    assert [d % 4 for d in first[:6]] == [0] * 6


def test_same_rows_each_time(documents):
    texts = HARD * 4
    assert sorted(pack(documents(texts)).collect()) == sorted(pack(documents(texts).repartition(7)).collect())


def test_neighbours_meet_from_all_shards(documents):
    rng = np.random.default_rng(1)
    words = [[f"w{k}x{rng.integers(10**6)}" for _ in range(40)] for k in range(12)]
    texts = [" ".join(rng.choice(words[k % 12], 60)) for k in range(240)]
    rows = pack(documents(texts), shard_tokens=8_000).collect()
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r.doc_id % 12)
    alike = sum(max(map(w.count, w)) for w in windows.values()) / sum(map(len, windows.values()))
    assert alike > 0.7


def test_scores_are_those_of_plain_bm25():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 90, int(n)).astype("<u2") for n in rng.integers(1, 200, 50)]
    idf = rng.random(90).astype(np.float32)
    mean = float(np.mean([len(d) for d in docs]))
    from sumforge.llm import packing

    for dense in (0, 7, 90):
        packing.DENSE, before = dense, packing.DENSE
        index = packing.Index(docs, idf, mean)
        packing.DENSE = before
        for query in docs[:10]:
            want = [sum(idf[t] * (tf := int((d == t).sum())) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(query.tolist()) if (d == t).any()) for d in docs]
            assert np.allclose(index.scores(query), want, rtol=1e-4)


def test_copies_spread_over_shards(documents):
    rows = pack(documents(["the very same text " * 40] * 300 + [f"another {k}" for k in range(50)]), shard_tokens=2_000).collect()
    assert len({r.sequence_id >> 32 for r in rows}) > 5 and sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_shards_of_short_documents_are_small(documents, monkeypatch):
    from sumforge.llm import packing

    monkeypatch.setattr(packing, "SHARD_DOCS", 50)
    rows = pack(documents([f"t{k}" for k in range(300)]), shard_tokens=2_000).collect()
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id >> 32, set()).add(r.doc_id)
    assert len(held) >= 5 and max(map(len, held.values())) <= 100
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
