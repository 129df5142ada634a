import hashlib
import re

import pytest

from sumforge.llm.exact_dedup import dedup
from tests.llm.conftest import HARD


def brute(rows):
    norm = [(i, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in rows]
    out = []
    for i, _, n in norm:
        same = [(-len(t), j) for j, t, m in norm if m == n]
        keep = min(same)[1]
        out.append((i, keep, len(same), keep == i, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


def test_hard_texts_against_brute_force(documents):
    texts = HARD + ["a b ", "ab", "b a"] * 5
    got = sorted(tuple(r) for r in dedup(documents(texts)).collect())
    assert got == brute(list(enumerate(texts)))


def test_negative_and_null_ids(documents):
    rows = {r.doc_id: r for r in dedup(documents(["x", "x", "y"], [-5, None, None])).collect() if r.doc_id is not None or r.keep_id is None}
    assert rows[-5].kept and rows[-5].group_size == 2
    assert rows[None].keep_id is None and not rows[None].kept


@pytest.mark.parametrize("texts", [[], ["same"] * 40])
def test_empty_table_and_one_group(documents, texts):
    rows = dedup(documents(texts)).collect()
    assert len(rows) == len(texts) and sum(r.kept for r in rows) == min(1, len(texts))
