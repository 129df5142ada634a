"""Substring dedup by fixed-block anchors: removes words of 50-word windows that a document with a smaller id has too.

Non-overlapping blocks of 25 words, counted from the start of a document, are indexed with the smallest id that has
them. Every rolling window of 25 words is a probe. Any 50-word window holds a whole block of each document it occurs in,
so hits lead to all windows that can be repeated; each is extended and compared over its 50 words, by 128 bits of hash
and then word by word (hashes of words), and runs of repeated windows are the maximal exact repeats.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from sumforge.llm._shared import Memo, table
from sumforge.llm.repeats import Kind, gram_hashes, removed, repeated, rolling_pair

WINDOW, BLOCK_WORDS = 50, 25
_words = Memo(xxhash.xxh3_64_intdigest, 200_000)


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_symbols(text: str | None) -> tuple[bytes, np.ndarray]:
    words = _split(text)
    return b" ".join(words), np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def repeated_windows(kind: Kind, contexts: list[np.ndarray], ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each context whether each of its windows occurs in a document with a smaller id."""
    L = kind.window
    data = np.concatenate(contexts)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    begin = ends - sizes
    owner = np.repeat(np.arange(len(contexts)), sizes)
    inside = np.arange(len(data)) - begin[owner]
    doc = ids[owner]
    whole = inside + BLOCK_WORDS <= sizes[owner]
    grams = np.zeros(len(data), np.uint64)
    found = gram_hashes(data, BLOCK_WORDS)
    grams[: len(found)] = found
    # the index: blocks at multiples of their length in their document, with the smallest id that has each
    block = np.flatnonzero(whole & ((starts[owner] + inside) % BLOCK_WORDS == 0))
    order = block[np.lexsort((doc[block], grams[block]))]
    new = np.r_[True, grams[order][1:] != grams[order][:-1]] if len(order) else np.zeros(0, bool)
    known, least = grams[order][new], doc[order][new]
    # the probes: every rolling window
    slot = np.minimum(np.searchsorted(known, grams), max(0, len(known) - 1))
    hit = whole & (known[slot] == grams) & (least[slot] < doc) if len(known) else np.zeros(len(data), bool)
    # windows that hold a hit, and those that they can equal: the windows that hold an indexed block that was hit
    asked = np.zeros(len(data), bool)
    asked[block] = np.isin(grams[block], grams[hit])
    total = np.r_[0, np.cumsum(hit | asked)]
    window = np.flatnonzero(inside + L <= sizes[owner])
    window = window[total[window + L - BLOCK_WORDS + 1] > total[window]]
    exact = np.zeros(len(data), bool)
    if len(window):
        one, other = rolling_pair(data)
        exact[window] = repeated(np.stack([one.of(window, L), other.of(window, L)], axis=1), doc[window], False, data, window, L)
    return [exact[a : b - L + 1] for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]


def _without(text: str | None, spans: list) -> bytes:
    words, at, kept = _split(text), 0, []
    for a, b in spans:
        kept += words[at:a]
        at = b
    return b" ".join([*kept, *words[at:]])


KIND = Kind("substring", WINDOW, BLOCK_WORDS, "u8", word_symbols, repeated_windows, False, 10)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256, spans) of every row; spans are runs of words.

    Words are runs of anything but ASCII white space, unchanged; a null text has none. A word goes if a 50-word window
    that covers it also starts in a row with a smaller id; windows are judged on the input. Rows with one id are not
    judged against each other, whether their texts are equal or not; a null id counts as the smallest. Other columns are
    not read. The result also has tag, a hash of the text, which tells rows with one id apart.
    """
    return removed(docs, KIND, _without, id_col=id_col, text_col=text_col).withColumnsRenamed({"n": "n_words"})


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return dedup(table(spark, sf_dir, "documents")).drop("spans", "n_spans", "tag")


ORACLE_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents
), p AS (
  SELECT doc_id, l, unnest(range(1, len(l) - 48)) AS i FROM w WHERE len(l) >= 50
), k AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(l[i : i + 49], ' ')) AS h FROM p
), m AS (
  SELECT h, min(doc_id) AS least FROM k GROUP BY h
), r AS MATERIALIZED (
  SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM k JOIN m USING (h) WHERE least < doc_id)
), words AS (
  SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS j FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS s FROM words WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = words.doc_id AND r.j = words.j) GROUP BY doc_id
), gone AS (
  SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id
)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
