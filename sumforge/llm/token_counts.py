"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token is a doubly linked list of symbols; a heap holds the ranks of its adjacent pairs. The lowest-rank pair
is popped and merged until none is left: the count is the number of symbols less the number of merges, and no
identifier is ever looked up. Special strings inside a text count as one token each, as the library has it by default.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumforge.llm._shared import Memo, WordWise, table


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class MergeCounter:
    """Counts the tokens of a text under the merges of a byte-level BPE file (.json of the tokenizers library)."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = spec["model"]["merges"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges)
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.alphabet = byte_alphabet()
        specials = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.special_texts = specials
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.pretokens = Memo(self.of_pretoken, 400_000)
        self.words = WordWise(self.of_unit, self.split)

    def of_unit(self, unit: str) -> int:
        return sum(map(self.pretokens.__getitem__, self.split(unit)))

    def of_pretoken(self, pretoken: str) -> int:
        alphabet, ranks = self.alphabet, self.ranks
        symbols: list[str | None] = [alphabet[b] for b in pretoken.encode()]
        n = len(symbols)
        heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if j >= n or symbols[i] is None or ranks.get((symbols[i], symbols[j])) != rank:
                continue  # one of its ends has been merged away since
            symbols[i] += symbols[j]
            symbols[j] = None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heappush(heap, (r, h))
        return n - merges

    def count(self, text: str) -> int:
        if self.specials and any(s in text for s in self.special_texts):
            parts = self.specials.split(text)
            return sum(sum(self.words.values(p)) for p in parts if p) + len(parts) - 1
        return sum(self.words.values(text)) if text else 0


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_col, n_bytes, n_tokens) for each row of docs, in one pass without a shuffle.

    vocabulary: path of a byte-level BPE .json, by default the 50k file. A null text is an empty one: 0 bytes,
    0 tokens. Repeated rows and null ids give a row each; other columns are not read.
    """
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    id_type = source.schema[0].dataType.simpleString()

    def run(batches):
        path = vocabulary or default_vocabulary()
        count = counter(path).count
        for batch in batches:
            texts = batch.column(1)
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            counts = pa.array([count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, counts], ["id", "n_bytes", "n_tokens"])

    return source.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op5(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every document."""
    counts = token_counts(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
