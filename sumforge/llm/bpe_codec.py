"""Byte-level BPE encoding and decoding by longest matches and backtracking.

Bytes are mapped to Latin-1, so that an Aho-Corasick automaton over the vocabulary finds the longest token at each
position. The encoder takes the longest token that is compatible with the token before it, and backtracks where none
is. Two tokens are compatible if the merges, applied to their joined bytes, give back exactly these two; that is
memoised for each pair. A sequence whose neighbours are all compatible is the one that the merges give, and a position
once found to be a dead end is not tried again, so the time is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumforge.llm._shared import Memo, WordWise, table


class Codec:
    """Encodes and decodes with the ranks of a .tiktoken file, as the tiktoken library does, without special tokens."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.parts = Memo(self._halves, 1_000_000)
        self.shorter = Memo(self._shorter, 1_000_000)
        self.fits = Memo(self._fits, 1_000_000)
        self.pretokens = Memo(self._packed, 400_000)
        self.words = WordWise(self._unit, self.split)
        size = max(self.tokens, default=-1) + 1
        lengths = np.zeros(size, np.int64)
        for rank, token in self.tokens.items():
            lengths[rank] = len(token)
        self.sizes = lengths.tolist()
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.pool = np.frombuffer(b"".join(self.tokens.get(r, b"") for r in range(size)), np.uint8)

    def _halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes."""
        token = self.tokens[rank]
        pieces = [token[i : i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            best = min(((r, i) for i in range(len(pieces) - 1) if (r := self.ranks.get(pieces[i] + pieces[i + 1])) is not None), default=None)
            if best is None:
                return None
            i = best[1]
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        return (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None

    def _shorter(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        token = self.tokens[rank]
        return next((r for n in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:n])) is not None), None)

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether the merges keep the border between these tokens.

        Takes the merges inside both tokens back, the latest first; at each point the border must not itself be a merge
        that comes before the one just taken back. Equal ranks are merged from the left, so on the right side a merge
        of the border with the same rank comes first.
        """
        left, right = pair
        tokens, ranks, parts = self.tokens, self.ranks, self.parts
        before = len(self.lengths) + 1  # a merge of the border with a rank below this one would have happened
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < before:
                return False
            undo_left, undo_right = parts[left], parts[right]
            if undo_left is None and undo_right is None:
                return True
            if undo_right is None or (undo_left is not None and left > right):
                before, left = left, undo_left[1]
            else:
                before, right = right + 1, undo_right[0]

    def encode_pretoken(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [-1] * n
        for end, (rank, size) in self.automaton.iter(data.decode("latin-1")):
            longest[end - size + 1] = rank  # ends ascend, so the longest stays
        fits, shorter, sizes = self.fits, self.shorter, self.sizes
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else None
            while token is not None:
                end = at + sizes[token]
                if not dead[end] and (last is None or fits[last, token]):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else None
                    break
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= sizes[token]
        return out

    def _packed(self, pretoken: str) -> bytes:
        ids = self.encode_pretoken(pretoken.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, self.split(unit)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.words.values(text)) if text else b""

    def decode(self, ids: bytes) -> bytes:
        tokens = np.frombuffer(ids, "<u4")
        if not len(tokens):
            return b""
        sizes = self.lengths[tokens]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[tokens] - (ends - sizes), sizes)
        at += np.arange(ends[-1])
        return self.pool[at].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(id_col, ids binary): little-endian unsigned 32-bit ids of each text; one pass, no shuffle.

    A null or empty text has no ids. Repeated rows and null ids give a row each; other columns are not read.
    """
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches):
        c = codec(ranks or default_ranks())
        for batch in batches:
            ids = pa.array([c.encode(t) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    return source.mapInArrow(run, f"id {source.schema[0].dataType.simpleString()}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """(id_col, decoded binary) from ids as encode() gives them; null ids decode to nothing."""
    source = encoded.select(F.col(id_col), F.col(ids_col).alias("__ids"))

    def run(batches):
        c = codec(ranks or default_ranks())
        for batch in batches:
            data = pa.array([c.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data], ["id", "decoded"])

    return source.mapInArrow(run, f"id {source.schema[0].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encodes, decodes what was encoded, keeps only digests.

    Both directions in one pass, so that ids and bytes need not leave the worker. A null text is an empty one.
    """
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches):
        c = codec(ranks or default_ranks())
        for batch in batches:
            counts, ids_sha, data_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = c.encode(text)
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                data_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"id {source.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return round_trip(table(spark, sf_dir, "documents"))
