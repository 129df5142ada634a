"""Lexical retrieval packing: a sharded BM25 index fills each seed document's window with its unused neighbours.

Token ids serve as the terms of the index. Their document frequencies and the mean length are counted over all
documents; the table of frequencies has one entry per vocabulary id, so it is small whatever the corpus.

Documents are dealt into shards by content, so that neighbours meet: they are put in the order of their cluster and of
weighted min-hashes of their terms, which Spark cuts into ranges of about shard_tokens, fewer where documents are very short. A document longer than a window
fills whole windows by itself, where it lies; only what it has behind them is dealt, so rows are of bounded size. A cluster or a text of any number
of copies is spread over as many shards as it takes. Each shard has an inverted index; its documents become seeds in
turn, and a seed's window is filled with the unused documents that score highest for all of the seed's terms. What
overhangs a window is cut there and seeds the next one. A shard's last, partial window is cut into powers of two, which
are not padded; so there is no padding at all. The work follows the number of documents, whatever their total.
"""

from __future__ import annotations

import ctypes
import json
import zlib
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumforge.llm._shared import table, written
from sumforge.llm.token_counts import byte_alphabet

WINDOW = 2048
#: Follows each document's ids.
END_ID = 1
K1, B = 1.2, 0.75
#: Tokens of a shard, on average.
SHARD_TOKENS = 2_000_000
#: Documents of a shard at most, on average: its matrix has a column for each.
SHARD_DOCS = 25_000
#: So many of a shard's commonest terms are scored by a matrix product, the others by postings; the sum is the same.
DENSE = 512
#: Clusters, the documents they are learnt from at most, and dimensions of their vectors. Every document is then placed.
CLUSTERS, SAMPLE, DIMENSIONS = 64, 8192, 64
#: Rows whose ids are held together.
BATCH_ROWS = 1000
#: Texts with a longer run of characters between spaces go to the slower library.
LONG_WORD = 1000


class Ids:
    """A text's ids as the tokenizers library gives them for a byte-level BPE .json; special strings keep its default.

    Where the order of the merges is that of the ids, which is so for the public vocabularies, a faster library merges
    by id with the same result. Other files, texts with special strings and those with very long words, where the
    faster one takes quadratic time, go to the library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        vocabulary = {token: i for token, i in model["vocab"].items() if token not in self.specials}
        merged = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"])
        order = [vocabulary.get(t, -1) for t in merged]
        self.fast = None
        if order == sorted(set(order)) and -1 not in order and all(c in byte for t in vocabulary for c in t):
            ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def slow(self, text: str) -> bool:
        """Whether the library itself is asked. A run of LONG_WORD characters without a space fills one of the parts looked at."""
        if self.fast is None or any(s in text for s in self.specials):
            return True
        half = LONG_WORD // 2
        return len(text) > LONG_WORD and (" " * LONG_WORD in text or any(text.find(" ", a, a + half) < 0 for a in range(0, len(text) - half + 1, half)))

    def of(self, text: str) -> array:
        return array("H" if self.size <= 1 << 16 else "I", self.tokenizer.encode(text, add_special_tokens=False).ids if self.slow(text) else self.fast.encode_ordinary(text))


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_ids(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids binary little-endian unsigned, n): each text's ids and END_ID, of 16 bits where the vocabulary allows."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches):
        tokens = ids_of(vocabulary or default_vocabulary())
        for whole in batches:
            for a in range(0, len(whole), BATCH_ROWS):  # one text at a time is a Python string
                batch, out, n = whole.slice(a, BATCH_ROWS), [], []
                for text in batch.column(1):
                    ids = tokens.of(text.as_py())
                    ids.append(END_ID)
                    out.append(ids.tobytes())
                    n.append(len(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(n, pa.int64())], ["doc_id", "ids", "n"])

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, ids binary, n long")


def _frequencies(tokens: DataFrame) -> np.ndarray:
    """In how many documents each id occurs; index = id."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.unique(np.frombuffer(ids, f"<u{len(ids) // n}"))
                if found[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(found[-1]) + 1 - len(total), np.int64)])
                total[found] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "df"])

    # as many rows as ids in the vocabulary, however large the corpus
    rows = tokens.select("ids", "n").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(int(rows.term.max()) + 1 if len(rows) else 1, np.int64)
    out[rows.term.to_numpy(np.int64)] = rows.df.to_numpy(np.int64)
    return out


def impact(idf: np.ndarray, tf: np.ndarray, size: np.ndarray | int, mean: float) -> np.ndarray:
    """BM25 of a term that occurs tf times in a document of size terms."""
    return (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))).astype(np.float32)


class Index:
    """An inverted BM25 index over the documents of a shard: postings, and for the commonest terms a matrix of impacts."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(d) for d in docs], np.int64)
        n = len(docs)
        keys = np.concatenate(docs).astype(np.int64)
        keys *= n
        keys += np.repeat(np.arange(n), sizes)
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        tf = np.diff(np.r_[first, len(keys)])
        keys = keys[first]
        terms, doc = np.divmod(keys, n)
        self.impact = impact(idf[terms], tf, sizes[doc], mean)
        self.start = np.searchsorted(terms, np.arange(len(idf) + 1))
        self.doc, self.n = doc.astype(np.int32), n
        common = np.argsort(-np.diff(self.start), kind="stable")[:DENSE]
        self.row = np.full(len(idf), -1, np.int32)
        self.row[common] = np.arange(len(common))
        row = self.row[terms]
        self.dense = np.zeros((len(common), n), np.float32)
        self.dense[row[row >= 0], self.doc[row >= 0]] = self.impact[row >= 0]

    def scores(self, text: np.ndarray) -> np.ndarray:
        """Each document's score for all of the text's terms."""
        terms = np.unique(text)
        row = self.row[terms]
        rare = terms[row < 0].astype(np.int64)
        present = np.zeros(len(self.dense), np.float32)
        present[row[row >= 0]] = 1
        start, length = self.start[rare], self.start[rare + 1] - self.start[rare]
        ends = np.cumsum(length)
        at = np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        return present @ self.dense + np.bincount(self.doc[at], self.impact[at], self.n)

    def neighbours(self, text: np.ndarray, unused: np.ndarray, count: int) -> np.ndarray:
        """Unused documents by descending score for all of the text's terms, ties by position; then any others."""
        score = self.scores(text)
        score[~unused] = -1
        count = min(count, int(unused.sum()))
        if count < len(score):
            best = np.argpartition(-score, count)[:count] if count else np.zeros(0, np.int64)
        else:
            best = np.arange(len(score))
        return best[np.lexsort((best, -score[best]))]


def fill(docs: list[np.ndarray], idf: np.ndarray, mean: float) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that take every token once."""
    if not docs:
        return []
    index = Index(docs, idf, mean)
    unused = np.ones(len(docs), bool)
    per_doc = max(1, sum(map(len, docs)) // len(docs))
    ask = max(8, 2 * WINDOW // per_doc)
    done: list[list[tuple[int, int, int]]] = []
    window: list[tuple[int, int, int]] = []
    room, seed, queue, waiting = WINDOW, 0, [], 0
    while True:
        if waiting < len(queue):
            at = int(queue[waiting])
            waiting += 1
            if not unused[at]:
                continue
        elif window:  # ask again for the one that began this window
            doc, start, length = window[0]
            queue, waiting = index.neighbours(docs[doc][start : start + length], unused, ask), 0
            if not len(queue):
                break
            continue
        else:
            while seed < len(docs) and not unused[seed]:
                seed += 1
            if seed == len(docs):
                break
            at = seed
        unused[at] = False
        start, n = 0, len(docs[at])
        while start < n:
            length = min(room, n - start)
            window.append((at, start, length))
            start += length
            room -= length
            if not room:
                done.append(window)
                window, room, queue, waiting = [], WINDOW, [], 0
    for power in (1 << k for k in range(WINDOW.bit_length() - 1, -1, -1)):  # what is left over, without padding
        while sum(p[2] for p in window) >= power:
            taken, need = [], power
            while need:
                doc, start, length = window.pop(0)
                part = min(length, need)
                taken.append((doc, start, part))
                need -= part
                if part < length:
                    window.insert(0, (doc, start + part, length - part))
            done.append(taken)
    return done


@lru_cache(maxsize=1)
def projection(terms: int) -> tuple[np.ndarray, np.ndarray]:
    """A random sign for each term and dimension; two exponential variates for each term."""
    rng = np.random.default_rng(1)
    signs = rng.integers(0, 2, (terms, DIMENSIONS), np.int8).astype(np.float32) * 2 - 1
    return signs, rng.exponential(size=(2, terms)).astype(np.float32)


class Router:
    """Places documents on a line on which lexical neighbours are close: by cluster, then by weighted min-hashes.

    A document's vector is a random projection of the BM25 impacts of its terms; its cluster is that of the nearest centre.
    Two documents share a min-hash with a probability that is the weighted Jaccard similarity of their impacts.
    """

    def __init__(self, idf: np.ndarray, mean: float, centres: np.ndarray | None = None, middle: np.ndarray | None = None):
        self.idf, self.mean, self.centres, self.middle = idf, mean, centres, middle
        self.signs, self.spans = projection(len(idf))

    def weights(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        terms, tf = np.unique(ids, return_counts=True)
        return terms, impact(self.idf[terms], tf, len(ids), self.mean)

    def vector(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        v = weight @ self.signs[terms]
        return v / max(1e-9, float(np.sqrt(v @ v)))

    def place(self, ids: np.ndarray) -> tuple[int, int]:
        terms, weight = self.weights(ids)
        v = self.vector(terms, weight) - self.middle
        one, other = (int(terms[(s[terms] / np.maximum(weight, 1e-9)).argmin()]) for s in self.spans)
        return int((self.centres @ v).argmax()), one << 32 | other


def centres_of(vectors: np.ndarray, clusters: int, rounds: int = 12) -> np.ndarray:
    """Centres of spherical k-means, in an order in which each is followed by the one most like it of those left."""
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    centres = v[np.linspace(0, len(v) - 1, min(clusters, len(v))).astype(np.int64)].copy()
    for _ in range(rounds):
        nearest = (v @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, v)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    alike, order = centres @ centres.T, [0]
    left = np.ones(len(centres), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, alike[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return centres[order].astype(np.float32)


def routed(tokens: DataFrame, n: int, idf, mean: float) -> DataFrame:
    """What tokens, n of them, have behind their whole windows: (doc_id, ids, whole, n, start, doc_tokens, cluster, near).

    whole has the CRC of each whole window, which needs nothing else to be a sequence.
    cluster and near are the place on the line; centres are learnt from SAMPLE documents at most.
    """
    chance = min(1.0, 2 * SAMPLE / max(1, n))
    picked = tokens.where(F.pmod(F.xxhash64("doc_id", "n", F.lit(3)), F.lit(1 << 20)) < int(chance * (1 << 20)) + 1)

    def vectors(batches):
        router = Router(idf.value, mean)
        for batch in batches:
            found = [router.vector(*router.weights(t)).tolist() for t in unpacked(batch.column(0), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(found, pa.list_(pa.float32()))], ["h", "v"])

    sample = picked.select("ids", "n", F.xxhash64("doc_id", "n").alias("h")).mapInArrow(vectors, "h long, v array<float>").orderBy("h").limit(SAMPLE).toArrow()
    v = np.array(sample.column("v").to_pylist(), np.float32).reshape(-1, DIMENSIONS)
    middle = v.mean(axis=0) if len(v) else np.zeros(DIMENSIONS, np.float32)
    centres = centres_of(v - middle, CLUSTERS) if len(v) else np.zeros((1, DIMENSIONS), np.float32)
    shared = tokens.sparkSession.sparkContext.broadcast((centres, middle))

    def run(batches):
        router = Router(idf.value, mean, *shared.value)
        for batch in batches:
            out: list[tuple] = []
            sizes = batch.column("n").to_pylist()
            for text, n in zip(unpacked(batch.column("ids"), sizes), sizes, strict=True):
                start = n - n % WINDOW
                whole = [crc(text[a : a + WINDOW]) for a in range(0, start, WINDOW)]
                out.append((text[start:].tobytes(), whole, n - start, start, n, *router.place(text[start:] if start < n else text[-WINDOW:])))
            ids, whole, *numbers = zip(*out, strict=True) if out else [()] * 7
            names = ["doc_id", "ids", "whole", "n", "start", "doc_tokens", "cluster", "near"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(whole, pa.list_(pa.int64())), *(pa.array(x, pa.int64()) for x in numbers)], names)

    return tokens.mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, ids binary, whole array<long>, n long, start long, doc_tokens long, cluster long, near long")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def released() -> None:
    """Gives what a shard's index took back to the system, for a worker goes on to other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def unpacked(ids: pa.ChunkedArray | pa.Array, sizes: list[int]) -> list[np.ndarray]:
    return [np.frombuffer(x, f"<u{len(x) // n}" if n else "<u2") for x, n in zip(ids.to_pylist(), sizes, strict=True)]


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document, END_ID included, lies in exactly one piece; a sequence has 2048 ids, or, at the end of a
    shard, a smaller power of two. A null or empty text is END_ID alone. Rows with the same id are documents of their
    own. shard_tokens: of a shard, on average. sequence_id is unique, not gapless. Other columns are not read.
    """
    tokens = written(token_ids(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary), "packing-ids")
    n_docs, total = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _frequencies(tokens)
    mean = total / max(1, n_docs)
    # one entry per vocabulary id
    idf = tokens.sparkSession.sparkContext.broadcast(np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32))
    places = written(routed(tokens, n_docs, idf, mean), "packing-places")
    each = -(-shard_tokens // SHARD_DOCS)  # a document weighs as much as so many tokens, so that shards of short ones stay small
    load = places.agg(F.coalesce(F.sum(F.col("n") + each), F.lit(0))).first()[0]
    kind = tokens.schema["doc_id"].dataType.simpleString()
    # many equal documents have one place: the salt lets them fall in several shards
    dealt = places.withColumn("salt", F.xxhash64("doc_id", "doc_tokens")).repartitionByRange(max(1, -(-load // shard_tokens)), "cluster", "near", "salt")

    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        partition = TaskContext.get().partitionId()
        rows = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("cluster", "near", "salt", "doc_id", "ids")])
        sizes = rows.column("n").to_numpy()
        loads = sizes + each
        before, held_load = np.cumsum(loads) - loads, int(loads.sum())
        # ranges are cut by a sample of rows, so some are larger than others: cut once more where they are
        shard = before * -(-held_load * 2 // (3 * shard_tokens)) // held_load
        sequence = partition << 32
        for a, b in pairwise([*np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]).tolist(), len(rows)]):
            part = rows.slice(a, b - a)
            texts, first = unpacked(part.column("ids"), part.column("n").to_pylist()), part.column("start").to_pylist()
            doc, start, length, crcs, number, offset = ([] for _ in range(6))
            some = [d for d, t in enumerate(texts) if len(t)]
            sequences = [[(some[d], first[some[d]] + s, n, crc(texts[some[d]][s : s + n])) for d, s, n in pieces] for pieces in fill([texts[d] for d in some], idf.value, mean)]
            sequences += [[(d, k * WINDOW, WINDOW, c)] for d, whole in enumerate(part.column("whole").to_pylist()) for k, c in enumerate(whole)]
            for pieces in sequences:
                at = 0
                for d, s, n, c in pieces:
                    for column, value in zip((doc, start, length, crcs, number, offset), (d, s, n, c, sequence, at), strict=True):
                        column.append(value)
                    at += n
                sequence += 1
            taken = part.select(["doc_id", "doc_tokens"]).take(pa.array(doc, pa.int64())).combine_chunks()
            ids, all_tokens = (taken.column(c).chunk(0) for c in ("doc_id", "doc_tokens"))
            released()
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in (start, length, crcs)), all_tokens, *(pa.array(c, pa.int64()) for c in (number, offset))], PIECE)

    packed = dealt.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("doc_id", id_col)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return pack(table(spark, sf_dir, "documents"))
