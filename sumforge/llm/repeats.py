"""Finds repeated windows of a fixed length in all texts: what substring dedup and suffix-array dedup share.

A text is a sequence of symbols, bytes or hashes of words. Every window is owned by its anchor: the gram of least hash
in it, the leftmost of equal ones. Equal windows have equal anchors at equal offsets, so only windows whose anchor's
gram occurs again can be repeated, and all occurrences of a window meet where its gram is the key:

1. the grams at anchors, one in about half a window, are counted over all texts that differ; a text has each of its keys
   once, with the number of its contexts;
2. the windows owned by anchors that occur again form contexts, which go to the bucket of their key, where a kernel
   finds the repeated ones;
3. a key with more than HOT contexts would be too large a group. Its windows are cut into blocks of a few starts at
   the same distances from the anchor, whose key is the core that all windows of a block share. Equal blocks are
   counted by Spark, and only one of each goes on; a core that still has too many different blocks is cut into single
   windows, which are counted by Spark too.

Texts that are equal as a whole count once here; the operators settle their copies beforehand. A row is known by its id
and a hash of its text, so that rows which share an id but not a text are kept apart; a null id counts as the smallest.
Windows are grouped by 128 bits of hash; inside a chunk, equal ones are then confirmed on the symbols themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumforge.llm._shared import written
from sumforge.llm.minhash import mix

HOT = 4096
VERY_HOT = 8192
BUCKET_BYTES = 2_000_000
BATCH_BYTES = 4_000_000
CHUNK_BYTES = 1_000_000
_BIG = np.iinfo(np.int64).max
_MAX = np.iinfo(np.uint64).max
#: What a null id counts as.
NO_ID = -(2**63)
CONTEXT = "key long, doc_id long, tag long, start long, data binary"
#: A block of a hot key, with all its places in the text.
BLOCKS = "key long, doc_id long, tag long, starts array<long>, data binary"
#: at: runs, each with start and stop in one number, start * 2^32 + stop; no text has 2^31 symbols.
RUN = "doc_id long, tag long, at array<long>"


@dataclass(frozen=True)
class Kind:
    """window and gram: lengths in symbols; dtype: of a symbol; parse: text to (bytes to digest, symbols)."""

    name: str
    window: int
    gram: int
    dtype: str
    parse: Callable[[str | None], tuple[bytes, np.ndarray]]
    kernel: Callable[[Kind, list[np.ndarray], np.ndarray, np.ndarray], list[np.ndarray]]
    #: Whether a window counts as repeated wherever it occurs again, or only where it occurs in a smaller id.
    anywhere: bool
    #: Starts in a block of windows of a hot key.
    block: int


def gram_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size symbols, by joining the hashes of halves."""
    n = len(symbols) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, width = mix(symbols.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    out, covered = None, 0
    while True:
        if size & width:
            part = level[covered : covered + n]
            out = part.copy() if out is None else out * np.uint64(0xD1342543DE82EF95) + part
            covered += width
        if covered == size:
            return mix(out)
        level = mix(level[:-width] * np.uint64(0x9FB21C651E98DF25) + level[width:])
        width *= 2


def anchors(grams: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): for each anchor the first and last start of the windows of span grams that it owns."""
    n = len(grams) - span + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    rows = -(-len(grams) // span)
    padded = np.full(rows * span, _MAX, np.uint64)
    padded[: len(grams)] = grams
    g = padded.reshape(rows, span)
    index = np.arange(rows * span).reshape(rows, span)
    head = np.minimum.accumulate(g, axis=1)
    fresh = np.ones(g.shape, bool)
    fresh[:, 1:] = head[:, 1:] < head[:, :-1]
    head_at = np.maximum.accumulate(np.where(fresh, index, -1), axis=1).ravel()
    tail = np.minimum.accumulate(g[:, ::-1], axis=1)[:, ::-1]
    tail_at = np.minimum.accumulate(np.where(g == tail, index, _BIG)[:, ::-1], axis=1)[:, ::-1].ravel()
    head, tail = head.ravel(), tail.ravel()
    owner = np.where(tail[:n] <= head[span - 1 : span - 1 + n], tail_at[:n], head_at[span - 1 : span - 1 + n])
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return owner[first], first, np.r_[first[1:] - 1, n - 1]


class Rolling:
    """Hashes of any runs of a sequence, 64 bits each, from prefix sums of a polynomial over scrambled symbols."""

    def __init__(self, symbols: np.ndarray, base: int, salt: int):
        n = len(symbols)
        values = mix(symbols.astype(np.uint64) + np.uint64(salt))
        values *= np.cumprod(np.full(n, base, np.uint64))
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values, out=self.sums[1:])
        self.back = np.cumprod(np.full(n, pow(base, -1, 2**64), np.uint64))

    def of(self, starts: np.ndarray, sizes) -> np.ndarray:
        return (self.sums[starts + sizes] - self.sums[starts]) * self.back[starts]


def rolling_pair(symbols: np.ndarray) -> tuple[Rolling, Rolling]:
    return Rolling(symbols, 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D), Rolling(symbols, 0xD1342543DE82EF95, 0x5851F42D4C957F2D)


def window_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """128 bits of hash for each window: n by 2."""
    return np.stack([gram_hashes(symbols, size), gram_hashes(symbols.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D), size)], axis=1)


def repeated(hashes: np.ndarray, ids: np.ndarray, anywhere: bool, data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Whether each window of data, from at (ascending) on, occurs again (anywhere), or with a smaller id."""
    if not len(ids):
        return np.zeros(0, bool)
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))  # stable: ascending positions among equals
    h = hashes[order]
    new = np.r_[True, (h[1:] != h[:-1]).any(axis=1)]
    group = np.empty(len(ids), np.int64)
    group[order] = np.cumsum(new) - 1
    if not confirmed(data, at, at[order[new]][group], size):  # two contents with one hash: by content, then
        group = np.unique(np.stack([data[a : a + size] for a in at]), axis=0, return_inverse=True)[1].reshape(-1)
    if anywhere:
        return np.bincount(group)[group] > 1
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    return least[group] < ids


def confirmed(data: np.ndarray, one: np.ndarray, other: np.ndarray, size: int) -> bool:
    """Whether the windows at one[k] and other[k] have the same symbols for every k.

    Where a pair is the pair before it moved on by one symbol, only its last symbol is new.
    """
    apart = one != other
    moved = np.zeros(len(one), bool)
    moved[1:] = (one[1:] == one[:-1] + 1) & (other[1:] == other[:-1] + 1)
    if not (data[one + size - 1] == data[other + size - 1]).all():
        return False
    whole = np.flatnonzero(apart & ~moved)
    steps = np.arange(size - 1)
    return all((data[one[part, None] + steps] == data[other[part, None] + steps]).all() for part in np.array_split(whole, max(1, len(whole) * size // 4_000_000)))


def runs(flags: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of symbols covered by the flagged windows."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > size)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + size).tolist(), strict=True))


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k, tag, text): k is the id, NO_ID for null; tag is a hash of the text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"), text.alias("text"))


def narrow(docs: DataFrame, kind: Kind, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k, tag, n, digest, sha, keys, times): symbols, digest of the text, SHA-256 of what stays if nothing goes, the
    different grams at anchors and how many anchors each has."""

    def run(batches):
        for batch in batches:
            n, digests, shas, keys, times = [], [], [], [], []
            for text in batch.column(3):
                data, symbols = kind.parse(text.as_py())
                n.append(len(symbols))
                digests.append(hashlib.blake2b(data, digest_size=16).digest())
                shas.append(hashlib.sha256(data).hexdigest())
                grams = gram_hashes(symbols, kind.gram) if len(symbols) >= kind.window else symbols[:0].astype(np.uint64)
                own, count = np.unique(grams[anchors(grams, kind.window - kind.gram + 1)[0]].view(np.int64), return_counts=True)
                keys.append(own)
                times.append(count)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(shas, pa.string()), *lists], ["doc_id", "k", "tag", "n", "digest", "sha", "keys", "times"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, k long, tag long, n long, digest binary, sha string, keys array<long>, times array<long>")


def _emit(rows: DataFrame, kind: Kind, hot: bool) -> DataFrame:
    """Contexts of the anchors in keys; if hot, blocks of those in hot_keys."""
    L = kind.window

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        keys, ids, tags, places, data = zip(*rows, strict=True)
        places = pa.array(places, pa.list_(pa.int64()) if hot else pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (keys, ids, tags)), places, pa.array(data, pa.binary())], ["key", "doc_id", "tag", "starts" if hot else "start", "data"])

    def blocks_of(symbols: np.ndarray, at, first, last) -> list[tuple[int, int, int]]:
        """Key, first and last window of each block."""
        cores = gram_hashes(symbols, L - kind.block + 1).view(np.int64)
        out = []
        for a, lo, hi in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
            for b in range((a - hi) // kind.block, (a - lo) // kind.block + 1):
                out.append((int(cores[a - b * kind.block]) ^ b, max(lo, a - (b + 1) * kind.block + 1), min(hi, a - b * kind.block)))
        return out

    def run(batches):
        found, size = [], 0
        for batch in batches:
            for doc, tag, text, wanted in zip(*(batch.column(k) for k in range(4)), strict=True):
                wanted = np.array(wanted.as_py(), np.int64)
                if not len(wanted):
                    continue
                _, symbols = kind.parse(text.as_py())
                grams = gram_hashes(symbols, kind.gram)
                at, first, last = anchors(grams, L - kind.gram + 1)
                key = grams[at].view(np.int64)
                go = np.flatnonzero(np.isin(key, wanted))
                width, data, doc, tag = symbols.itemsize, symbols.tobytes(), doc.as_py(), tag.as_py()
                if hot:
                    places: dict[tuple[int, bytes], list[int]] = {}
                    for k, s, e in blocks_of(symbols, at[go], first[go], last[go]):
                        places.setdefault((k, data[s * width : (e + L) * width]), []).append(s)
                    out = ((k, doc, tag, starts, content) for (k, content), starts in places.items())
                else:
                    out = ((k, doc, tag, s, data[s * width : (e + L) * width]) for k, s, e in zip(key[go].tolist(), first[go].tolist(), last[go].tolist(), strict=True))
                for row in out:
                    found.append(row)
                    size += len(row[-1])
                    if size > BATCH_BYTES:
                        yield packed(found)
                        found, size = [], 0
        if found:
            yield packed(found)

    return rows.select("k", "tag", "text", "hot_keys" if hot else "keys").mapInArrow(run, BLOCKS if hot else CONTEXT)


def _in_buckets(contexts: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        keys, sizes = group.column("key").to_numpy(), np.cumsum(pa.compute.binary_length(group.column("data")).to_numpy())
        # keys are independent: as many at a time as make CHUNK_BYTES, so that memory follows the largest key alone
        ends = np.r_[np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        doc, tag, place, at = [], [], [], 0
        for k, end in enumerate(ends.tolist()):
            if k + 1 < len(ends) and sizes[ends[k + 1] - 1] - (sizes[at - 1] if at else 0) <= CHUNK_BYTES:
                continue
            part = group.slice(at, end - at)
            ids, tags, starts = (part.column(c).to_numpy() for c in ("doc_id", "tag", "start"))
            data = [np.frombuffer(x, kind.dtype) for x in part.column("data").to_pylist()]
            for j, flags in enumerate(kind.kernel(kind, data, ids, starts)):
                if found := [(int(starts[j]) + a) << 32 | int(starts[j]) + b for a, b in runs(flags, kind.window)]:
                    doc.append(ids[j])
                    tag.append(tags[j])
                    place.append(found)
            at = end
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "tag": pa.array(tag, pa.int64()), "at": pa.array(place, pa.list_(pa.int64()))})

    return contexts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInArrow(run, RUN)


def _packed(start: Column, stop: Column) -> Column:
    return F.shiftleft(start, 32) + stop


def _single(contexts: DataFrame, kind: Kind) -> DataFrame:
    """Windows of very common cores, one row each, counted by Spark; the counts are written, so that AQE can split the join."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            hashes = [window_hashes(np.frombuffer(data, kind.dtype), kind.window).view(np.int64) for data in batch.column("data").to_pylist()]
            sizes = [len(h) for h in hashes]
            h = np.concatenate(hashes)
            start = np.concatenate([np.arange(s, s + n) for s, n in zip(batch.column("start").to_pylist(), sizes, strict=True)])
            ids, tags = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("doc_id", "tag"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, tags, start, h[:, 0], h[:, 1])], ["doc_id", "tag", "start", "h1", "h2"])

    windows = written(contexts.mapInArrow(run, "doc_id long, tag long, start long, h1 long, h2 long"), f"{kind.name}-windows")
    seen = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = windows.join(written(seen, f"{kind.name}-seen"), ["h1", "h2"])
    found = found if kind.anywhere else found.where("least < doc_id")
    return found.select("doc_id", "tag", F.array(_packed(F.col("start"), F.col("start") + kind.window)).alias("at"))


def _hot(candidates: DataFrame, kind: Kind, buckets: Callable[[int, int], int]) -> DataFrame:
    """RUN rows of the windows of hot keys."""
    blocks = _emit(candidates.where(F.size("hot_keys") > 0), kind, True)
    blocks = written(blocks.withColumns({"row": F.monotonically_increasing_id(), "h1": F.xxhash64("key", "data"), "h2": F.xxhash64("data", "key", F.lit(1))}), f"{kind.name}-blocks")
    equal = ["key", "h1", "h2"]
    kinds = written(blocks.groupBy(equal).agg(F.sum(F.size("starts")).alias("copies"), F.min("doc_id").alias("least"), F.min("row").alias("row")), f"{kind.name}-kinds")
    # one block of each kind, with the smallest id; its number stands for the id of its row, so that runs lead back to the kind
    once = written(blocks.select("row", "data").join(kinds.select("key", "row", "least"), "row").select("key", F.col("least").alias("doc_id"), F.col("row").alias("tag"), F.lit(0).cast("long").alias("start"), "data"), f"{kind.name}-once")
    common = written(once.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > VERY_HOT), f"{kind.name}-common")
    found = _in_buckets(once.join(common, "key", "left_anti"), kind, buckets(once.count(), kind.window + kind.block))
    if not common.isEmpty():
        found = found.unionByName(_single(once.join(common, "key", "left_semi"), kind))
    found = found.groupBy(F.col("tag").alias("first")).agg(F.flatten(F.collect_list("at")).alias("runs"))
    length = (F.octet_length("data") / np.dtype(kind.dtype).itemsize).cast("long")
    members = blocks.select(*equal, "doc_id", "tag", "starts", length.alias("length")).join(kinds.withColumnRenamed("row", "first"), equal)
    # blocks that occur again go as a whole; of the others, and of those of the smallest id, what was found
    whole = (F.col("copies") > 1) if kind.anywhere else (F.col("doc_id") > F.col("least"))
    shifted = lambda start: F.transform("runs", lambda run: _packed(start + F.shiftright(run, 32), start + run.bitwiseAND(0xFFFFFFFF)))
    some = members.where(~whole).join(found, "first").select("doc_id", "tag", F.flatten(F.transform("starts", shifted)).alias("at"))
    return some.unionByName(members.where(whole).select("doc_id", "tag", F.transform("starts", lambda start: _packed(start, start + F.col("length"))).alias("at")))


def find(docs: DataFrame, kind: Kind, *, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, candidates, found): narrow() of every row with copies and first_id of its digest; text and digest of those
    with shared anchors, one row for each different text; the covered runs, which may overlap."""
    rows = written(narrow(docs, kind, id_col, text_col), f"{kind.name}-rows")
    classes = rows.groupBy("digest").agg(F.min("k").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("k", "tag")).getField("tag").alias("tag"))
    classes = written(classes, f"{kind.name}-classes")
    keyed = rows.where(F.size("keys") > 0).join(classes.select("digest", F.col("first_id").alias("k"), "tag"), ["digest", "k", "tag"])
    keyed = keyed.dropDuplicates(["digest"]).select("k", "tag", "digest", F.explode(F.arrays_zip("keys", "times")).alias("own"))
    keyed = written(keyed.select("k", "tag", "digest", F.col("own.keys").alias("key"), F.col("own.times").alias("times")), f"{kind.name}-keys")
    # n counts every context: a text may have a key many times
    shared = keyed.groupBy("key").agg(F.sum("times").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("k", "tag")))
    shared = written(shared.where("n > 1" if kind.anywhere else "min_k <> max_k or min_tag <> max_tag").select("key", "n"), f"{kind.name}-shared")
    contexts, hot = shared.agg(F.coalesce(F.sum(F.when(F.col("n") <= HOT, F.col("n"))), F.lit(0)), F.count(F.when(F.col("n") > HOT, 1))).first()
    few, many = (F.collect_set(F.when(often, F.col("key"))) for often in (F.col("n") <= HOT, F.col("n") > HOT))
    per_doc = written(keyed.join(shared, "key").groupBy("k", "tag", "digest").agg(few.alias("keys"), many.alias("hot_keys")), f"{kind.name}-wanted")
    texts = texts_of(docs, id_col, text_col).drop("doc_id")
    candidates = written(texts.join(per_doc, ["k", "tag"]).dropDuplicates(["digest"]), f"{kind.name}-texts")
    width = np.dtype(kind.dtype).itemsize
    buckets = lambda n, symbols: max(1, -(-n * symbols * width // BUCKET_BYTES))
    found = _in_buckets(_emit(candidates, kind, False), kind, buckets(contexts, kind.window * 3 // 2))
    if hot:
        found = found.unionByName(_hot(candidates, kind, buckets))
    return rows.join(classes.drop("tag"), "digest", "left"), candidates, found


def joined(at: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs, ascending, of packed ones that may overlap or touch."""
    at = np.sort(at)
    start, stop = at >> 32, np.maximum.accumulate(at & 0xFFFFFFFF)
    first = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]])
    return list(zip(start[first].tolist(), stop[np.r_[first[1:] - 1, len(at) - 1]].tolist(), strict=True))


def removed(docs: DataFrame, kind: Kind, keep: Callable[[str | None, list[tuple[int, int]]], bytes], *, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, n, n_removed, n_spans, kept_sha256, spans) of every row; spans are the maximal removed runs of symbols."""
    rows, candidates, found = find(docs, kind, id_col=id_col, text_col=text_col)
    per_doc = found.groupBy(F.col("doc_id").alias("k"), "tag").agg(F.flatten(F.collect_list("at")).alias("runs"))
    cut = candidates.select("k", "tag", "digest", "text").join(per_doc, ["k", "tag"])
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in batches:
            gone, spans, shas = [], [], []
            for text, at in zip(batch.column(1), batch.column(2), strict=True):
                pieces = joined(at.values.to_numpy())
                gone.append(sum(b - a for a, b in pieces))
                spans.append([{"start": a, "stop": b} for a, b in pieces])
                shas.append(hashlib.sha256(keep(text.as_py(), pieces)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, span)], ["digest", "gone", "cut_sha", "cut_spans"])

    cut = cut.select("digest", "text", "runs").mapInArrow(run, "digest binary, gone long, cut_sha string, cut_spans array<struct<start:long,stop:long>>")
    whole = (F.col("n") >= kind.window) & ((F.col("copies") > 1) if kind.anywhere else (F.col("first_id") < F.col("k")))
    whole_span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("stop")))
    none = F.array().cast("array<struct<start:long,stop:long>>")
    out = rows.join(cut, "digest", "left").select(
        "doc_id", "tag", "n", F.when(whole, F.col("n")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(whole, whole_span).otherwise(F.coalesce("cut_spans", none)).alias("spans"),
    )
    return out.select("doc_id", "tag", "n", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")
