"""Near-duplicate grouping by SuperMinHash, banding, verification and union-find.

SuperMinHash gives each element one permutation of the slots and the ranks 0, 1, 2, ... in it; a slot takes the lowest
rank plus fraction that any element puts there. Ranks of an element are correlated, so that signatures vary less than
those of independent hashes, and an element's later ranks are not drawn once every slot holds a lower one.

Documents with equal shingle sets are one node. Nodes that agree in a band of their signatures are candidates. First
every node of a bucket is held against the bucket's smallest one, on full sets, and the links found are merged. Only
buckets that still hold several components are looked at again: there each node outside the largest component is held
against a few hashed nodes of that one, and what is still apart against all nodes of other components, in tiles of
bounded size. So every candidate pair is either confirmed, refuted
or already connected, and copies are never expanded into pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumforge.llm._shared import Memo, fresh, table, written
from sumforge.llm.graph import components

#: 25 bands of 5 slots miss a pair of similarity 0.8 once in 20,000 times.
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
#: Steps, and nodes of a bucket's largest component in each, that the others are held against before all are.
ROUNDS, HUBS = 1, 2
TILE = 1024
BITS = 4096
_EMPTY = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_words = Memo(xxhash.xxh3_64_intdigest, 200_000)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct word shingles of text, A-Z lower-cased.

    Words are runs of anything but ASCII white space. Fewer words than size are one shingle; without words or text the
    set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return _EMPTY
    hashed = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    width = min(size, n)
    out = hashed[: n - width + 1] + np.uint64(width)
    for k in range(1, width):
        out = mix(out) + hashed[k : n - width + 1 + k]
    return np.unique(mix(out))


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, sets by slots; 16 bits of each slot's rank and fraction."""
    sizes = np.array([len(s) for s in sets], np.int64)
    element = np.concatenate(sets) if len(sets) else _EMPTY
    owner = np.repeat(np.arange(len(sets)), sizes)
    best = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    taken: list[np.ndarray] = []  # the swap partners of earlier ranks
    for rank in range(slots):
        if rank:
            worst = best.reshape(len(sets), slots).max(axis=1, initial=0) >> np.uint64(32)
            go = (worst >= rank)[owner]
            if not go.any():
                break
            if not go.all():
                element, owner, taken = element[go], owner[go], [t[go] for t in taken]
        drawn = mix(element + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 % 2**64))
        partner = (rank + ((drawn >> np.uint64(32)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int32)).astype(np.uint8)
        slot = partner
        for earlier in range(rank - 1, -1, -1):  # what the swaps so far have put there
            slot = np.where(taken[earlier] == slot, np.uint8(earlier), slot)
        taken.append(partner)
        fraction = mix(drawn) & np.uint64(0xFFFFFFFF)
        np.minimum.at(best, owner * slots + slot, fraction | np.uint64(rank << 32))
    return (mix(best) & np.uint64(0xFFFF)).astype("<u2").reshape(len(sets), slots)


def sketches(docs: DataFrame, *, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, tag, n, digest, sig): a hash of the text, set size, digest of the set, signature; no shuffle."""

    def run(batches):
        for batch in batches:
            texts, at = batch.column(2), 0
            while at < len(texts):
                sets, total, start = [], 0, at
                while at < len(texts) and total < 150_000:
                    sets.append(shingle_set(texts[at].as_py(), shingle))
                    total += len(sets[-1])
                    at += 1
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                sigs = [row.tobytes() for row in signatures(sets)]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, at - start) for c in batch.columns[:2]), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "tag", "n", "digest", "sig"])

    return _tagged(docs, id_col, text_col).mapInArrow(run, "doc_id long, tag long, n long, digest binary, sig binary")


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"), text.alias("text"))


def _full_sets(docs: DataFrame, nodes: DataFrame, *, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, n, set, bits) of nodes(id, doc_id, tag): size, full set, and a bitmap of which hashes modulo BITS occur."""
    source = _tagged(docs, id_col, text_col).join(nodes, ["doc_id", "tag"]).select("id", "text")

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([bitmap(s) for s in sets], pa.binary())], ["id", "n", "set", "bits"])

    return source.mapInArrow(run, "id long, n long, set binary, bits binary").dropDuplicates(["id"])


def bitmap(elements: np.ndarray) -> bytes:
    flags = np.zeros(BITS, bool)
    flags[(elements % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def possible(n1, bits1: np.ndarray, n2, bits2: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs can be similar enough, by a bound that loses none.

    A bit that only one set has stands for at least one element that the other lacks, which bounds the intersection.
    """
    both = np.minimum(n1 - np.bitwise_count(bits1 & ~bits2).sum(axis=-1, dtype=np.int64), n2 - np.bitwise_count(bits2 & ~bits1).sum(axis=-1, dtype=np.int64))
    return 100 * both >= percent * (n1 + n2 - both)


def _arrays(columns, rows: int) -> tuple[np.ndarray, np.ndarray]:
    n, bits = columns
    return n.to_numpy(zero_copy_only=False) if isinstance(n, pa.Array) else n.to_numpy(), np.frombuffer(b"".join(bits.to_pylist()), "<u8").reshape(rows, BITS // 64)


def _likely(pairs: DataFrame, cards: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are possible() by their cards (id, n, bits)."""
    side = lambda end, k: cards.withColumnsRenamed({"id": end, "n": f"n{k}", "bits": f"b{k}"})
    both = pairs.join(side("u", 1), "u").join(side("v", 2), "v").select("u", "v", "n1", "b1", "n2", "b2")

    def run(batches):
        for batch in batches:
            if len(batch):
                one, other = (_arrays([batch.column(k + j) for j in range(2)], len(batch)) for k in (2, 4))
                yield batch.select(["u", "v"]).filter(pa.array(possible(*one, *other, percent)))

    return both.mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("set").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                both_ = len(x) + len(y) - len(np.union1d(x, y)) if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) else 0
                keep.append(100 * both_ >= percent * (len(x) + len(y) - both_))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def _per_bucket(members: DataFrame) -> DataFrame:
    """(key, n, top): size and largest component, as struct(n, component), of buckets that hold several."""
    per = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")


def _to_largest(members: DataFrame, step: int) -> DataFrame:
    """Pairs of each node outside its bucket's largest component with HUBS nodes of that one, others in each step and bucket."""
    rows = members.join(_per_bucket(members).select("key", F.col("top.component").alias("top")), "key")
    picks = [F.min_by("id", F.xxhash64("id", "key", F.lit(step * HUBS + k))) for k in range(HUBS)]
    hubs = rows.where("component = top").groupBy("key").agg(F.array_distinct(F.array(*picks)).alias("hubs"))
    pairs = rows.where("component <> top").join(hubs, "key").select("id", F.explode("hubs").alias("hub"))
    return pairs.select(F.greatest("id", "hub").alias("u"), F.least("id", "hub").alias("v")).distinct()


def _tiles(members: DataFrame, cards: DataFrame, percent: int) -> DataFrame:
    """Likely pairs across components in buckets that hold several; members has key, id, component.

    A bucket's nodes outside its largest component meet all its nodes; both sides are cut into tiles of about TILE, so a
    bucket of any size is spread over as many groups as it takes.
    """
    per = _per_bucket(members)
    cut = lambda n: F.ceil(n / F.lit(TILE)).cast("int")
    per = per.select("key", F.col("top.component").alias("top"), cut(F.col("n")).alias("all_tiles"), cut(F.col("n") - F.col("top.n")).alias("few_tiles"))
    rows = members.join(per, "key").join(cards, "id")
    tile = lambda n: F.pmod(F.xxhash64("id"), n.cast("long")).cast("int")
    wide = rows.select("key", tile(F.col("all_tiles")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("few_tiles") - 1)).alias("j"), F.lit(False).alias("few"), "id", "component", "n", "bits")
    few = rows.where("component <> top").select("key", F.explode(F.sequence(F.lit(0), F.col("all_tiles") - 1)).alias("i"), tile(F.col("few_tiles")).alias("j"), F.lit(True).alias("few"), "id", "component", "n", "bits")

    def run(group: pa.Table) -> pa.Table:
        flag = group.column("few").to_numpy(zero_copy_only=False)
        ids, comp = group.column("id").to_numpy(), group.column("component").to_numpy()
        n, bits = _arrays([group.column(k) for k in ("n", "bits")], len(ids))
        others = np.flatnonzero(~flag)
        u, v = [], []
        for k in np.flatnonzero(flag):
            apart = others[comp[others] != comp[k]]
            near = apart[possible(n[apart], bits[apart], n[k], bits[k], percent)]
            u += [np.maximum(ids[near], ids[k])]
            v += [np.minimum(ids[near], ids[k])]
        return pa.table({"u": np.concatenate(u or [np.zeros(0, np.int64)]), "v": np.concatenate(v or [np.zeros(0, np.int64)])})

    return wide.unionByName(few).groupBy("key", "i", "j").applyInArrow(run, "u long, v long").distinct()


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row of docs.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    id reachable, and that row is kept. A document without words, null ones too, has an empty set and is linked with
    nothing. Rows that share an id and a text share their component; rows that share an id but not a text are linked
    each by its own text. A null id is linked with nothing, its component is null and it is kept. Other columns are not
    read.
    """
    return _grouped(docs, id_col, text_col, shingle, percent).drop("tag")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """near_groups() with tag, a hash of the text, which tells rows with one id apart."""
    rows = written(sketches(docs, id_col=id_col, text_col=text_col, shingle=shingle), "near-sketches")
    nodes = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "tag")).alias("first"), F.any_value("sig").alias("sig"))
    # numbers of nodes: any will do, once they are written
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("id"), "digest", "first.doc_id", "first.tag", "sig"), "near-nodes")
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)))))
    keys = nodes.select(band.alias("key"), "id")
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    members = written(keys.join(hubs, "key"), "near-buckets")
    among = nodes.select("id", "doc_id", "tag").join(members.select("id").distinct(), "id", "left_semi")
    sets = written(_full_sets(docs, among, id_col=id_col, text_col=text_col, shingle=shingle), "near-sets")
    cards = sets.select("id", "n", "bits")
    tried = written(_likely(members.where("id <> hub").select(F.greatest("id", "hub").alias("u"), F.least("id", "hub").alias("v")).distinct(), cards, percent), "near-pairs")
    found = written(components(written(_confirmed(tried, sets, percent), "near-links")), "near-components")
    for step in (*range(ROUNDS), None):
        labelled = members.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        pairs = _tiles(labelled, cards, percent) if step is None else _likely(_to_largest(labelled, step), cards, percent)
        pairs = written(pairs.join(tried, ["u", "v"], "left_anti"), "near-pairs")
        if pairs.isEmpty():
            continue
        links = found.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(_confirmed(pairs, sets, percent))
        found = written(components(links), "near-components")
        tried = tried.unionByName(pairs)
    placed = nodes.join(found, "id", "left").select("digest", "doc_id", F.coalesce("component", "id").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("class_id"))  # a row for each different set at most
    classes = placed.join(least, "component").select("digest", "class_id")
    out = rows.select("doc_id", "tag", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(classes, "digest", "left")
    component = F.coalesce("class_id", "doc_id")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "tag")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_groups() keeps, with all their columns; rows without an id all stay."""
    groups = _grouped(docs, id_col, text_col, shingle, percent)
    key, tag = fresh(docs.columns, "key", "tag")
    gone = groups.where("not kept").select(F.col(id_col).alias(key), F.col("tag").alias(tag)).distinct()
    same = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(tag)
    return docs.join(gone, (F.col(id_col) == F.col(key)) & same, "left_anti")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, by 2-word shingles."""
    return near_groups(table(spark, sf_dir, "documents"), shingle=2)
