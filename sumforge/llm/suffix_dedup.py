"""Suffix-array dedup: removes every byte covered by a 400-byte string that occurs anywhere else, or every word so covered.

The suffix array is built by linear grouping: suffixes are grouped by their Lyndon prefixes, groups are processed in
descending order with pointers to the previous smaller group, and then each group's order is emitted; no symbol is ever
renamed recursively.

Its symbols are phrases: texts are parsed at local minima of a rolling hash, a phrase every 36 bytes or so, which puts
the same borders into equal strings wherever they stand. Suffixes that share a long prefix of phrases are neighbours in
the array; only windows whose suffix has such a neighbour are compared, by 128 bits of hash and then symbol by symbol.
Over words the same is done with phrases of some five words and windows of 50 words.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumforge.llm._shared import fresh, table
from sumforge.llm.repeats import NO_ID, Kind, anchors, gram_hashes, removed, repeated, rolling_pair
from sumforge.llm.substring_dedup import word_symbols

WINDOW, WINDOW_WORDS = 400, 50
#: A phrase border is the least hash of PHRASE_GRAM bytes (words) among PHRASE_SPAN neighbours.
PHRASE_GRAM, PHRASE_SPAN = 8, 72
WORD_GRAM, WORD_SPAN = 1, 10


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a sequence of integers in ascending order; a proper prefix comes first."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    # the end is a symbol of its own, below all others
    order = np.r_[n, np.argsort(symbols, kind="stable")]
    ranked = symbols[order[1:]]
    starts = np.r_[0, 1, 1 + np.flatnonzero(ranked[1:] != ranked[:-1]) + 1]
    group_of = np.empty(n + 1, np.int64)
    group_of[order] = np.repeat(starts, np.diff(np.r_[starts, n + 1]))
    place = np.empty(n + 1, np.int64)
    place[order] = np.arange(n + 1)
    # a group is a range of sa, known by its first place; stop has its end
    sa, group, at = order.tolist(), group_of.tolist(), place.tolist()
    stop = [0] * (n + 2)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n + 1], strict=True):
        stop[a] = b
    before = [-1] * (n + 1)
    end = n + 1
    while end > 1:
        low = group[sa[end - 1]]
        members = sa[low:end]
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) == 1:
            moves = [[next(iter(pointed))]]
        else:
            by_count: dict[int, dict[int, list[int]]] = {}
            for p, k in pointed.items():
                by_count.setdefault(k, {}).setdefault(group[p], []).append(p)
            moves = [part for k in sorted(by_count, reverse=True) for part in by_count[k].values()]
        # those that more members point at go further back; each part becomes the group just behind the one it leaves
        for part in moves:
            old = group[part[0]]
            last = behind = stop[old]
            for p in part:
                last -= 1
                other, hole = sa[last], at[p]
                sa[last], at[p] = p, last
                sa[hole], at[other] = other, hole
            if last > old:
                stop[old] = last
                stop[last] = behind
                for p in part:
                    group[p] = last
        end = low
    out = [-1] * (n + 1)
    out[0] = n
    done = bytearray(n + 1)
    done[n] = 1
    free = list(range(n + 2))  # the next free place of each group
    for k in range(n + 1):
        p = out[k] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            done[p] = 1
            p = before[p]
    return np.array(out[1:])


def borders(data: np.ndarray, gram: int = PHRASE_GRAM, span: int = PHRASE_SPAN) -> np.ndarray:
    """Starts of phrases."""
    return anchors(gram_hashes(data, gram), span)[0]


def repeated_windows(kind: Kind, contexts: list[np.ndarray], ids: np.ndarray, starts: np.ndarray, gram: int = PHRASE_GRAM, span: int = PHRASE_SPAN) -> list[np.ndarray]:
    """For each context whether each of its windows occurs in any other place."""
    L, reach = kind.window, gram + span
    known = L - 4 * reach  # equal windows share at least so many symbols of whole phrases from their first inner border on
    classes: dict[bytes, list[int]] = {}
    for k, c in enumerate(contexts):
        classes.setdefault(c.tobytes(), []).append(k)
    first = [v[0] for v in classes.values()]
    data = np.concatenate([contexts[k] for k in first])
    sizes = np.array([len(contexts[k]) for k in first])
    ends = np.cumsum(sizes)
    begin = ends - sizes
    cut = borders(data, gram, span)
    flags = np.zeros(len(data), bool)
    one, other = rolling_pair(data)
    if len(cut) > 1:
        # phrases by content; the last one is open
        sa = suffix_array(np.unique(one.of(cut, np.diff(np.r_[cut, len(data)])), return_inverse=True)[1])
        at = cut[sa]
        room = at + known <= len(data)
        head = one.of(np.where(room, at, 0), known)
        near = room[1:] & room[:-1] & (head[1:] == head[:-1])
        hit = np.zeros(len(cut), bool)
        hit[sa] = np.r_[near, False] | np.r_[False, near]
        inner = np.searchsorted(cut, np.arange(len(data)) + reach)
        flags = (inner < len(cut)) & hit[np.minimum(inner, len(cut) - 1)]
    owned = np.zeros(len(data), bool)
    owned[: len(data) - L + 1] = True
    for a, b in zip(begin.tolist(), ends.tolist(), strict=True):
        owned[b - L + 1 : b] = False
    check = np.flatnonzero(flags & owned)
    exact = np.zeros(len(data), bool)
    if len(check):
        exact[check] = repeated(np.stack([one.of(check, L), other.of(check, L)], axis=1), np.zeros(len(check), np.int64), True, data, check, L)
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(contexts)
    for (same, a, b) in zip(classes.values(), begin.tolist(), ends.tolist(), strict=True):
        found = exact[a : b - L + 1] if len(same) == 1 else np.ones(b - a - L + 1, bool)
        for k in same:
            out[k] = found
    return out


def _bytes(text: str | None) -> tuple[bytes, np.ndarray]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data, np.frombuffer(data, np.uint8)


def _nothing(text: str | None, spans: list) -> bytes:
    return b""


def _without(text: str | None, spans: list) -> bytes:
    data, at, kept = (text or "").encode("utf-8", "surrogatepass"), 0, []
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


KIND = Kind("suffix", WINDOW, 128, "u1", _bytes, repeated_windows, True, 64)
WORDS = Kind("suffix-words", WINDOW_WORDS, 16, "u8", word_symbols, partial(repeated_windows, gram=WORD_GRAM, span=WORD_SPAN), True, 10)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row.

    Texts are UTF-8 bytes, null an empty one, and matches never cross rows. A byte goes if a 400-byte string that covers
    it also starts anywhere else, in the same row too; strings are judged on the input. Texts under 400 bytes stay as
    they are. Equal texts, rows repeated with one id among them, all go if they are long enough; rows with one id and
    different texts, and rows without an id, are rows like others. Other columns are not read. The result also has tag,
    a hash of the text, which tells rows with one id apart.
    """
    return removed(docs, KIND, _without, id_col=id_col, text_col=text_col).withColumnsRenamed({"n": "n_bytes"})


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return dedup(table(spark, sf_dir, "documents")).drop("spans", "tag")


_WORD = re.compile(r"[^ \t-\r]+")


def _byte_edges(text: str, spans: list) -> str:
    """text without the bytes in spans; a character that lies across an edge stays."""
    data, edges = text.encode("utf-8", "surrogatepass"), []
    for a, b in spans:
        while a < len(data) and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
            b -= 1
        edges.append((a, max(a, b)))
    return _without(text, edges).decode("utf-8", "surrogatepass")


def _word_edges(text: str, spans: list) -> str:
    """text without the words in spans and the white space behind each."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at : starts[a]])
        at = starts[b]
    return "".join([*kept, text[at:]])


def cut_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, words: bool = False) -> DataFrame:
    """docs with the repeated strings cut from the texts, all columns kept; chars_col gets the new length.

    What is cut are the spans of dedup(), less the bytes of a character that lies across an edge. With words, it is
    every word covered by a run of WINDOW_WORDS words that occurs anywhere else too, with the white space behind it; other
    white space stays as it is. Null texts stay null. Rows that share an id but not a text are cut each by its own spans.
    """
    kind, cut_text = (WORDS, _word_edges) if words else (KIND, _byte_edges)
    found = removed(docs, kind, _nothing if words else _without, id_col=id_col, text_col=text_col).where("n_removed > 0")
    columns = docs.columns
    names = fresh(columns, "key", "tag", "spans")
    spans = found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(names[0]), F.col("tag").alias(names[1]), F.col("spans").alias(names[2])).dropDuplicates(names[:2])
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == F.col(names[0])
    same = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(names[1])
    at, last = columns.index(text_col), len(columns) + 2
    both = docs.join(spans, own & same, "left")

    def run(batches):
        for batch in batches:
            out = [t if not cut else cut_text(t, [(s["start"], s["stop"]) for s in cut]) for t, cut in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True)]
            kept = batch.select(columns)
            kept = kept.set_column(at, text_col, pa.array(out, kept.schema.field(at).type))
            if chars_col in columns:
                k = columns.index(chars_col)
                kept = kept.set_column(k, chars_col, pa.array([None if t is None else len(t) for t in out], kept.schema.field(k).type))
            yield kept

    return both.mapInArrow(run, docs.schema)
