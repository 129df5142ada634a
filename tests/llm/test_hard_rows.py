"""Rows with one id and different texts, null ids, and columns whose names clash, for every operator and stage."""

import hashlib
import re

import corpus_pipeline as cp
import pytest

from sumforge.llm import bpe_codec, exact_dedup, fingerprints, minhash, packing, quality, sharding, substring_dedup, suffix_dedup, token_counts

CLASHING = ["k", "tag", "keys", "n", "sha", "shard", "ids", "id", "key", "component", "__id", "__n", "__sha", "__spans", "__key", "__tag", "__text", "part", "row", "y", "cluster", "near", "salt", "size", "words"]


def words(stem, n):
    return " ".join(f"{stem}{k}" for k in range(n))


SHARED, OTHER = words("p", 300), words("q", 300)
ROWS = [(5, SHARED), (5, "unlike " + OTHER + " end"), (3, OTHER), (None, SHARED + " tail"), (None, words("z", 80)), (7, words("z", 80)), (7, words("z", 80)), (8, None), (9, "")]


@pytest.fixture()
def rows(spark):
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, len(t or ""), *("x" for _ in CLASHING)) for i, t in ROWS], schema)


def test_substring_dedup(rows):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup(rows).collect()}
    # a null id counts as the smallest, so its texts come first
    assert got == {(5, 300, 300), (5, 302, 300), (3, 300, 0), (None, 301, 0), (None, 80, 0), (7, 80, 80), (8, 0, 0), (9, 0, 0)}


def test_suffix_dedup(rows):
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(rows).collect()}
    n = len(SHARED)
    short = len(words("z", 80))
    assert short < 400
    assert got == {(5, n, n), (5, n + 11, n), (3, n, n), (None, n + 5, n), (None, short, 0), (7, short, 0), (8, 0, 0), (9, 0, 0)}


def test_cut_texts_by_words(rows):
    cut = suffix_dedup.cut_texts(rows, chars_col="n_chars", words=True)
    assert cut.columns == rows.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in cut.collect()), key=str)
    want = [(5, ""), (5, "unlike end"), (3, ""), (None, "tail"), (None, ""), (7, ""), (7, ""), (8, None), (9, "")]
    assert got == sorted(((i, t, None if t is None else len(t)) for i, t in want), key=str)


def test_near_groups(rows):
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_groups(rows).collect()), key=str)
    want = [(5, 5, True), (5, 3, False), (3, 3, True), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (8, 8, True), (9, 9, True)]
    assert got == sorted(want, key=str)
    kept = minhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((ROWS[k] for k in (0, 2, 3, 4, 5, 6, 7, 8)), key=str)


def test_exact_dedup(rows):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(rows).collect()), key=str)
    want = [(5, 5, 1, True), (5, 5, 1, True), (3, 3, 1, True), (None, None, 1, False), (None, 7, 3, False), (7, 7, 3, True), (7, 7, 3, True), (8, 8, 2, True), (9, 8, 2, False)]
    assert got == sorted(want, key=str)
    kept = exact_dedup.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((ROWS[k] for k in (0, 1, 2, 3, 5, 7)), key=str)


def test_fingerprints(spark, rows, tmp_path):
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprints.op1(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_chars) for r in got), key=str) == sorted(((i, len(t or "")) for i, t in ROWS), key=str)
    empty = next(r for r in got if r.doc_id == 9)
    assert empty.edited_sha256 == hashlib.sha256(b"").hexdigest() and empty.fingerprint == ""


def test_row_by_row_operators(rows):
    want = sorted((str(i) for i, _ in ROWS))
    for out in (token_counts.token_counts(rows), bpe_codec.encode(rows), bpe_codec.round_trip(rows), sharding.assign(rows), quality.score(rows, None), fingerprints.fingerprints(rows)):
        assert sorted(str(r.doc_id) for r in out.collect()) == want
    pieces = packing.pack(rows).collect()
    assert sum(r.length for r in pieces) == sum(r.n for r in packing.token_ids(rows).collect())


def test_training_with_repeated_ids(spark, rows):
    labels = spark.createDataFrame([(k, int(k != 8)) for k in (3, 5, 7, 8, 9) for _ in range(2)], "doc_id long, quality int")
    assert quality.train(rows, labels) is not None


def test_pipeline(spark, rows, tmp_path):
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = out
    assert cp.run(spark, str(tmp_path)).count() > 0


def plain_sketch(words_of, spark):
    """Fingerprints by Spark's own word hashes, but otherwise in plain Python."""
    from pyspark.sql import functions as F

    out = {}
    for text in words_of:
        found = [w for w in re.split(r"[ \t-\r]+", text or "") if w]
        if not found:
            out[text] = set()
            continue
        hashes = [r.h for r in spark.createDataFrame([(k, w) for k, w in enumerate(found)], "k int, w string").orderBy("k").select(F.xxhash64("w").alias("h")).collect()]
        grams = [tuple(hashes[k : k + 5]) + (None,) * (5 - len(hashes[k : k + 5])) for k in range(max(1, len(hashes) - 4))]
        shingles = {r.h for r in spark.createDataFrame(grams, "a long, b long, c long, d long, e long").select(F.xxhash64("a", "b", "c", "d", "e").alias("h")).collect()}
        out[text] = {h for h in shingles if h < -(2**63) + 2**64 // 8} or {min(shingles)}
    return out


def test_fingerprints_against_plain_python(spark, documents, tmp_path):
    texts = [words("a", 200), words("a", 190) + " new end", words("b", 3), None, words("a", 200)]
    documents(texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op1(spark, str(tmp_path)).collect()}
    sketches = plain_sketch(set(texts), spark)
    for k, text in enumerate(texts):
        own, after = sketches[text], sketches[texts[(k + 1) % len(texts)]]
        assert got[k].fingerprint == ",".join(f"{h & (2**64 - 1):x}" for h in sorted(own))
        want = len(own & after) / len(own | after) if own | after else 1.0
        assert abs(got[k].near_next - want) < 1e-12
