import hashlib
import re

from pyspark.sql import functions as F

from sumforge.llm import fingerprints as fp
from tests.llm.conftest import HARD


def test_edited_text_and_next_document(spark, documents, tmp_path):
    texts, ids = HARD, [7 * k * k - 50 for k in range(len(HARD))]
    documents(texts, ids).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in fp.op1(spark, str(tmp_path)).collect()}
    assert sorted(rows) == sorted(ids)
    order = sorted(zip(ids, texts, strict=True))
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].n_chars == len(text) and 0 <= rows[i].near_edited <= 1
    by_text = {}
    for i, text in order:
        by_text.setdefault(text or "", set()).add(rows[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_likeness_estimates_jaccard(spark):
    words = [f"w{k}" for k in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b")).select(fp.likeness(F.col("a"), F.col("b")).alias("j"), fp.containment(F.col("a"), F.col("b")).alias("c"), fp.merged(F.col("a"), F.col("b")).alias("m")).first()
    assert abs(row.j - 1 / 3) < 0.06 and abs(row.c - 0.5) < 0.08
    whole = spark.createDataFrame([(" ".join(words),)], "t string").select(fp.sketch(F.col("t")).alias("s")).first().s
    assert set(row.m) == set(whole)  # 2000 shared words: every shingle of the whole lies in a or b


def test_retained_fraction(spark):
    text = " ".join(f"x{k}" for k in range(8004))
    kept = spark.createDataFrame([(text,)], "t string").select(fp.sketch(F.col("t")).alias("s")).first().s
    assert abs(len(kept) - 1000) < 120 and kept == sorted(set(kept))


def test_empty_table_and_single_row(spark, documents):
    assert fp.with_next(documents([]).select("doc_id", "text"), ["text"]).collect() == []
    row = fp.with_next(documents(["solo"]).select("doc_id", "text"), ["text"]).first()
    assert row.next_text == "solo"


def test_ranges_of_ids(spark):
    ids = [3, 4, 9, 10_000, 10_001, 99_999, -7]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fp.with_next(rows, ["text"], per_bucket=2).collect()}
    order = sorted(ids)
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_containment_of_short_texts(spark):
    edge = -(2**63) + 2**64 // fp.SCALE
    low, high, higher = edge - 5, edge + 5, edge + 9
    cases = [([], [low], 1.0), ([low], [low, low - 1], 1.0), ([low], [high], 0.0), ([low - 1, low], [low], 0.5), ([high], [high], 1.0), ([high], [], 0.0), ([high], [higher], 0.0), ([higher], [high], None), ([high], [low], None)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a array<bigint>, b array<bigint>")
    got = {r.k: r.c for r in rows.select("k", fp.containment(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(cases)}


def test_sketch_and_likeness_against_a_plain_version(spark):
    texts = ["a b c d e f g", " ".join(f"w{k % 90}" for k in range(400)), " ".join(f"w{k}" for k in range(300)), "one", ""]
    shingles = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    hashes = {}
    for r in shingles.collect():
        words = r.t.split()
        runs = [words[i : i + fp.SHINGLE] for i in range(max(1, len(words) - fp.SHINGLE + 1))] if words else []
        of = spark.createDataFrame([(x,) for x in runs] or [([],)], "w array<string>").select(F.transform("w", lambda w: F.xxhash64(w)).alias("w"))
        of = of.select(F.xxhash64(*(F.get("w", F.lit(j)) for j in range(fp.SHINGLE))).alias("h")).collect() if runs else []
        every = {x.h for x in of}
        hashes[r.k] = sorted(h for h in every if h < -(2**63) + 2**64 // fp.SCALE) or sorted(every)[:1]
    got = {r.k: r.s for r in shingles.select("k", fp.sketch(F.col("t")).alias("s")).collect()}
    assert got == hashes
