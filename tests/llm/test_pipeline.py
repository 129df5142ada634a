import corpus_pipeline as cp

from sumforge.llm import exact_dedup, suffix_dedup
from tests.llm.conftest import HARD
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_repeats import brute as repeat_brute
from tests.llm.test_repeats import corpus


def test_stages_take_effect(spark, documents, tmp_path):
    texts = corpus(4)
    docs = documents(texts)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    kept = cp.good(spark, docs, d)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    once = sorted((r.doc_id, r.text) for r in cp.exact(spark, kept, d).collect())
    seen, want = set(), []
    for i, t in sorted(enumerate(texts), key=lambda x: (-len(x[1] or ""), x[0])):
        key = "".join((t or "").split())
        if key not in seen:
            seen.add(key)
            want.append((i, t))
    assert once == sorted(want, key=lambda x: x[0])
    apart = cp.near(spark, spark.createDataFrame(once, "doc_id long, text string"), d)
    groups = near_brute([t for _, t in once], 5)
    assert sorted(r.doc_id for r in apart.collect()) == [once[k][0] for k, *_, stays in groups if stays]
    rest = [once[k] for k, *_, stays in groups if stays]
    cut = {r.doc_id: r.text for r in suffix_dedup.cut_texts(spark.createDataFrame(rest, "doc_id long, text string")).collect()}
    data = [(t or "").encode() for _, t in rest]
    for (i, t), b, gone in zip(rest, data, repeat_brute(data, 400, True), strict=True):
        want_text = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        assert cut[i] == (want_text if any(gone) else t)
    pieces = cp.run(spark, d)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {i for i, _ in rest}


def test_repeated_rows_and_null_ids(documents):
    docs = documents(["a b", "ab", "c", "d", "d"], [1, 1, 2, None, None])
    rows = sorted(((r.doc_id, r.text) for r in exact_dedup.keep_one(docs).collect()), key=str)
    assert rows == [(1, "a b"), (2, "c"), (None, "d"), (None, "d")]


def test_all_stages_on_hard_and_empty_tables(spark, documents, tmp_path):
    for k, texts in enumerate(([], HARD)):
        documents(texts).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        assert (cp.run(spark, f"{tmp_path}/{k}").count() > 0) == bool(texts)
