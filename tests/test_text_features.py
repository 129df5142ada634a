import math
import time

from pyspark.sql import functions as F

from sumforge.operators import text_features
from sumforge.operators.text_features import Vectoriser, tfidf
from sumforge.plans import other_queries

SCHEMA = "id long, text string"


def plain(fitted, texts, features):
    grams = lambda t: [t[i : i + k] for k in (1, 2, 3) for i in range(len(t) - k + 1)]
    total, df = {}, {}
    for t in fitted:
        for g in grams(t or ""):
            total[g] = total.get(g, 0) + 1
        for g in set(grams(t or "")):
            df[g] = df.get(g, 0) + 1
    kept = sorted(total, key=lambda g: (-total[g], g))[:features]
    idf = {g: math.log((1 + len(fitted)) / (1 + df[g])) + 1 for g in kept}
    out = {}
    for k, t in texts:
        mine = grams(t or "")
        w = {g: mine.count(g) * idf[g] for g in set(mine) if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out |= {(k, g): round(x / norm, 6) for g, x in w.items()}
    return out


def test_fitted_here_applied_there(spark, tmp_path):
    a, b = [(1, "abca"), (2, None), (3, "bcd x")], [(4, "zzz ab"), (5, "")]
    unseen = [(1, "abz"), (2, "qq"), (3, None), (4, "a a a")]
    one, two = (Vectoriser.fit(spark.createDataFrame(x, SCHEMA), "id", "text") for x in (a, b))
    version = one.save(spark, str(tmp_path))
    one.merged(two).save(spark, str(tmp_path))
    for kept, fitted in ((Vectoriser.load(spark, str(tmp_path), version), a), (Vectoriser.load(spark, str(tmp_path)), a + b)):
        got = kept.weights(spark.createDataFrame(unseen, SCHEMA), "id", "text", features=12)
        want = plain([t for _, t in fitted], unseen, 12)
        assert {(r.id, r.term) for r in got.collect()} == set(want) and all(abs(r.weight - want[r.id, r.term]) < 2e-6 for r in got.collect())
    assert {(r.id, r.term): r.weight for r in tfidf(spark.createDataFrame(a, SCHEMA), "id", "text").collect()}.keys() == plain([t for _, t in a], a, 384).keys()


def test_ngrams_among_given_terms_are_counted_in_each_text(spark):
    docs = spark.createDataFrame([(1, "abab\n𝔸b"), (1, "ab"), (2, None), (3, ""), (4, "zz")], "id int, text string")
    found = text_features.char_ngrams(docs, "id", "text", among={"ab", "b\n𝔸", "b"})
    assert sorted(map(tuple, found.collect())) == [(1, "ab", 3), (1, "b", 4), (1, "b\n𝔸", 1)]
    assert [f.dataType.simpleString() for f in found.schema] == ["int", "string", "bigint"]


def test_pairs_of_one_long_sentence_take_time_in_proportion(spark, tmp_path):
    words = 30_000
    spark.createDataFrame([(" ".join(f"w{k % 100}" for k in range(words)),)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = time.perf_counter()
    found = other_queries.QUERIES["permutation_dedup"](spark, str(tmp_path)).agg(F.sum("n")).first()[0]
    assert found == words - 1
    assert time.perf_counter() - start < 20
