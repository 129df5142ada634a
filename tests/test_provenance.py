import hashlib
import json
import unicodedata

from sumforge.operators import provenance, run_statistics

TEXTS = ["\\frac{1}{2}", "ﬁnite  ½ sum", "finite 1⁄2 sum", " a b\n c ", "a b c", "é", "é", " ", "", None, "Ａ" * 100_000, "A" * 100_000]


def test_checksums_against_plain_python(spark):
    found = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, text string").select("k", provenance.checksum(provenance.F.col("text")).alias("c")).collect()
    plain = ["sha256:" + hashlib.sha256(" ".join(unicodedata.normalize("NFKC", t).split()).encode()).hexdigest() if t else None for t in TEXTS]
    assert [r.c for r in sorted(found)] == plain
    assert plain[1] == plain[2] and plain[3] == plain[4] and plain[5] == plain[6] and plain[10] == plain[11]


def test_authors_of_stored_answers(spark, tmp_path):
    owner = lambda n: {"display_name": n, "link": f"https://example.org/{n}", "age": 3}
    blobs = {
        "one.txt": json.dumps({"items": [{"question_id": 1, "owner": owner("ann"), "tags": ["x"]}, {"question_id": 1, "owner": owner("bea")}, {"question_id": 1, "answer_id": 7, "owner": owner("cy")}], "quota": 9}, indent=1),
        "two.txt": json.dumps({"items": [{"question_id": 2}, {"answer_id": 8, "owner": {"display_name": "dee"}}]}),
        "broken.txt": '{"items": [{"question_id": 1, ',
        "empty.txt": "",
        "none.txt": json.dumps({"items": []}),
    }
    for name, body in blobs.items():
        (tmp_path / name).write_text(body)
    cases = [
        ("one.txt", 1, "question_body", "ann", "https://example.org/ann"), ("one.txt", 7, "answer_body", "cy", "https://example.org/cy"), ("one.txt", 7, "question_body", None, None),
        ("one.txt", 1, "answer_body", None, None), ("two.txt", 2, "question_body", None, None), ("two.txt", 8, "answer_title", "dee", None), ("two.txt", 1, "question_body", None, None),
        ("broken.txt", 1, "question_body", None, None), ("empty.txt", 1, "question_body", None, None), ("none.txt", 1, None, None, None), ("gone.txt", 1, "question_body", None, None),
        (None, 1, "question_body", None, None), ("one.txt", None, "question_body", None, None), ("one.txt", 1, None, "ann", "https://example.org/ann"),
    ]
    # extra columns with names of the items', and a repeated record
    rows = [(k, *c[:3], "own", -1) for k, c in enumerate(cases)]
    records = spark.createDataFrame([*rows, rows[0]], "record_id long, blob string, item_id long, origin string, name string, position int")
    found = provenance.authors(records, provenance.blob_items(provenance.read_blobs(spark, str(tmp_path))))
    assert found.columns == [*records.columns, "author", "author_link"]
    got = sorted(((r.record_id, r.author, r.author_link) for r in found.collect()), key=lambda r: r[0])
    want = [(k, c[3], c[4]) for k, c in enumerate(cases)]
    assert got == [want[0], *want]


def test_run_statistics_against_plain_python(spark):
    def epoch(k, t, v):
        return {"epoch": k + 1, "train_loss": t, "val_loss": v, "learning_rate": 0.1 / (k + 1), "timestamp": f"2024-01-{k + 1:02}", "note": "x"}

    runs = {"a": [(4.0, 5.0), (2.0, 3.0), (1.0, 3.0), (0.5, 4.0)], "one": [(1.5, 2.0)], "zero": [(0.0, 1.0), (0.0, 0.0)]}
    stats = [(name, json.dumps([epoch(k, *p) for k, p in enumerate(pairs)])) for name, pairs in runs.items()]
    rows = run_statistics.epochs(spark.createDataFrame([*stats, ("broken", "[{"), ("none", "[]"), ("null", None)], "run string, body string"))
    assert rows.count() == 7
    found = {r.run: r.asDict() for r in run_statistics.summary(rows).collect()}
    assert set(found) == set(runs)
    for name, pairs in runs.items():
        (t0, v0), (t, v) = pairs[0], pairs[-1]
        best = min(p[1] for p in pairs)
        assert found[name] == {
            "run": name, "n_epochs": len(pairs), "final_train_loss": t, "final_val_loss": v, "final_lr": 0.1 / len(pairs), "best_val_loss": best, "best_epoch": [p[1] for p in pairs].index(best) + 1,
            "train_loss_improvement": (t0 - t) / t0 if t0 else None, "val_loss_improvement": (v0 - v) / v0, "val_train_gap": v - t, "overfit_ratio": v / t if t else None,
        }


def test_workers_give_back_digests_and_no_texts(spark, monkeypatch):
    monkeypatch.setattr(provenance, "canonical", None)
    assert spark.createDataFrame([("a  b",)], "t string").select(provenance.checksum(provenance.F.col("t"))).first()[0] == "sha256:" + hashlib.sha256(b"a b").hexdigest()
