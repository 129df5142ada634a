import random
from collections import OrderedDict

import pytest

from sumforge.operators import admission
from sumforge.operators.admission import Limits


def plain(rows, limits):
    """One hit after the other, with whole lists."""
    log, clients, out = [], OrderedDict(), {}
    for at, key, client in sorted((r[2], r[0], r[1]) for r in rows):
        if sum(at - t <= limits.seconds for t in log) >= limits.overall:
            out[key] = "busy"
            continue
        if client not in clients and len(clients) >= limits.clients:
            clients.popitem(last=False)
        clients.setdefault(client, [])
        clients.move_to_end(client)
        if sum(at - t <= limits.seconds for t in clients[client]) >= limits.per_client:
            out[key] = "client"
            continue
        clients[client].append(at)
        log.append(at)
        out[key] = "admitted"
    return out


def hits(seed, n, clients, step):
    rng, at, rows = random.Random(seed), 0, []
    for k in range(n):
        at += rng.choice([0, step, step, 2 * step, rng.random() < 0.005 and 500])
        rows.append((k, rng.randrange(clients), int(at)))
    return rows


@pytest.mark.parametrize(("limits", "clients", "size"), [(Limits(60, 3, 20, 4096), 12, 37), (Limits(60, 4, 25, 3), 8, 50), (Limits(30, 2, 10_000, 5), 40, 101), (Limits(60, 30, 300, 4096), 4, 10_000)])
def test_against_one_hit_after_the_other(spark, limits, clients, size):
    rows = hits(clients, 900, clients, 2)
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long").selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts", "1 AS n").repartition(3)
    got = {r.event_id: r.outcome for r in admission.admitted(events, limits, size=size).collect()}
    assert got == plain(rows, limits)
    assert limits == Limits() or len(set(got.values())) > 1


def test_crowded_log_runs_each_range_a_few_times(spark, monkeypatch):
    """Twenty hits at each moment and room for eleven: where the gate was busy first matters to the end."""
    limits, rng, ran = Limits(60, 3, 11, 9), random.Random(3), []
    rows = [(k, rng.randrange(15), k // 20 + (k % 7 == 0)) for k in range(6000)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long").selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts")
    collect = type(events).collect
    monkeypatch.setattr(type(events), "collect", lambda df: [ran.append(r) or r for r in collect(df)] if "overall" in df.columns else collect(df))
    done = admission.admitted(events, limits, size=200)
    assert len(ran) <= 4 * 30
    assert {r.event_id: r.outcome for r in collect(done)} == plain(rows, limits)


def test_nulls_and_nothing(spark):
    events = spark.createDataFrame([(1, None, None), (2, None, None), (3, 5, None)], "event_id long, user_id long, ts timestamp")
    got = {r.event_id: (r.user_id, r.outcome) for r in admission.admitted(events, Limits(60, 1, 9, 9)).collect()}
    assert got == {1: (None, "admitted"), 2: (None, "client"), 3: (5, "admitted")}
    assert admission.admitted(events.limit(0)).collect() == []


def test_stream_equals_batch_and_forgets(spark, tmp_path):
    limits = Limits(60, 3, 12, 4)
    rows = hits(7, 600, 9, 3)
    for k in range(0, 600, 100):
        part = spark.createDataFrame(rows[k : k + 100], "event_id long, user_id long, s long").selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:04}")
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = admission.admitted_stream(stream, limits).writeStream.format("memory").queryName("gated").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    assert {r.event_id: r.outcome for r in spark.sql("SELECT * FROM gated").collect()} == plain(rows, limits)
    assert max(states) <= 1
