"""Sessions, forks with a ledger, episodes and incidents as they happen, paced frames."""

import json
import os
import random

import pytest

from voltwarden.operators import views
from voltwarden.streaming import alerts, checks, live, paced

def test_sessions(spark, tmp_path):
    rows = [(0, 2, "a"), (2, 2, "b"), (4, 2, "a"), (60, 2, "a"), (61, 1, "c"), (500, 2, "z")]
    folder = tmp_path / "alerts"
    folder.mkdir()
    (folder / "0.json").write_text("".join(json.dumps({"ts": f"2025-01-01T00:{t // 60:02d}:{t % 60:02d}Z", "severity": s, "node_id": n}) + "\n" for t, s, n in rows))
    stream = live.frames(spark, str(folder), "ts timestamp, severity int, node_id string")
    q = live.sessions(stream).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "alerts-state")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.severity, r.nodes, r.polls) for r in spark.table("alerts").collect())
    assert got == [(1, 1, 1), (2, 1, 1), (2, 2, 3)]


def put(folder, k, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))


def test_a_failing_sink_is_run_again_alone(spark, tmp_path):
    for k in range(3):
        put(tmp_path / "in", k, [{"idx": 10 * k + i} for i in range(4)])
    calls, fail = [], [True]

    def first(batch, i):
        calls.append(("first", i))
        batch.write.mode("overwrite").json(f"{tmp_path}/first/batch={i}")

    def second(batch, i):
        batch.limit(2).write.mode("overwrite").json(f"{tmp_path}/second/batch={i}")  # half done
        if i == 1 and fail and fail.pop():
            raise RuntimeError("killed")
        batch.write.mode("overwrite").json(f"{tmp_path}/second/batch={i}")
        calls.append(("second", i))

    start = lambda: live.fork(live.frames(spark, str(tmp_path / "in"), "idx long"), str(tmp_path / "state"), first, second).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    assert calls == [("first", 0), ("second", 0), ("first", 1)]
    start().awaitTermination()
    assert calls == [("first", 0), ("second", 0), ("first", 1), ("second", 1), ("first", 2), ("second", 2)]
    want = sorted(10 * k + i for k in range(3) for i in range(4))
    for sink in ("first", "second"):
        assert sorted(r.idx for r in spark.read.schema("idx long").json(f"{tmp_path}/{sink}").collect()) == want


def test_episodes_and_incidents_as_they_happen(spark, tmp_path):
    rng = random.Random(12)
    rows = []
    for node in "abcd":
        severity = 0
        for t in range(120):
            severity = rng.choice([0, 0, 1, 2]) if rng.random() < 0.25 else severity
            rows.append({"node_id": node, "ts": 2.0 * t, "severity": severity, "vector": rng.choice(["Unclassified", "Replay", "Drift"]), "value": round(rng.uniform(0, 100), 2)})
    own = checks.session(spark, timers=False)
    schema = "node_id string, ts double, severity int, vector string, value double"
    for k, (lo, hi) in enumerate(((0, 40), (40, 41), (41, 90), (90, 240))):
        put(tmp_path / "polls", k, [r for r in rows if lo <= r["ts"] < hi])
    told = alerts.episodes(live.frames(own, str(tmp_path / "polls"), schema))
    told.writeStream.format("json").option("path", str(tmp_path / "episodes")).option("checkpointLocation", str(tmp_path / "e")).trigger(availableNow=True).start().awaitTermination()
    batch = views.episodes(spark.createDataFrame([tuple(r.values()) for r in rows], schema), _lit(238.0))
    names = ["node_id", "severity", "start_ts", "end_ts", "samples", "vector", "peak", "last_value", "ongoing"]
    every = own.read.schema(told.schema).json(str(tmp_path / "episodes"))
    got = alerts.latest(every, ["node_id"]).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.select(names).collect()))
    assert every.where("ongoing AND end_ts < 100").count() > 2  # open ones were seen before
    for keys in (["severity"], ["node_id"]):
        stream = alerts.incidents(told, 5.0, keys)
        place = str(tmp_path / keys[0])
        stream.writeStream.format("json").option("path", place).option("checkpointLocation", place + "-state").trigger(availableNow=True).start().awaitTermination()
        want = views.incidents(batch, 5.0, keys).selectExpr(*keys, "start_ts", "end_ts", "nodes", "samples", "peak", "ongoing", "size(children) AS children").collect()
        got = alerts.latest(own.read.schema(stream.schema).json(place), keys).select(*keys, "start_ts", "end_ts", "nodes", "samples", "peak", "ongoing", "children").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def _lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_paced_frames(spark, tmp_path):
    """With a false clock: a late poll skips frames, one too early gives none, an exhausted recording gives none, a restart goes on."""
    spark.range(7).selectExpr("id AS idx", "id * 1.5 AS frq").coalesce(1).write.parquet(str(tmp_path / "recording"))
    schema = spark.createDataFrame([], "idx long, frq double").schema
    now = [100.0]
    reader = paced.Reader(schema, {"path": str(tmp_path / "recording"), "frames": "7", "cadence": "2"}, clock=lambda: now[0])
    seen, start = [], reader.initialOffset()

    def poll(r, start):
        end = r.latestOffset()
        seen.append([x for p in r.partitions(start, end) for b in r.read(p) for x in b.column("idx").to_pylist()])
        return end

    for step in (0.0, 1.9, 0.2, 4.5):
        now[0] += step
        start = poll(reader, start)
    assert seen == [[0], [], [1], [3]]
    other = paced.Reader(schema, {"path": str(tmp_path / "recording"), "frames": "7", "cadence": "2"}, clock=lambda: now[0])
    now[0] += 1000
    assert [x for p in other.partitions({"next": 2}, start) for b in other.read(p) for x in b.column("idx").to_pylist()] == [3]  # run again
    seen.clear()
    for step in (0.0, 2.0, 30.0, 2.0):
        now[0] += step
        start = poll(other, start)
    assert seen == [[4], [5], [6], []]
    assert [paced.due(t) for t in (0.0, 1.99, 2.0, 7.0)] == [0, 0, 1, 3]


def test_paced_source(spark, tmp_path):
    spark.range(5).selectExpr("id AS idx", "id * 1.5 AS frq").coalesce(1).write.parquet(str(tmp_path / "recording"))
    spark.dataSource.register(paced.PacedFrames)
    stream = spark.readStream.format("paced").schema("idx long, frq double").options(path=str(tmp_path / "recording"), frames=5, cadence=0.5).load()
    q = stream.writeStream.format("memory").queryName("paced_rows").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    import time

    end = time.time() + 60
    while time.time() < end and not any(r.idx == 4 for r in spark.table("paced_rows").collect()):
        time.sleep(0.5)
    q.stop()
    got = [r.idx for r in spark.table("paced_rows").collect()]
    assert got == sorted(set(got)) and got[-1] == 4
