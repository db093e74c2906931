"""Streams of the verifier's checks against their batch forms: several micro-batches, runs that interleave, a restart."""

import json
import os
import random
import time

from pyspark.sql import functions as F

from voltwarden.config import Enf, Nlr
from voltwarden.operators import enf, nlr
from voltwarden.plans.verify import enf_results, node_results
from voltwarden.streaming import checks, live

NODES = Nlr(ceiling_w=500.0, gpu_step_w=60.0, cpu_step_w=50.0, temp_step_c=9.0, temp_ceiling_c=90.0, recovery_w=20.0, recovery_c=4.0, quiet_frames=10, ramp_low_w=100.0, ramp_high_w=140.0, ramp_deadline=5, ramp_run=6, wrap_ceiling_uj=900.0, wrap_tolerance_uj=60.0, energy_step_uj=200.0)
GRID = Enf(tolerance_hz=0.045, trusted=0.6, suspect=0.1, raw_drift_hz=0.012, alt_threshold=0.9, local_recovery=8, cusum_threshold=4.0)
KINDS = {"gpu-0[W]": "gpu_power", "gpu-0[C]": "gpu_temp", "cpu-0[W]": "cpu_power", "cpu-0[uJ]": "cpu_uj"}


def put(folder, k, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))


def run(df, state, until=None):
    """The stream's rows once its input is done; until: a condition on the rows to wait for, since timers only fire later."""
    out = f"{state}/out"
    read = lambda: df.sparkSession.read.schema(df.schema).json(out).collect()
    q = df.writeStream.format("json").option("path", out).outputMode("append").option("checkpointLocation", f"{state}/state")
    q = q.trigger(processingTime="500 milliseconds").start() if until else q.trigger(availableNow=True).start()
    try:
        end = time.time() + 90
        while q.isActive and not (until and os.path.isdir(out) and until(read())):
            assert time.time() < end, "the stream goes on"
            time.sleep(0.5)
    finally:
        q.stop()
    return read()


def grid_rows(seed=2, n=150):
    rng = random.Random(seed)
    rows = []
    for r, length in ((1, n), (2, n - 37), (3, 5)):
        v, flat = 60.0, 0.0
        for i in range(length):
            v = 60 + 0.9 * (v - 60) + rng.gauss(0, 0.006) + (0.02 if 60 < i < 75 else 0)
            flat = v if i % 60 < 35 else flat
            x = round(flat if 40 <= i % 60 else v, 6)
            ts = 2.0 * i - (4 if i % 23 == 7 else 25 if i % 29 == 20 else 0)
            rows.append({"run_id": r, "idx": i, "ts": ts, "frq": x, "alt": None if i % 13 == 5 else round(v + rng.gauss(0, 0.0005 if i % 100 < 60 else 0.01), 6)})
    return rows


def test_frequency_as_in_batch(spark, tmp_path):
    own = checks.session(spark, timers=False)
    rows = grid_rows()
    schema = "run_id long, idx long, ts double, frq double, alt double"
    folder = tmp_path / "in"
    cuts = ((0, 1), (1, 12), (12, 80), (80, 200))
    ends = [{"run_id": r, "idx": 10_000} for r in (1, 2, 3)]
    for k, (lo, hi) in enumerate(cuts):
        put(folder, k, [r for r in rows if lo <= r["idx"] < hi])
        if k == 1:  # a query that stops here goes on where it was
            run(checks.grid_checks(live.frames(own, str(folder), schema), GRID), tmp_path)
    put(folder, 9, ends)
    got = run(checks.grid_checks(live.frames(own, str(folder), schema), GRID), tmp_path)
    want = enf_results(spark.createDataFrame([tuple(r.values()) for r in rows], schema), GRID, alternative=True).collect()
    key = lambda r: (r.run_id, r.idx, r.status_rank, tuple(r.codes), round(r.confidence, 6))
    assert sorted(map(key, got)) == sorted(map(key, want))
    seen = {c for r in got for c in r.codes}
    assert seen == {"REPLAY", "OUT OF ORDER", "OUT OF NOMINAL RANGE", "RAW VALUE TREND", "CORRELATION MISMATCH", "FLAT SIGNATURE", "DISCONTINUITY", "DRIFT DETECTED", "LOCAL ANOMALY"}


def node_rows(n=220):
    rng = random.Random(5)
    rows = []
    for r in (1, 2):
        for node in ("a", "b"):
            v, energy = {"gpu-0[W]": 100.0, "gpu-0[C]": 50.0, "cpu-0[W]": 90.0}, 0.0
            for i in range(n):
                for c in v:
                    wide = 12 if c.endswith("[C]") else 90
                    v[c] = rng.choice([v[c], v[c], v[c] + rng.uniform(-2, 2), v[c] + rng.uniform(-wide, wide), 55.0]) if i % 40 < 30 else [70.0, 71.5, 73.0][i % 3]
                    rows.append({"run_id": r, "node_id": node, "channel": c, "kind": KINDS[c], "is_core": False, "idx": i, "frame": i, "value": round(v[c], 3)})
                energy = energy + rng.choice([20.0, 30.0, 250.0, -15.0]) if energy < 850 else energy - 880
                rows.append({"run_id": r, "node_id": node, "channel": "cpu-0[uJ]", "kind": "cpu_uj", "is_core": False, "idx": i, "frame": i, "value": energy})
    return rows


def test_nodes_as_in_batch(spark, tmp_path):
    own = checks.session(spark, timers=False)
    rows = node_rows()
    schema = "run_id long, node_id string, channel string, kind string, is_core boolean, idx long, frame long, value double"
    folder = tmp_path / "in"
    for k, (lo, hi) in enumerate(((0, 1), (1, 97), (97, 150), (150, 220))):
        put(folder, k, [r for r in rows if lo <= r["idx"] < hi])
        if k == 1:
            run(checks.node_checks(live.frames(own, str(folder), schema), NODES), tmp_path)
    put(folder, 8, [r for r in rows if r["idx"] in (3, 219) and r["run_id"] == 2])  # again, and late
    got = run(checks.node_checks(live.frames(own, str(folder), schema), NODES), tmp_path)
    late = [r for r in got if r.check_ord == -1]
    assert {(r.idx, r.code) for r in late} == {(3, "REPLAY"), (219, "REPLAY")} and len(late) == 16
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).drop("frame")
    want = [r for r in node_results(df, NODES).collect() if r.code != "SIBLING MISMATCH"]
    key = lambda r: (r.run_id, r.node_id, r.channel, r.idx, r.check_ord, r.status_rank, r.code)
    assert sorted(key(r) for r in got if r.check_ord >= 0) == sorted(map(key, want))
    assert {r.code for r in got} >= {"OUT OF RANGE", "DISCONTINUITY", "MONOTONICITY VIOLATION", "ENERGY SPIKE", "SUSTAINED DEVIATION", "STARTUP RAMP", "REPLAY", "ok"}


def test_a_reading_never_accepted_is_out_of_order(spark, tmp_path):
    own = checks.session(spark, timers=False)
    folder, order = tmp_path / "in", [0, 1, 2, 5000, 5001]
    row = lambda i: {"run_id": 1, "node_id": "n", "channel": "c", "kind": "cpu_power", "idx": i, "frame": i, "value": 1.0}
    put(folder, 0, map(row, order))
    put(folder, 1, map(row, [3, 5001, 1, 4999, 5002]))
    schema = "run_id long, node_id string, channel string, kind string, idx long, frame long, value double"
    got = run(checks.node_checks(live.frames(own, str(folder), schema)), tmp_path)
    assert {(r.idx, r.code) for r in got if r.check_ord == -1} == {(3, "OUT OF ORDER"), (4999, "OUT OF ORDER"), (1, "REPLAY"), (5001, "REPLAY")}


def test_an_idle_run_is_told_of_and_forgotten(spark, tmp_path):
    own = checks.session(spark)
    rows = [r for r in grid_rows() if r["run_id"] == 3]
    put(tmp_path / "in", 0, rows)
    schema = "run_id long, idx long, ts double, frq double, alt double"
    stream = checks.grid_checks(live.frames(own, str(tmp_path / "in"), schema), GRID, idle_s=1)
    got = run(stream, tmp_path, until=lambda rows: len(rows) == 5)
    want = enf_results(spark.createDataFrame([tuple(r.values()) for r in rows], schema), GRID, alternative=True).collect()
    key = lambda r: (r.idx, r.status_rank, tuple(r.codes), round(r.confidence, 6))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 5


def test_alternative_stream_is_joined(spark, tmp_path):
    """Readings that come late, or not at all; what waits is forgotten as time goes on."""
    own = checks.session(spark, timers=False)
    rng = random.Random(3)
    n, v, observed, other = 160, 60.0, [], []
    at = lambda i: f"2025-01-01T{i * 2 // 3600:02d}:{i * 2 // 60 % 60:02d}:{i * 2 % 60:02d}Z"
    for i in range(n):
        v = 60 + 0.9 * (v - 60) + rng.gauss(0, 0.006)
        observed.append({"run_id": 1, "idx": i, "at": at(i), "frq": round(v, 6)})
        if i % 17 != 3:
            other.append({"run_id": 1, "idx": i, "at": at(i), "alt": round(v + rng.gauss(0, 0.0004 if i < 90 else 0.02), 6)})
    for k in range(8):
        mine = [r for r in observed if k * 20 <= r["idx"] < k * 20 + 20]
        theirs = [r for r in other if k * 20 - 7 <= r["idx"] < k * 20 + 13]  # seven frames late
        put(tmp_path / "o", k, mine)
        put(tmp_path / "a", k, theirs)
    put(tmp_path / "o", 8, [{"run_id": 2, "idx": 0, "at": at(600), "frq": 60.0}])
    put(tmp_path / "a", 8, [r for r in other if r["idx"] >= 153] + [{"run_id": 2, "idx": 0, "at": at(600), "alt": 60.0}])
    put(tmp_path / "o", 9, [{"run_id": 2, "idx": 1, "at": at(640), "frq": 60.0}])
    put(tmp_path / "a", 9, [{"run_id": 2, "idx": 1, "at": at(640), "alt": 60.0}])
    o, a = live.frames(own, str(tmp_path / "o"), "run_id long, idx long, at timestamp, frq double"), live.frames(own, str(tmp_path / "a"), "run_id long, idx long, at timestamp, alt double")
    joined = checks.with_alternative(o, a, "4 seconds", "20 seconds")
    q = joined.writeStream.format("memory").queryName("joined").outputMode("append").option("checkpointLocation", str(tmp_path / "join")).start()
    q.processAllAvailable()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"]]
    q.stop()
    got = {(r.run_id, r.idx): r.alt for r in own.table("joined").collect() if r.run_id == 1}
    assert got == {(1, i): next((r["alt"] for r in other if r["idx"] == i), None) for i in range(n)}
    assert max(held) < 140  # of 300 readings
    # and the check over it, in the order of frames, is that of the tables; a frame without a frequency ends the run
    put(tmp_path / "o", 7, [r for r in observed if r["idx"] >= 140] + [{"run_id": 1, "idx": n, "at": at(n), "frq": None}])
    result = run(checks.grid_checks(joined.drop("at"), GRID, in_order=True), tmp_path)
    table = enf.paired(spark.createDataFrame([(r["run_id"], r["idx"], r["frq"]) for r in observed], "run_id long, idx long, frq double"), spark.createDataFrame([(r["run_id"], r["idx"], r["alt"]) for r in other], "run_id long, idx long, alt double"))
    want = enf_results(table, GRID, alternative=True).collect()
    key = lambda r: (r.idx, r.status_rank, tuple(r.codes), round(r.confidence, 6))
    assert sorted(key(r) for r in result if r.run_id == 1) == sorted(map(key, want))
    assert any("CORRELATION MISMATCH" in r.codes for r in want)


def test_siblings_of_a_row(spark):
    rng = random.Random(1)
    rows = [(i, node, c, rng.choice([0.5, 40.0, 50.0, 55.0, 90.0]) if rng.random() > 0.1 else None) for i in range(40) for node in ("a", "b") for c in ("gpu-0", "gpu-1", "gpu-2", "gpu-3")]
    df = spark.createDataFrame(rows, "idx long, node_id string, channel string, value double")
    want = {(r.idx, r.node_id, r.channel) for r in nlr.sibling_ratio(df.where("value IS NOT NULL"), 0.85, 1.1).collect()}
    frames = df.groupBy("idx", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", "value"))).alias("values"))
    got = {(r.idx, r.node_id, c) for r in checks.siblings(frames, 0.85, 1.1).collect() for c in r.mismatched}
    assert got == want and want
