"""Sources and operators that SQL over the tables says little about: synthetic series, large files, cleaning, the verifier."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltwarden.operators import align, attacks, enf, scoring, views
from voltwarden.plans.verify import enf_results, verify
from voltwarden.sources import bus, logs, synthetic


def test_lines_of_a_file_read_in_parts(spark, tmp_path):
    text = [f"{i},{59 + i / 1000}" for i in range(5000)]
    (tmp_path / "Dev1_ENF_Hr00.csv").write_text("meta\n" + "\r\n".join(text))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = logs.frequency(spark, str(tmp_path)).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.idx, r.frq) for r in rows] == [(i, 59 + i / 1000) for i in range(5000)]


@pytest.mark.parametrize("workload", sorted(synthetic.ENVELOPE))
def test_synthetic_power(spark, workload):
    low, high = synthetic.ENVELOPE[workload]
    rows = synthetic.power(spark, workload, seconds=600, seed=4)
    watts = np.array([r.power_w for r in rows.orderBy("timestamp").collect()])
    assert len(watts) == 3000 and watts.min() >= 0 and rows.collect() == synthetic.power(spark, workload, seconds=600, seed=4).collect()
    least, most = {"llm_training": (high - 60, high), "idle": (low, low + 10)}.get(workload, (low, high))
    assert least - 40 < watts.min() and watts.max() < most + 40
    if workload == "llm_inference":
        assert 0.13 < (watts > (low + high) / 2).mean() < 0.23


def test_synthetic_frequency(spark):
    rows = synthetic.frequency(spark, 3000, seed=2)
    x = np.array([r.frq for r in rows.orderBy("idx").collect()])
    assert abs(x.mean() - 60) < 0.02 and 0.005 < x.std() < 0.04 and np.corrcoef(x[1:], x[:-1])[0, 1] > 0.9
    both = synthetic.alternative(rows, 7).collect()
    assert np.std([r.alt - r.frq for r in both]) == pytest.approx(1e-4, rel=0.1)


def test_cleaned(spark):
    """Against a plain fold over the series."""
    rng = random.Random(6)
    x = [60 + rng.gauss(0, 0.01) + (rng.choice([-3, 5, 15, -15, 25, -25, 80, -200]) if rng.random() < 0.05 else 0) for _ in range(400)]
    bad = [v < 40 or v > 80 for v in x]
    for i in range(len(x)):
        near = [x[k] for k in range(max(0, i - 11), min(len(x), i + 12)) if not bad[k]]
        if near and not bad[i]:
            m = np.median(near)
            mad = np.median(np.abs(np.array(near) - m))
            bad[i] = mad > 0 and abs(x[i] - m) > 2.0 * 1.4826 * mad
    good = [i for i, b in enumerate(bad) if not b]
    want = np.interp(range(len(x)), good, [x[i] for i in good])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "idx long, frq double").withColumn("run_id", F.lit(1))
    got = enf.cleaned(df).orderBy("idx").collect()
    assert [r.flagged for r in got] == bad and np.allclose([r.frq for r in got], want)


def test_replay_length_of_presets(spark):
    """The default source is 5 % of the timeline, its end held to the timeline's."""
    df = spark.createDataFrame([(i, "n", float(i), True) for i in range(50)], "idx long, node_id string, value double, target boolean")
    out = attacks.perturb(df, ["node_id"], 50, "replay", 0.4, 0.6, {"source_start_pct": 0.01}).orderBy("idx").collect()
    assert [r.attacked for r in out[20:30]] == [0.0, 1.0, 2.0] * 3 + [0.0]
    out = attacks.perturb(df, ["node_id"], 50, "replay", 0.4, 0.6, {"source_start_pct": 0.98}).orderBy("idx").collect()
    assert {r.attacked for r in out[20:30]} == {49.0}


def test_frequency_presets_are_tracked(spark):
    """Injection and drift on the frequency go through the tracked step: what is changed is fed back, unlike a plain change."""
    for which, last in (("204", 0.05), ("202", 0.06), ("302", None)):
        rows = [(i, None, "FRQ", 60.0 + 0.001 * (i % 7)) for i in range(300)]
        df = spark.createDataFrame(rows, "idx long, node_id string, channel string, value double")
        out = attacks.scenario(df.drop("node_id"), ["channel"], F.col("channel"), 300, which, seed=3).orderBy("idx").collect()
        engine, _, start, end, _ = attacks.SCENARIOS[which]
        hit = [r for r in out if r.label]
        assert [r.idx for r in hit] == list(range(int(300 * start), int(300 * end)))
        assert all(r.attacked == r.value for r in out if not r.label)
        moved = np.array([r.attacked - r.value for r in hit])
        if last:
            plain = np.full(len(hit), last) if engine == "injection" else last * np.arange(len(hit)) / len(hit)
            assert np.abs(moved - plain).max() <= 0.01 + 1e-9 and np.abs(moved - plain).max() > 1e-4


def base(n, nodes=("node_A", "node_B")):
    rows = []
    for i in range(n):
        for node in nodes:
            rows += [(0, i, node, f"gpu-{k}[W]", "gpu_power", False, w) for k, w in enumerate((70.0, 71.0, 69.0, 72.0))]
            rows += [(0, i, node, f"gpu-{k}[C]", "gpu_temp", False, c) for k, c in enumerate((55.0, 56.0, 54.0, 57.0))]
            rows += [(0, i, node, f"cpu-{k}[W]", "cpu_power", False, w) for k, w in enumerate((90.0, 91.0))]
            rows += [(0, i, node, f"cpu-{k}[uJ]", "cpu_uj", False, i * 180e6) for k in (0, 1)]
    return rows


LONG = "run_id long, idx long, node_id string, channel string, kind string, is_core boolean, value double"


def verdicts(spark, rows, frq=None, ts=None):
    n = max(r[1] for r in rows) + 1
    grid = [(0, i, (frq or {}).get(i, round(60 + 0.05 * float(np.sin(i / 20)), 6)), (ts or {}).get(i, 2.0 * i)) for i in range(n)]
    out = verify(spark.createDataFrame(grid, "run_id long, idx long, frq double, ts double"), spark.createDataFrame(rows, LONG)).collect()
    return {(r.idx, r.component_id): r for r in out}


def test_verifier_on_clean_frames(spark):
    got = verdicts(spark, base(30))
    assert len(got) == 30 * 25
    assert {r.status for (i, c), r in got.items() if c != "ENF"} == {"trusted"}


def test_verifier_on_planted_faults(spark):
    """Three faults at once on one node, none masked and the other node clean; an impossible frequency; a repeated time."""
    rows = base(30)
    change = {(10, "node_A", "gpu-1[W]"): 950.0, (10, "node_A", "gpu-2[C]"): 130.0, (10, "node_A", "cpu-0[uJ]"): 1e9}
    rows = [(*r[:6], change.get((r[1], r[2], r[3]), r[6])) for r in rows]
    got = verdicts(spark, rows, frq={10: 65.0}, ts={12: 4.0, 14: 25.0})
    at = {c: r for (i, c), r in got.items() if i == 10}
    assert at["node_A/gpu-1[W]"].status == "failed" and "OUT OF RANGE" in at["node_A/gpu-1[W]"].reason and "DISCONTINUITY" in at["node_A/gpu-1[W]"].reason
    assert "OUT OF RANGE" in at["node_A/gpu-2[C]"].reason and "MONOTONICITY" in at["node_A/cpu-0[uJ]"].reason
    assert all(r.status == "trusted" for c, r in at.items() if c.startswith("node_B"))
    assert "NOMINAL" in at["ENF"].reason and len(at) == 25
    assert got[12, "ENF"].reason.startswith("REPLAY") and got[14, "ENF"].reason.startswith("OUT OF ORDER")
    assert got[12, "ENF"].status == got[14, "ENF"].status == "failed" and "REPLAY" not in got[11, "ENF"].reason


def test_sequence_is_checked_only_with_times(spark):
    df = spark.createDataFrame([(0, i, 60.0) for i in range(5)], "run_id long, idx long, frq double")
    assert all("REPLAY" not in r.codes for r in enf_results(df).collect())


def test_abort_on_missing_frames(spark):
    a = spark.createDataFrame([(0, 1), (1, 0)], "idx long, truth int")
    b = spark.createDataFrame([(0, 1.0)], "idx long, score double")
    with pytest.raises(ValueError):
        scoring.aligned(a, b)
    assert scoring.aligned(a, b.unionByName(spark.createDataFrame([(1, 0.5)], b.schema))).count() == 2
    with pytest.raises(ValueError):
        scoring.without_labels(a.withColumn("n_attack", F.lit(1)))


def test_ticks_and_bounds(spark):
    (row,) = spark.range(1).select(views.ticks(-0.9, 2.1, 0.5).alias("t")).collect()
    assert row.t == [-0.5, 0.0, 0.5, 1.0, 1.5, 2.0]
    assert attacks.bounds(37, 0.1, 0.6) == (3, 22)


def test_wide_frames(spark):
    f = spark.createDataFrame([(0, 60.0), (1, 60.1)], "idx long, frq double")
    w = spark.createDataFrame([(1, 5.0), (2, 6.0)], "index long, a double")
    assert [tuple(r) for r in align.wide_frames(f, w).collect()] == [(1, 60.1, 5.0)]


def test_rack_history_needs_its_keys(spark, tmp_path):
    good = spark.createDataFrame([("r", 1, 2.0, None, 3.0, None, None)], bus.RACK_HISTORY)
    bus.append_rack_history(good, str(tmp_path / "h"))
    assert bus.rack_history(spark, str(tmp_path / "h"), "r", 5).first().status == "--"
    with pytest.raises(Exception, match="captured_at is missing"):
        bus.append_rack_history(good.withColumn("captured_at", F.lit(None).cast("double")), str(tmp_path / "h"))


def test_combined_smooth(spark):
    """Spikes and fast waves go, the slow wave stays, in each run by itself; and it is what its parts give one after another."""
    i = np.arange(600)
    slow, fast = 0.05 * np.sin(i / 60), 0.02 * np.sin(i * 1.3)
    rows = []
    for run in (0, 1):
        x = 60 + slow * (1 + run) + fast
        x[[50, 51, 200, 333]] += 3.0
        rows += [(run, int(k), float(v)) for k, v in zip(i, x)]
    df = spark.createDataFrame(rows, "run_id long, idx long, frq double")
    got = enf.smoothed(df).orderBy("run_id", "idx").collect()
    clean = enf.interpolated(enf.hampel(df, 11, 2.0)).orderBy("run_id", "idx").collect()
    for run in (0, 1):
        own = np.array([r.smooth for r in got if r.run_id == run])
        assert np.abs(own - 60 - slow * (1 + run))[40:-40].max() < 0.01
        parts = 60 + enf.lowpass(np.array([r.clean for r in clean if r.run_id == run]) - 60, 10, 0.04)
        assert np.allclose(own, parts, atol=1e-9)
