"""Window forms against plain sequential folds on random series, and the cases that checks are defined by."""

import random

import numpy as np
import pytest

from voltwarden.functions import channels, status
from voltwarden.operators import attacks, enf, nlr, scoring, verdict, views
from pyspark.sql import functions as F


def test_sibling_ratio_of_zeros(spark):
    rows = [(0, "a", "g0", 0.0), (0, "a", "g1", 0.0), (0, "a", "g2", 0.0), (1, "a", "g0", 5.0), (1, "a", "g1", 0.0), (1, "a", "g2", 0.0), (2, "a", "g0", 9.0), (2, "a", "g1", 2.0), (2, "a", "g2", 2.0)]
    df = spark.createDataFrame(rows, "idx long, node_id string, channel string, value double")
    assert sorted((r.idx, r.channel, r.observed) for r in nlr.sibling_ratio(df, 0.5, 2.0).collect()) == [(1, "g1", 0.0), (1, "g2", 0.0), (2, "g0", 4.5), (2, "g1", 2.0 / 5.5), (2, "g2", 2.0 / 5.5)]


def long(spark, values, node="n", channel="c"):
    return spark.createDataFrame([(i, node, channel, float(v), i) for i, v in enumerate(values)], "idx long, node_id string, channel string, value double, frame int")


def ranks(df):
    return {r.idx: (r.status_rank, r.code) for r in df.collect()}


def test_range_and_step(spark):
    df = long(spark, [70, 950, -1, 800, 800.1])
    assert [r for r, _ in (ranks(nlr.value_range(df, 0, 800))[i] for i in range(5))] == [0, 2, 2, 0, 2]
    assert [ranks(nlr.continuity(df, 400))[i][0] for i in range(5)] == [0, 2, 2, 2, 0]


def test_monotonicity_cases(spark):
    wrap = ranks(nlr.monotonicity(long(spark, [65.0e9, 0.3e9]), 65.5e9, 2e9, 2.4e9))
    assert wrap[1] == (0, "ok")
    back = ranks(nlr.monotonicity(long(spark, [40e9, 10e9, 12e9, 41e9]), 65.5e9, 2e9, 2.4e9))
    assert [back[i][1] for i in (1, 2)] == ["MONOTONICITY VIOLATION"] * 2
    assert ranks(nlr.monotonicity(long(spark, [1e9, 51e9]), 65.5e9, 2e9, 2.4e9))[1][1] == "ENERGY SPIKE"
    up = nlr.unwrapped(long(spark, [65e9, 1e9, 2e9, 1.5e9, 0.5e9, 64e9, 1e9]), 65.5e9, 2e9).orderBy("idx").collect()
    assert [r.unwrapped / 1e9 for r in up] == pytest.approx([65, 66.5, 67.5, 67, 66, 129.5, 132])


def test_ramp_cases(spark):
    f = lambda v: ranks(nlr.startup_ramp(long(spark, v), 400, 700, 200, 5))
    assert not any(r for r, _ in f([70] * 195).values())
    assert f([70] * 210)[205] == (2, "STARTUP RAMP")
    assert not any(r for r, _ in f([70] * 100 + [500] * 150).values())
    late = f([70] * 205 + [500] * 8)
    assert late[204][0] == 2 and late[209][0] == 0 and late[212][0] == 0


def test_replay_cases(spark):
    f = lambda v: ranks(nlr.replay(long(spark, v), 4, 100, 5))
    assert f([70 + i * 0.37 for i in range(300)]) == {} and f([70] * 300) == {}
    v = [50 + i * 1.7 for i in range(20)]
    hit = f(v + v[10:14] + [200 + i * 3.1 for i in range(10)])
    assert hit[23] == (2, "REPLAY") and hit[28] == (0, "ok") and 29 not in hit


def test_replay_as_fold(spark):
    rng = random.Random(1)
    v = [rng.choice([10.0, 20.0, 30.0, 2.0]) for _ in range(400)]
    buffer, since, want = [], None, {}
    for i, x in enumerate(v):
        if x < 5:
            continue
        buffer.append(x)
        tail, past = buffer[-4:], buffer[-100:]
        hit = len(tail) == 4 and len(set(tail)) > 1 and any(past[j : j + 4] == tail for j in range(len(past) - 7))
        since = 0 if hit else None if since is None else since + 1
        if since is not None and since <= 5:
            want[i] = 2 if since < 5 else 0
    assert {i: r for i, (r, _) in ranks(nlr.replay(long(spark, v), 4, 100, 5)).items()} == want


def test_local_cusum_as_fold(spark):
    rng = random.Random(2)
    c = [round(rng.choice([rng.uniform(0.9, 1), rng.uniform(0.5, 1)]) if i % 120 > 40 else rng.uniform(0.9, 1), 3) for i in range(500)]
    s, run, want = 0.0, 0, []
    for i, x in enumerate(c):
        s = max(0.0, s + (1 - x) - 0.03 - (0.03 if i + 1 >= 10 and 1 - x < 0.03 else 0))
        run = run + 1 if x >= 0.85 else 0
        s = 0.0 if run >= 20 else s
        want.append(s)
    df = spark.createDataFrame(list(enumerate(c)), "idx long, confidence double")
    got = [r.cusum for r in enf.local_cusum(df, 0.03, 2.0, 10, 0.85, 20).orderBy("idx").collect()]
    assert got == pytest.approx(want, abs=1e-9)


def test_sequence_guard(spark):
    f = lambda ts, **k: [r.code for r in enf.sequence_guard(spark.createDataFrame(list(enumerate(map(float, ts))), "seq long, ts double"), **k).orderBy("seq").collect()]
    assert f([1, 2, 1]) == ["ok", "ok", "REPLAY"] and f([5, 3]) == ["ok", "OUT OF ORDER"]
    assert f([5, 3, 3, 5], strict=False) == ["ok", "ok", "REPLAY", "REPLAY"]


def test_sustained(spark):
    f = lambda v: ranks(nlr.sustained(long(spark, v), 400, 150, 150, 5))
    base = [500.0] * 160
    held = f(base + [50.0] * 3 + [480.0])
    assert [held[i][0] for i in (160, 161, 162, 163)] == [2, 2, 2, 0]
    plateau = f(base + [50.0] * 8)
    assert plateau[165] == (0, "ok") and 166 not in plateau
    assert f([500.0] * 100 + [50.0] * 5) == {}


def test_anchor_and_flat(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([60 + rng.normal(0, 0.02, 40), np.full(30, 60.0)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "idx long, frq double")
    got = enf.anchors(df, 9).orderBy("idx").collect()
    window = lambda i: np.array([x[min(max(j, 0), len(x) - 1)] for j in range(i - 9, i + 10)])
    for i, r in enumerate(got):
        w = window(i)
        assert r.flat == (w.max() == w.min())
        if i:
            p = window(i - 1)
            want = 0.0 if w.std() == 0 or p.std() == 0 else float(np.corrcoef(w, p)[0, 1])
            assert r.confidence == pytest.approx(want, abs=1e-6)
    assert got[0].confidence == 1.0 and got[60].signature == [0.5] * 19


def test_lowpass_and_hampel():
    t = np.arange(2000)
    slow, fast = np.sin(2 * np.pi * t * 0.004), np.sin(2 * np.pi * t * 0.2)
    y = enf.lowpass(slow + fast, 10, 0.04)
    assert np.abs(y - slow)[100:-100].max() < 0.02
    assert np.abs(enf.lowpass(np.full(200, 3.0), 10, 0.04) - 3).max() < 1e-9
    x = np.sin(t / 30)
    x[500] += 5
    bad = enf.hampel_flags(x, 11, 2.0, 1.4826)
    assert bad[500]


def test_corroboration(spark):
    def run(steps, limit=16.0):
        rows = [(1, f"n{i:02d}", "cpu-0[W]", 1, 2 if s > limit else 0, "DISCONTINUITY" if s > limit else "ok", float(s), limit) for i, s in enumerate(steps)]
        df = spark.createDataFrame(rows, "idx long, node_id string, channel string, check_ord int, status_rank int, code string, observed double, limit double")
        m = verdict.corroborated(verdict.merged(df, ["idx", "node_id", "channel"]), 4, 0.5, 1.2)
        return [r.status_rank for r in m.orderBy("node_id").collect()]

    assert run([18] * 14 + [0, 0]) == [1] * 14 + [0, 0]
    assert run([25] + [0] * 15) == [2] + [0] * 15
    assert run([18, 17]) == [1, 1] and run([25, 0]) == [2, 0]
    assert run([25] * 7 + [0] * 9) == [2] * 7 + [0] * 9
    assert run([18] * 8 + [0] * 8) == [1] * 8 + [0] * 8


def test_event_scoring(spark):
    attack = spark.createDataFrame([(1, "c", 10.0, 20.0)], "attack_id long, component_id string, start_ts double, end_ts double")
    rows = lambda *ts: spark.createDataFrame([("c", float(t), True) for t in ts], "component_id string, ts double, failed boolean")
    assert tuple(scoring.events(rows(15), attack).first()) == (1, 0, 0)
    assert tuple(scoring.events(rows(50), attack).first()) == (0, 1, 1)
    assert scoring.detection_times(rows(13, 17), attack).first().ttd == 3.0
    with pytest.raises(ValueError):
        scoring.without_labels(spark.createDataFrame([(1, 0)], "idx int, ENF_attack int"))
    with pytest.raises(ValueError):
        scoring.aligned(spark.range(3).withColumnRenamed("id", "idx"), spark.range(4).withColumnRenamed("id", "idx"))


def test_incidents(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "node_id string, severity int, start_ts double, end_ts double, samples long, vector string, peak double, ongoing boolean")
        return views.incidents(df, 5.0, ["severity"]).orderBy("start_ts").collect()

    one = run([(f"n{i}", 1, 100 + i * 0.2, 100 + i * 0.2, 1, "Replay", 1.0, False) for i in range(10)])
    assert len(one) == 1 and one[0].nodes == 10 and one[0].vectors == ["Replay"]
    assert len(run([("a", 1, 0.0, 0.0, 1, "x", 1.0, False), ("b", 1, 60.0, 60.0, 1, "x", 1.0, False)])) == 2
    assert len(run([("a", 1, 0.0, 1.0, 1, "x", 1.0, False), ("b", 1, 6.0, 6.0, 1, "x", 1.0, False)])) == 1
    assert len(run([("a", 1, None, None, 1, "x", 1.0, False), ("b", 1, None, None, 1, "x", 1.0, False)])) == 2


def test_attack_conditions(spark):
    df = spark.createDataFrame([(i, "n", True, float(i)) for i in range(10)], "idx long, node_id string, target boolean, value double")
    hit = {r.idx for r in attacks.inject(df, 2, 8, "bias", 1, only=("under", 5)).where("label = 1").collect()}
    assert hit == {2, 3, 4}
    assert attacks.inject(df, 2, 8, "bias", 1, only=("odd", 5)).where("label = 1").count() == 0
    assert attacks.pool(2, True) == ["202", "204", "205"] and attacks.pool(3, False) == ["301", "303"]
    gpu = df.withColumn("channel", F.lit("gpu-0[W]"))
    some = attacks.scenario(gpu, ["node_id"], F.concat_ws("_", "node_id", "channel"), 10, "201").orderBy("idx").collect()
    assert [r.label for r in some] == [0, 0, 0, 1, 1, 1, 1, 0, 0, 0] and some[3].attacked == 28.0
    third = attacks.output(attacks.inject(gpu, 2, 3, "scale", 1 / 3)).orderBy("idx").collect()
    assert third[2].value == 0.6667 and third[3].value == 3.0
    assert attacks.bounds(1800, 0.25, 0.5) == (450, 900)


def test_names(spark):
    names = ["x1000c0s0b0n0_gpu-3[W]", "gpu-1[C]", "a_b_cpu-0-core[uJ]", "FRQ", "a_gpu[W]"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(channels.node_of(F.col("n")).alias("a"), channels.bare(F.col("n")).alias("b"), channels.kind(F.col("n")).alias("c"), channels.is_core(F.col("n")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("x1000c0s0b0n0", "gpu-3[W]", "gpu_power", False), (None, "gpu-1[C]", "gpu_temp", False), ("a_b", "cpu-0-core[uJ]", "cpu_uj", True), (None, None, None, False), (None, None, None, False)]
    one = spark.createDataFrame([("12:00:05", "x")], "c string, n string").select(status.seconds(F.col("n"), F.col("c")).alias("s")).first()
    assert one.s == 43205


@pytest.mark.parametrize("which", ["204", "302", "304"])
def test_frequency_presets_track(spark, which):
    rng = np.random.default_rng(4)
    x = 60 + np.cumsum(rng.normal(0, 0.002, 100))
    rows = [(i, None, "FRQ", float(v)) for i, v in enumerate(x)] + [(i, "n", "gpu-0[W]", 100.0 + i) for i in range(100)]
    df = spark.createDataFrame(rows, "idx long, node_id string, channel string, value double")
    run = lambda: attacks.scenario(df, ["node_id"], F.concat_ws("_", "node_id", "channel"), 100, which, seed=6).orderBy("idx").collect()
    got = run()
    assert len(got) == 200 and all(r.label == 0 and r.attacked == r.value for r in got if r.channel != "FRQ") and got == run()
    engine, _, start, end, params = attacks.SCENARIOS[which]
    lo, hi = attacks.bounds(100, start, end)
    past = x[:lo]
    d, p, q = np.diff(past), past[:-1] - past.mean(), past[1:] - past.mean()
    noise, phi = np.sqrt((d * d).mean()), np.clip((p * q).sum() / (p * p).sum(), -0.99, 0.99)
    draws = [r.e for r in df.where("channel = 'FRQ'").select("idx", attacks.normal_draws(6, "idx").alias("e")).orderBy("idx").collect()]
    last, want = None, []
    for i, live in enumerate(x):
        if not lo <= i < hi:
            want.append(live)
            continue
        last = live + np.clip(phi * ((live if last is None else last) - live) + draws[i] * noise * 0.5, -0.01, 0.01)
        last = last + params["max_value"] * (i - lo) / (hi - lo) if engine == "drift" else last + params["value"] if params["type"] == "bias" else last * params["value"]
        want.append(last)
    frq = [r for r in got if r.channel == "FRQ"]
    assert [r.label for r in frq] == [int(lo <= i < hi) for i in range(100)]
    assert [r.attacked for r in frq] == pytest.approx(want, abs=1e-9)
