"""Percentiles by selection, and the interval join by dyadic cover."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltwarden.operators import calibrate, scoring


def test_percentiles(spark, monkeypatch):
    monkeypatch.setattr(calibrate, "BUCKETS", 32)  # many rounds
    rng = random.Random(4)
    groups = {"normal": [rng.gauss(0, 1) for _ in range(700)], "ties": [float(rng.randint(0, 3)) for _ in range(300)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-9, 9) for _ in range(200)], "one": [7.5], "endless": [-1.0, 2.0], None: [1.0, 2.0]}
    rows = [(k, v) for k, own in groups.items() for v in own] + [("normal", None), ("normal", float("nan")), ("nothing", None), ("nothing", float("-inf"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = [0.0, 0.01, 0.5, 0.9, 1.0]
    got = {r.k: [r[f"p{i}"] for i in range(5)] for r in calibrate.percentiles(df, F.col("v"), shares, ["k"]).collect()}
    assert got.keys() == {*groups, "nothing"} and got["nothing"] == [None] * 5
    for k in ("normal", "ties", "wide", "one", None):
        assert np.allclose(got[k], np.quantile(groups[k], shares), rtol=1e-12, atol=0), k
    (row,) = calibrate.percentiles(df.where("k = 'normal'"), F.col("v"), [0.25]).collect()
    assert row.p0 == pytest.approx(np.quantile(groups["normal"], 0.25))
    plan = calibrate.percentiles(df, F.col("v"), shares, ["k"])._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()


def cover(spark, first, last):
    (row,) = spark.sql(f"SELECT {first}L AS a, {last}L AS b").select(scoring.dyadic_cover(F.col("a"), F.col("b")).alias("c")).collect()
    return [(n.level, n.node) for n in row.c]


def test_dyadic_cover(spark):
    for first, last in ((0, 0), (5, 5), (3, 17), (8, 15), (-7, 9), (1, 1000)):
        nodes = cover(spark, first, last)
        ticks = [t for level, node in nodes for t in range(node << level, (node + 1) << level)]
        assert sorted(ticks) == list(range(first, last + 1))
    assert len(cover(spark, 12_345_678, 12_345_678 + 365 * 86_400)) < 64


def test_events_and_times(spark):
    rng = random.Random(7)
    attacks = [(i, rng.choice("abc"), s := round(rng.uniform(-500, 5000), 2), s + rng.choice([0.0, 3.5, 60.0, 900.0, -5.0])) for i in range(60)]
    results = [(rng.choice("abcd"), round(rng.uniform(-600, 6000), 2), rng.random() < 0.5) for _ in range(900)]
    results += [(c, s, True) for _, c, s, _ in attacks[:8]] + [(c, e, True) for _, c, s, e in attacks[8:16]] * 2
    r = spark.createDataFrame(results, "component_id string, ts double, failed boolean").repartition(4)
    a = spark.createDataFrame(attacks, "attack_id long, component_id string, start_ts double, end_ts double")
    inside = lambda c, t: [i for i, k, s, e in attacks if k == c and s <= t <= e]
    failed = [(c, t) for c, t, f in results if f]
    caught = {i for c, t in failed for i in inside(c, t)}
    tp = sum(bool(inside(c, t)) for c, t in failed)
    assert tuple(scoring.events(r, a).first()) == (tp, len(failed) - tp, 60 - len(caught))
    want = {i: min((t - s for k, t in failed if k == c and s <= t <= e), default=None) for i, c, s, e in attacks}
    assert {x.attack_id: x.ttd for x in scoring.detection_times(r, a).collect()} == want
    assert tuple(scoring.events(r, a.limit(0)).first()) == (0, len(failed), 0) and tuple(scoring.events(r.limit(0), a).first()) == (0, 0, 60)
