"""Folds in stretches give what one fold over the series gives, to the bit, in few rounds where states are forgotten."""

import random

import pandas as pd
import pytest

from voltwarden.operators import enf, nlr
from voltwarden.operators.stretches import folded


def sums(limit):
    """A sum that starts again when it exceeds the limit."""

    def fold(rows, state):
        s, out = state[0], []
        for v in rows["v"]:
            s = max(0.0, s + v)
            out.append(s)
            s = 0.0 if s > limit else s
        return rows[["k", "i"]].assign(s=out), [s]

    return fold


@pytest.mark.parametrize("steady", [False, True])
def test_rounds(spark, steady):
    rng = random.Random(3)
    rows = [(k, i, 0.01 if steady else rng.gauss(-0.1, 1)) for k in "ab" for i in rng.sample(range(900), 800)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(3)
    fold = sums(1e9 if steady else 4.0)
    out, rounds = folded(df, ["k"], "i", 100, fold, [0.0], "k string, i long, s double")
    want = {}
    for k in "ab":
        own = pd.DataFrame(sorted(r for r in rows if r[0] == k), columns=["k", "i", "v"])
        want |= {(k, i): s for i, s in fold(own, [0.0])[0][["i", "s"]].itertuples(index=False)}
    assert {(r.k, r.i): r.s for r in out.collect()} == want
    assert rounds == 9 if steady else rounds <= 3  # a sum that never returns goes through all stretches


def test_sustained_and_drift(spark, monkeypatch):
    rounds = []

    def counted(*a, **k):
        out, n = folded(*a, **k)
        rounds.append(n)
        return out, n

    for module in (enf, nlr):
        monkeypatch.setattr(module, "folded", counted)
    rng = random.Random(5)
    rows = []
    for run in (1, 2):
        v = 50.0
        for i in range(700):
            v = v + rng.uniform(-3, 3) if rng.random() > 0.05 else rng.choice([20.0, 90.0, 140.0])
            rows.append((run, i, "n", "c", v, i, 1 - abs(rng.gauss(0, 0.05)) - (0.3 if i % 200 > 170 else 0)))
    df = spark.createDataFrame(rows, "run_id long, idx long, node_id string, channel string, value double, frame long, confidence double").repartition(4)
    for make in (lambda d, span: nlr.sustained(d, 20.0, 6.0, 10, 5, span=span), lambda d, span: enf.drift_cusum(d.select("run_id", "idx", "confidence"), 0.03, 1.5, 10, 60, span)):
        whole, parts = make(df, None).collect(), make(df, 80).collect()
        assert rounds and max(rounds) <= 4
        assert sorted(map(tuple, parts)) == sorted(map(tuple, whole)) and len(whole) > 100
