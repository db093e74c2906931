"""Whitened vectors against a dense eigendecomposition."""

import math
import random

import numpy as np
import pytest

from voltwarden.llm import whitening

COLUMNS = "vec_id long, embedding array<float>, n string"


def plain(rows, k):
    """vec_id -> (deviation, whitened up to signs), e / trace, by numpy over all vectors at once."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e]) for i, e in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = (fit * n - s).astype(float) / n
    values, columns = np.linalg.eigh(c.T @ c / n)
    values, columns = values[::-1], columns[:, ::-1]
    k = min(k, int((values > 1e-9 * values[0]).sum()))
    out = []
    for i, x in kept:
        y = np.array(x, dtype=object) * n - s
        out.append((i, int((y * y).sum()), (y.astype(float) / n) @ columns[:, :k] / np.sqrt(values[:k])))
    return out, values[:k] / values.sum(), n


def agree(spark, rows, k, **options):
    got = whitening.whiten(spark.createDataFrame([(i, e, "x") for i, e in rows], COLUMNS).repartition(3), k=k, **options).collect()
    want, explained, n = plain(rows, k)
    assert len(got) == len(want) * len(explained)
    by = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-8 and abs(r.explained / explained[r.component - 1] - 1) < 1e-10
        by.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r.whitened)
    signs = None
    for i, deviation, z in want:
        mine = np.array([by[(i, deviation)][c + 1][0] for c in range(len(z))])
        signs = np.sign(mine * z) if signs is None and np.abs(z).min() > 1e-3 else signs
        assert np.allclose(np.abs(mine), np.abs(z), atol=1e-6)
        if signs is not None:
            assert np.allclose(mine, z * signs, atol=1e-6)
    return got


def test_against_numpy(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + 3 / (1 + j)) for j in range(24)]) for i in range(400)]
    rows += [(1000 + i, list(rows[7][1])) for i in range(150)]  # copies count once
    rows += [(2000, None), (2001, [None] * 24), (2002, [float("nan")] * 24), (2003, [1.0] * 23 + [float("inf")]), (None, [0.5] * 24), (7, [0.25] * 24), (7, [0.75] * 24)]
    got = agree(spark, rows, 6)
    assert {r.passes for r in got} == {1}  # a block as wide as the vectors


def test_a_narrow_block_iterates(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 60)) * np.linspace(2, 1, 60)
    got = agree(spark, [(i, [float(c) for c in v]) for i, v in enumerate(base)], 3, block=8)
    assert {r.passes for r in got} != {1} and max(r.passes for r in got) < 400 and max(r.residual for r in got) <= whitening.CERTIFIED


def test_fewer_components(spark):
    rows = [(i, [float(i % 5), 2.0 * (i % 5), 7.0]) for i in range(20)]
    assert {r.component for r in agree(spark, rows, 16)} == {1}
    same = spark.createDataFrame([(i, [1.0, 2.0], "x") for i in range(4)], COLUMNS)
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [], "x")], COLUMNS)).count() == 0
    assert whitening.whiten(same.limit(0)).columns == whitening.whiten(spark.createDataFrame([(i, [float(i)], "x") for i in range(4)], COLUMNS)).columns


def test_other_lengths_take_no_part(spark):
    rows = [(i, [float(i), float(i * i % 7)]) for i in range(9)]
    mixed = spark.createDataFrame([(i, e, "x") for i, e in rows] + [(50, [1.0], "x"), (51, [1.0, 2.0, 3.0], "x")], COLUMNS)
    assert sorted({r.vec_id for r in whitening.whiten(mixed).collect()}) == list(range(9))


def test_large_entries_stay_exact(spark):
    rows = [(i, [3e7 * i, -1e9 + i]) for i in range(6)] + [(9, [3e38, 1.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame([(i, e, "x") for i, e in rows[:6]], COLUMNS)).collect()}
    want, _, _ = plain(rows[:6], 2)
    assert {i: int(d) for i, d in got.items()} == {i: d for i, d, _ in want}
    assert whitening.whiten(spark.createDataFrame([(i, e, "x") for i, e in rows], COLUMNS)).count() > 0


def test_subspace_alone():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(150, 150)))[0]
    values = np.concatenate([[9.0, 9.0, 7.5, 7.0], np.linspace(6.9, 0.1, 146)])
    a = (q * values) @ q.T
    found = whitening.subspace(lambda x: a @ x, 150, 4)
    assert np.allclose(found.values, values[:4]) and found.passes > 2
    assert np.allclose(np.abs(found.columns[:, 2:].T @ q[:, 2:4]), np.eye(2), atol=1e-7)
    with pytest.raises(RuntimeError):
        whitening.subspace(lambda x: rng.normal(size=(150, x.shape[1])) ** 2 + a @ x, 150, 4)
