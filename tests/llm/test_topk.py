"""Exact top-k against all scores."""

import numpy as np
from pyspark.sql import functions as F

from voltwarden.llm import topk


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 6).round(2).tolist(), "r") for i in range(700)]
    rows += [(700 + i, [0.5] * 6, "r") for i in range(120)]
    rows += [(900, None, "r"), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], "r"), (902, [float("nan")] * 6, "r"), (903, [float("inf")] * 6, "r"), (904, [], "r"), (None, [1.0] * 6, "r"), (950, [1.0, 2.0], "r"), (951, [1.0, 1.0], "r")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").repartition(3)
    everyone = F.col("vec_id") % 50 == 0
    got = topk.top_k(df, everyone, k=5, pivots=8, block=64).toPandas()
    ok = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, v in ok:
        if i % 50 == 0:
            scores = sorted(((-int(v @ w), j) for j, w in ok if j != i and len(w) == len(v)))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].values.tolist())) == sorted(want)
    # more queries than a part holds: at least ten parts
    many = topk.top_k(df, everyone, k=5, pivots=8, block=64, part=1).toPandas()
    assert sorted(map(tuple, many[["query_id", "rank", "vec_id", "score"]].values.tolist())) == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_only_necessary_vectors_are_sent(spark):
    """In the second round a vector goes to the parts of groups that its cell and its own bound reach, and no others."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 40, (12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.5, 8)).round(3).tolist()) for i in range(2400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ready = df.select(F.col("vec_id").alias("id"), topk.whole(F.col("embedding")).alias("v"), (F.col("vec_id") % 5 == 0).alias("q")).cache()
    search = topk.Search(ready, 8, 5, 12, 600, 100, 10)
    assert search.cells.first.max() + search.cells.count.max() >= 10 and search.cells.blocks.max() >= 2
    first = search.solved(search.routed(search.queries(), False), None).cache()
    routed, least = search.rest(first)
    pairs = {(r.cell, r.own) for r in routed.select("cell", "own").distinct().collect()}
    placed, sent = search.placed.toPandas(), 0
    for r in placed.itertuples():
        v = np.array(r.v, float)
        groups = [g for g in range(12) if (r.cell, g) in pairs and topk.above(v @ search.cells.points[g] + np.linalg.norm(v) * search.cells.q_radius[g], least[g])]
        sent += len({p for g in groups for p in range(search.cells.first[g], search.cells.first[g] + search.cells.count[g])})
    reach = np.zeros((12, 12), bool)
    reach[tuple(np.array(sorted(pairs)).T)] = True
    assert search.sent(reach, least).count() == sent
    assert sent < 0.5 * len(rows) * (search.cells.first.max() + 1)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, k=5, pivots=12, block=100, part=10).collect())
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    want = []
    for i in range(0, 2400, 5):
        best = sorted((-int(x[i] @ x[j]), j) for j in range(2400) if j != i)[:5]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)
