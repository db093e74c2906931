"""The mix against targets found by plain iteration."""

from voltwarden.llm import mixing


def water(sizes, weights, cap):
    """Targets by sharing again what exceeds a cap until none is above."""
    target, fixed, total = dict.fromkeys(sizes, 0.0), set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in fixed)
        open_ = [s for s in sizes if s not in fixed]
        w = sum(weights[s] for s in open_)
        for s in open_:
            target[s] = rest * weights[s] / w
        over = [s for s in open_ if target[s] > cap * sizes[s]]
        if not over:
            return target
        for s in over:
            fixed.add(s)
            target[s] = cap * sizes[s]


def test_mix(spark):
    rows = [(i, "w " * (i % 17 + 1), f"s{i % 7 if i % 3 else 0}" if i % 11 else None, 1) for i in range(1500)]
    rows += [(5000, None, "s1", 1), (5001, "", "s1", 1), (5002, " \t", "empty", 1), (5003, "tiny", "zz", 1), (5003, "tiny", "zz", 1), (None, "a b", "s2", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows)
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    want = water(size, {s: 1 + i % 3 for i, s in enumerate(order)}, 3)
    for s in order:
        own = got[got.source.isna()] if s is None else got[got.source == s]
        assert (own.source_size == size[s]).all() and abs(own.target.iloc[0] - want[s]) < 1e-6
        assert abs(own.taken.sum() - want[s]) <= 10
    assert (got.taken <= 3 * got["size"]).all()
    again = mixing.mix(df.repartition(3)).toPandas()
    key = ["doc_id", "text", "source", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    out = mixing.repeated(mixing.mix(df))
    assert out.count() == got.copies.sum() and "copies" not in out.columns
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).first().target == 0


def test_many_sources_and_a_long_document(spark, monkeypatch):
    """Beyond the bound of a broadcast the mix is the same; a document longer than its source's budget doesn't spoil it."""
    rows = [(i, "w " * (i % 9 + 1), f"s{i % 40}") for i in range(800)] + [(900, "long " * 3000, "s1"), (None, "x y", None), (901, "", "s2"), (901, "", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    plain = mixing.mix(df).toPandas()
    monkeypatch.setattr(mixing, "FEW", 3)
    parts = mixing.mix(df).toPandas()
    key = ["doc_id", "text", "source", "target", "taken"]
    assert plain[key].sort_values(key).reset_index(drop=True).equals(parts[key].sort_values(key).reset_index(drop=True))
    for s, own in plain.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= (3000 if s == "s1" else 10)
