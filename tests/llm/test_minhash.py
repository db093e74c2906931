"""Sketches and components against all pairs."""

import random
import re

import numpy as np
import pytest

from voltwarden.llm import jaccard, minhash
from voltwarden.llm.shingles import shingle_set

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute(texts):
    """(size, smallest position reachable) of each text."""
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            o = len(s & sets[j])
            if s and sets[j] and 100 * o >= 85 * (len(s) + len(sets[j]) - o):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_every_coordinate_fills_and_estimates_hold():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 300, 5000):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        c = minhash.sketch(s)
        assert c.shape == (minhash.COORDINATES,) and (c == minhash.sketch(s.copy())).all()
        assert len(set(c.tolist())) > 150  # a bin and round of its own each, also where elements repeat
    for n, k in ((6, 5), (20, 17), (300, 250), (3000, 2800)):
        seen = []
        for _ in range(60):
            u = rng.integers(0, 1 << 63, 2 * n - k, dtype=np.uint64)
            seen.append((minhash.sketch(np.sort(u[:n])) == minhash.sketch(np.sort(u[n - k :]))).mean())
        j = k / (2 * n - k)
        assert abs(np.mean(seen) - j) < 0.015 and np.std(seen) < 1.3 * np.sqrt(j * (1 - j) / minhash.COORDINATES)


def test_last_rounds_fill_what_is_left(monkeypatch):
    """With no round to spare, each coordinate takes the least hash of the whole set."""
    monkeypatch.setattr(minhash, "CHUNK", 1)
    s = np.array([3, 77], np.uint64)
    c = minhash.sketch(s)
    assert c.shape == (minhash.COORDINATES,) and len(set(c.tolist())) > 150


def test_components(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(500)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = words(60), []
    for n, size in ((60, 80), (40, 40), (30, 12)):
        first = words(size)
        for _ in range(n):
            x = list(first)
            for _ in range(rng.randint(0, max(1, size // 25))):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            texts.append(" ".join(x))
    texts += [" ".join(words(rng.randint(1, 10)) + passage + words(rng.randint(1, 10))) for _ in range(60)]
    chain = words(100)
    for _ in range(30):
        texts.append(" ".join(chain))
        chain[rng.randrange(100)] = rng.choice(vocabulary)
    texts += [" ".join(words(rng.randint(0, 8))) for _ in range(60)] + [" ".join(words(9000))]
    texts += [None, "", " \t", "a a a a a a a a", "A", "a", "a b c d e f", "A B c d e g", "É x"] * 2
    texts += texts[:80]
    rng.shuffle(texts)
    want = brute(texts)
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(texts)
    assert [r for r in got if want[r.doc_id] != (r.n_shingles, r.component_id) or r.kept != (want[r.doc_id][1] == r.doc_id)] == []
    empty = minhash.near_duplicates(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


@pytest.mark.parametrize("shared", [75, 92])
def test_family_over_one_passage(spark, monkeypatch, shared):
    """All bands of these texts are common ones; links among them come from hubs and from the rarest shingles."""
    monkeypatch.setattr(jaccard, "PAIRS", 2)
    rng = random.Random(shared)
    passage = [f"p{i}" for i in range(shared)]
    texts = []
    for i in range(150):
        own = [f"u{i}x{j}" for j in range(100 - shared)]
        texts.append(" ".join(passage + own if i % 2 else own + passage))
    for i in range(20):
        w = texts[(i * 7) % 150].split()
        w[rng.randrange(100)] = f"z{i}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute(texts)
    assert [r for r in minhash.near_duplicates(df).collect() if want[r.doc_id] != (r.n_shingles, r.component_id)] == []


def test_odd_rows(spark):
    rows = [(None, "one two three four"), (7, "one two three four"), (7, "five six seven eight"), (None, "nine ten eleven"), (None, None), (3, None), (3, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == [
        (False, 3, 0, 3, True), (False, 3, 0, 3, True), (False, 7, 2, 7, True), (False, 7, 2, 7, True),
        (True, 0, 0, 0, True), (True, 0, 1, 0, True), (True, 0, 2, 7, False),
    ]
    with pytest.raises(ValueError):
        minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=84)
    one, other = shingle_set("a b c d", 3), shingle_set("a b c e", 3)
    assert (minhash.sketch(one) == minhash.sketch(other)).mean() < 0.6


def test_sql(spark):
    import duckdb

    texts = ["a b c d e f g h i j k l", "A b c d e f g h i j k l m", "x y", "X  y", None, " ", "q w e r t", "b c d e f g h i j k l m"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(documents).collect())
    with duckdb.connect() as db:
        db.register("documents", documents.toPandas())
        assert got == sorted(db.sql(minhash.SQL).fetchall())
    assert [r[2] for r in got] == [x[1] for x in brute(texts)]


def test_links_known_later(spark):
    """Components joined by more links are those of all links at once."""
    from voltwarden.llm.components import connected, merged

    rng = random.Random(3)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(75)]
    first, more = spark.createDataFrame(edges[:45], "a long, b long"), spark.createDataFrame(edges[45:], "a long, b long")
    want = {(r.node, r.label) for r in connected(first.unionByName(more)).collect()}
    assert {(r.node, r.label) for r in merged(connected(first), more).collect()} == want
    assert {(r.node, r.label) for r in merged(connected(first.limit(0)), more).collect()} == {(r.node, r.label) for r in connected(more).collect()}
    assert {(r.node, r.label) for r in merged(connected(first), more.limit(0)).collect()} == {(r.node, r.label) for r in connected(first).collect()}
