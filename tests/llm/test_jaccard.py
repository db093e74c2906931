"""Components against all pairs, with groups of copies, near copies and shared passages."""

import random
import re
from collections import defaultdict

import numpy as np

from voltwarden.llm import common, jaccard
from voltwarden.llm.shingles import shingle_set

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {d: plain_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    groups = defaultdict(list)
    for d, s in sets.items():
        if s:
            groups[s].append(d)
    classes = list(groups)
    for i, s in enumerate(classes):
        for d in groups[s][1:]:
            a, b = sorted((find(groups[s][0]), find(d)))
            root[b] = a
        for r in classes[:i]:
            o = len(s & r)
            if 100 * o >= 80 * (len(s) + len(r) - o):
                a, b = sorted((find(groups[s][0]), find(groups[r][0])))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_components(spark):
    rng = random.Random(5)
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
    texts += [None, "", " \t", "a a a a a a a a", "A", "a", "a b c d e f", "A B c d e g", "É x"] * 2
    texts += texts[:80]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component_id string").repartition(5)
    want = brute(rows)
    got = jaccard.components(df).collect()
    assert len(got) == len(rows)
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got if want[r.doc_id] != (r.n_shingles, r.component_id)] == []
    assert jaccard.components(df.limit(0)).count() == 0


def test_blocks_without_pairs_of_words(spark, monkeypatch):
    """With two classes already a common word, all links come from hubs, counting and blocks."""
    monkeypatch.setattr(jaccard, "PAIRS", 1)
    rng = random.Random(2)
    first = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        x = list(first)
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(60)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(x)))
    want = brute(rows)
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_bounds():
    rule, rng = jaccard.Rule(), random.Random(3)
    for _ in range(300):
        n = rng.choice([3, 8, 30, 200, 1500])
        a = [f"x{i}" for i in range(n + 4)]
        b = list(a)
        for _ in range(rng.randint(0, 2 + n // 20)):
            b[rng.randrange(len(b))] = f"y{rng.randrange(99)}"
        s, t = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        apart = len(set(s.tolist()) ^ set(t.tolist()))
        assert jaccard.hamming(jaccard.bit_sketch(s), jaccard.bit_sketch(t)) <= apart
        if apart <= rule.apart(len(s) + len(t)):
            p = {k for _, keys, _ in rule.keys(s) for k in keys.tolist()}
            assert any(k in p for _, keys, _ in rule.keys(t) for k in keys.tolist())


def test_star_round_a_set_in_one_word(spark):
    """Variants of a set whose shingles all lie in one word: only that word shows their links, and many classes share it."""
    rule = jaccard.Rule()
    band = int(np.searchsorted(jaccard.BANDS, 6))
    place = lambda s: set((((s >> np.uint64(32)) * np.uint64(rule.words(band))) >> np.uint64(32)).tolist())
    first = next(t for i in range(100000) if len(place(shingle_set(t := " ".join(f"w{i}x{j}" for j in range(9))))) == 1)
    more = [t for j in range(60) if len(place(shingle_set(t := f"{first} v{j}"))) == 2]
    assert len(more) > jaccard.PAIRS
    rows = list(enumerate([first, *more]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df).collect()} == brute(rows)


def test_texts_that_share_most_of_a_passage(spark, monkeypatch):
    """Hundreds of texts over one long passage, too unlike to be linked, with some linked ones among them: the last step finds
    the links, and where less than 0.8 of the sets is common it makes no pair of the others."""
    monkeypatch.setattr(jaccard, "SPARE", 0)
    seen = []
    plain = jaccard.shingle_pairs
    monkeypatch.setattr(jaccard, "shingle_pairs", lambda *a: seen.append(common.written(plain(*a), "seen", keep=True)) or seen[-1])
    for shared, alone in ((75, 25), (85, 15), (93, 7)):
        rng = random.Random(shared)
        passage = [f"p{i}" for i in range(shared)]
        rows = []
        for i in range(240):
            own = [f"u{i}x{j}" for j in range(alone)]
            rows.append((i, " ".join(passage + own if i % 2 else own + passage)))
        for i in range(240, 260):  # near copies of some of them
            words = rows[(i * 7) % 240][1].split()
            words[rng.randrange(100)] = f"z{i}"
            rows.append((i, " ".join(words)))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        seen.clear()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df).collect()} == brute(rows)
        if shared == 75:
            assert not seen or seen[0].count() < 260


def test_last_step_by_itself(spark):
    """Over classes that are all left over, candidates of the last step hold every link between components."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(80)]
    texts = [" ".join(passage[: rng.randint(60, 80)] + [f"u{rng.randrange(40)}" for _ in range(rng.randint(2, 25))]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rule = jaccard.Rule()
    docs = jaccard.describe(df, 5, rule).toPandas()
    firsts = docs.dropna(subset=["sketch"]).drop_duplicates("cid")
    classes = spark.createDataFrame([(int(r.cid), int(r.doc_id), int(r.n), r.sketch) for r in firsts.itertuples()], "cid long, rep long, n long, sketch binary")
    short = classes.select("cid", classes["cid"].alias("label"))
    got = {(r.a, r.b) for r in jaccard.shingle_pairs(short, df, classes, 5, rule).collect()}
    sets = {int(r.cid): plain_set(texts[int(r.doc_id)]) for r in firsts.itertuples()}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * (o := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - o)}
    assert links and links <= got
