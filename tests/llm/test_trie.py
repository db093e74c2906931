"""The trie's nodes against a plain build from whole paths."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from voltwarden.llm import trie

FIELDS = "conv_id long, turn long, role string, text string, rank string"
HASH = hashlib.sha256


def said(role, text):
    raw = f"{len(role)}:{role}{text}".encode()
    return hashlib.md5(raw).digest()


def plain(rows, heads=4, group=20):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((t is not None, t or 0, said(role, text), role, text))
    convs = {c: [x[3:] for x in sorted(own)] for c, own in convs.items()}
    out, members, ends, words = {}, defaultdict(list), defaultdict(list), {}
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % heads if heads else 0
        base = int(c / group) * group
        path = tuple(convs.get(base, [])[:h] + convs[c][h:]) if heads else tuple(convs[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    for p in members:
        words[p] = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)

    def under(p):
        below = [p]
        for q in below:
            below += kids[q]
        return below

    for p, m in members.items():
        sub = under(p)
        listed = ",".join(map(str, sorted(ends[p])))
        out[(min(m), len(p))] = (min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in sub), sum((len(members[q]) - 1) * words[q] for q in sub), HASH(listed.encode()).hexdigest(), len(sub))
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], FIELDS).repartition(parts)
    own, lengths = trie.turns(df)
    got = trie.trie(*trie.regrown(own, lengths)).collect()
    mine = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256, r.subtree_end - r.rank) for r in got}
    assert len(mine) == len(got) and mine == plain(rows)
    spans = {r.rank: r.subtree_end for r in got}
    assert sorted(spans) == list(range(len(got)))
    for at, end in spans.items():  # intervals nest
        assert all(spans[k] <= end for k in range(at, end))
    return got


def test_against_plain(spark):
    rng = random.Random(6)
    rows = []
    for c in range(140):
        for t in range(rng.randint(0, 6)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 1 else "user", f"w{rng.randrange(3)} and  more"))
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(60) for t in range(4)]  # copies
    rng.shuffle(rows)
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(5, None, None, None), (5, None, "", ""), (5, 1, "a", "x y"), (5, 1, "a", "x y"), (5, 2, "b", None), (None, 0, "a", "lost"), (-3, 0, "a", "b"), (-23, 1, "a:", "b"), (-20, 1, "a", ":b"), (41, 0, "user", "only"), (44, 7, "user", "z"), (60, 0, "q", "é\x0bf \t g")]
    rows += [(61, t, "q", "é\x0bf \t g") for t in range(3)]
    check(spark, rows)
    empty = spark.createDataFrame([], FIELDS)
    assert trie.trie(*trie.regrown(*trie.turns(empty))).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    some = [c for c in range(21, 400) if zlib.crc32(str(c).encode()) % 4 >= 2][:3]
    got = check(spark, [(c, 0, "user", "gone") for c in some])
    assert len(got) == 1 and got[0].n_convs == 3 and got[0].n_leaves == 1


def test_long_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "TURNS", 8)
    monkeypatch.setattr(trie, "RANKS", 5)
    monkeypatch.setattr(trie, "IDS", 10)
    rows = [(c, t, "user", f"t{t if t < 20 * c + 3 else t * 100 + c}") for c in range(6) for t in range(90)]
    rows += [(c, t, "user", f"t{t}") for c in range(100, 140) for t in range(c % 30)]
    check(spark, rows)
