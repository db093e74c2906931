"""Personal data against plain regular expressions."""

import hashlib
import random
import re

from voltwarden.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark):
    rng = random.Random(4)
    bits = ["a", "b.c", "@", "@x.y", "1", "23", "4111111111111111", " ", "-", ".", "+", "+1 (555) 123-4567", "256.1.1.1", "10.0.0.1", "%", "_", "é", "😀", "\n", "(", "5500 0000 0000 0004", "001"]
    texts = [None, "", "1" * 30000, "a" * 30000 + "@", "1.1" * 9000, "+1" * 9000, "4 " * 20000, "x@y" * 9000]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(500)]
    df = spark.createDataFrame([(i, t, "k", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, pii string, score double")
    rows = pii.digest(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in pii.BASE]


def test_added_kinds_and_scores(spark):
    text = "bank account DE89370400440532013000 and GB82 WEST 1234 5698 7654 32, not DE88370400440532013000. ssn 123-45-6789, 123-45-6780 example 10.0.0.1 host 10.0.0.2"
    (row,) = pii.scan(spark.createDataFrame([(text,)], "text string")).collect()
    found = {(x.kind, x.found): x.score for x in row.pii}
    assert ("iban", "DE89370400440532013000") in found and ("iban", "GB82 WEST 1234 5698 7654 32") in found and not any("DE88" in f for _, f in found)
    assert ("ssn", "123-45-6789") in found
    assert found["ip", "10.0.0.2"] > found["ip", "10.0.0.1"]
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_plan(spark):
    plan = pii.digest(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_iban_ends_at_its_length(spark):
    cases = [
        ("DE89 3704 0044 0532 0130 00 Please pay", ["DE89 3704 0044 0532 0130 00"]),
        ("DE89370400440532013000 In full", ["DE89370400440532013000"]),
        ("DE89370400440532013000 BIC COBADEFF", ["DE89370400440532013000"]),
        ("GB82 WEST 1234 5698 7654 32 12 EUR", ["GB82 WEST 1234 5698 7654 32"]),
        ("NO93 8601 1117 947 AND DE89370400440532013000 A", ["NO93 8601 1117 947", "DE89370400440532013000"]),
        ("NO12 DE89370400440532013000", ["DE89370400440532013000"]),
        ("MT84MALT011000012345MTLCAST001S X", ["MT84MALT011000012345MTLCAST001S"]),
        ("DE893704004405320130001", []),
        ("DE88370400440532013000 In", []),
        ("FR1420041010050500013M02606 TOTAL and FR14 2004 1010 0505 0001 3M02 606.", ["FR1420041010050500013M02606", "FR14 2004 1010 0505 0001 3M02 606"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)] + [(len(cases), "DE89" * 9000), (len(cases) + 1, "AB12 " * 9000)], "doc_id long, text string")
    got = {r.doc_id: [x.found for x in r.pii if x.kind == "iban"] for r in pii.scan(df).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases] and not got[len(cases)] and not got[len(cases) + 1]


def test_located_is_what_the_text_holds(spark):
    """Places and contexts of matches as they stand in the text, also of short matches that follow each other closely."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    texts = ["", "no match", "a@b.c", "x@y.z" * 30] + ["".join(rng.choice(["a@b.cd", "é😀", " ", "mail ", "q@r.st,", "word"]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("found", F.regexp_extract_all("text", F.lit(pii.EMAIL), F.lit(0)))
    for r in pii.located(df, "text", pii.EMAIL, "found", "at", 40, 24).collect():
        t, end = r.text, 0
        assert [x.found for x in r["at"]] == r.found
        for x, after in zip(r["at"], [*r["at"][1:], None]):
            start = t.index(x.found, end)
            end = start + len(x.found)
            assert (x.start, x.end, x.before) == (start, end, t[max(0, start - 40) : start]), t
            assert x.after == t[end : end + 24][: len(x.after)] and (x.after or end == len(t))


def test_cost_of_many_matches(spark):
    """Ten times the matches in one text take about ten times as long, not a hundred times."""
    import time

    took = []
    for n in (4_000, 40_000):
        df = spark.createDataFrame([(1, "".join(f"user{i}@mail.example.org wrote from 10.0.{i % 256}.7; " for i in range(n)))], "doc_id long, text string")
        pii.digest(df).collect()  # compiled
        start = time.perf_counter()
        (row,) = pii.digest(df).collect()
        took.append(time.perf_counter() - start)
        assert row.n_email == n and row.n_ip == n
    assert took[1] < 30 * max(took[0], 0.3), took
