"""Series scanned in parts give the rows of series scanned whole."""

import random

import pytest
from pyspark.sql import functions as F

from voltwarden.operators import align, nlr
from voltwarden.operators.spans import earlier
from voltwarden.sources import logs

SPAN = 110


@pytest.fixture(scope="module")
def readings(spark):
    """One series long enough for many parts, some short ones, with steps in idx, nulls and repeats."""
    rng = random.Random(9)
    rows = []
    for run, node, n in ((1, "a", 1300), (1, "b", 30), (2, "a", 250)):
        v, i, energy = 50.0, 0, 0.0
        for k in range(n):
            i += rng.choice([1, 1, 1, 2, 7])
            v = rng.choice([v, v + rng.uniform(-30, 30), 40.0, 45.0, 0.5]) if k % 90 < 60 else [40.0, 41.0, 43.0, 47.0][k % 4]
            energy = energy + rng.choice([5.0, 9.0, 60.0, -3.0]) if energy < 850 else energy - 890
            rows.append((run, i, node, "c", None if rng.random() < 0.03 else round(v, 2), k))
            rows.append((run, i, node, "uj", energy, k))
    return spark.createDataFrame(rows, "run_id long, idx long, node_id string, channel string, value double, frame long").repartition(5)


CHECKS = {
    "continuity": lambda df, span: nlr.continuity(df, 12.0, span),
    "unwrapped": lambda df, span: nlr.unwrapped(df, 900.0, 300.0, span),
    "monotonicity": lambda df, span: nlr.monotonicity(df.where("channel = 'uj'"), 900.0, 80.0, 50.0, span),
    "startup_ramp": lambda df, span: nlr.startup_ramp(df, 39.0, 48.0, 5, 25, span=span),
    "replay": lambda df, span: nlr.replay(df.where("value IS NOT NULL"), 4, 100, 5.0, span=span),
    "tumbling": lambda df, span: align.tumbling(df, 10, ["run_id", "node_id", "channel"], ["value"], span=span),
}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_as_whole(readings, name):
    whole, parts = CHECKS[name](readings, None), CHECKS[name](readings, SPAN)
    assert sorted(parts.columns) == sorted(whole.columns)
    key = lambda r: tuple((v is None, round(v, 6) if isinstance(v, float) else v or 0) for v in r)
    got, want = (sorted(map(key, df.select(sorted(whole.columns)).collect())) for df in (parts, whole))
    assert got == want and len(want) > 50


def test_parts_are_small(readings):
    """The longest series lies in over eight parts, none of them a quarter of it."""
    sizes = readings.where("run_id = 1 AND node_id = 'a'").groupBy("channel", F.floor(F.col("idx") / SPAN)).count().collect()
    assert len(sizes) > 16 and max(r["count"] for r in sizes) < 1300 / 4


def test_earlier(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([None, rng.randint(-9, 9)])) for k in ("x", "y") for i in rng.sample(range(400), 150)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(4)
    got = earlier(df, ["k"], "i", 37, sums={"n": F.coalesce("v", F.lit(0))}, most={"m": F.col("v")}, last={"l": F.col("v"), "p": F.struct("v")}).collect()
    assert len(got) == 300
    for r in got:
        before = [v for k, i, v in sorted(rows, key=lambda x: x[1]) if k == r.k and i < r.i]
        known = [v for v in before if v is not None]
        assert r.n == sum(known) and r.m == (max(known) if known else None) and r.l == (known[-1] if known else None)
        assert (r.p is None) == (not before) and (not before or r.p.v == before[-1])


def test_lines_of_files_read_in_parts(spark, tmp_path):
    lines = {f"{n}.txt": [f"{n} line {i} " + "x" * (i % 50) for i in range(3000)] for n in ("one", "two")}
    for name, own in lines.items():
        (tmp_path / name).write_text("\n".join(own) + "\n")
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    session.conf.set("spark.sql.files.openCostInBytes", "0")
    rows = logs.numbered_lines(session, str(tmp_path))
    assert rows.rdd.getNumPartitions() and session.read.text(str(tmp_path)).rdd.getNumPartitions() > 16
    got = {(r.path.rsplit("/", 1)[1], r.line_no): r.line for r in rows.collect()}
    assert got == {(name, i): line for name, own in lines.items() for i, line in enumerate(own)}
