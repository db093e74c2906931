"""Queries whose cost must grow as their tables do, and conditions that only larger tables meet."""

import os
import random
import re
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voltwarden import catalog, catalog_verify
from voltwarden.llm import jaccard, minhash, quality
from voltwarden.operators import enf, scoring
from voltwarden.sources import bus, logs
from voltwarden.streaming import checks

SF = "/root/testdata/sf0.001"


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    c = sorted(df.columns)
    return df[c].sort_values(c, na_position="first").reset_index(drop=True)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scenario_303_with_values_over_450(spark, tmp_path):
    db = duckdb.connect()
    db.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 200 < 30 THEN value + 500 ELSE value END AS value) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    db.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    got, want = catalog.QUERIES["scenario_303"](spark, str(tmp_path)).toPandas(), db.sql(catalog.ORACLE_SQL["scenario_303"]).df()
    assert got.label.sum() > 0
    pd.testing.assert_frame_equal(ordered(got), ordered(want), check_dtype=False, rtol=0, atol=1e-9)


def test_time_to_detection_in_parts(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([0, 1, 1, 1, None]), rng.random() < 0.3) for k in "ab" for i in rng.sample(range(300), 150)]
    df = spark.createDataFrame(rows, "layer string, idx long, truth int, hit boolean")
    whole, parts = (scoring.time_to_detection(df, ["layer"], F.col("truth") == 1, F.col("hit"), span) for span in (None, 16))
    pd.testing.assert_frame_equal(ordered(whole.toPandas()), ordered(parts.toPandas()))
    layers = df.where("truth IS NOT NULL").select("idx", "layer", "truth", F.col("hit").cast("double").alias("score"))
    whole, parts = (bus.history_rows(layers, "s", "easy", "t", "d", "now", *span) for span in ([], [16]))
    assert ordered(whole.toPandas()).equals(ordered(parts.toPandas()))


def test_interpolation_looks_ahead_without_a_shrinking_frame(spark):
    df = spark.createDataFrame([(r, i, float(i * i), i % 7 in (0, 1, 5) or i > 17) for r in (1, 2) for i in range(21)], "run_id long, idx long, frq double, flagged boolean")
    out = enf.interpolated(df)
    assert "unboundedfollowing" not in plan(out)
    clean = [r.clean for r in out.where("run_id = 1").orderBy("idx").collect()]
    assert clean[:8] == [4.0, 4.0, 4.0, 9.0, 16.0, 26.0, 36.0, 36.0 + 45.0 / 3] and clean[17:] == [17.0**2] * 4


def _write_logs(path, n: int) -> None:
    for node in ("x1c0s0b0n0", "x1c0s1b0n0"):
        time = lambda i: f"2025-07-17_08:{i // 300:02d}:{i // 5 % 60:02d}.{i % 5 * 200000:06d}"
        gpu = ["# wattameter", "# reading-time " + " ".join(f"gpu-{i}[{u}]" for u in ("mW", "C") for i in range(4))]
        gpu += [f"{time(i)} {i * 10} 2000 oops 1 50 51 52 53" if i % 11 == 3 else f"{time(i)} 1 2" if i % 13 == 4 else f"{time(i)} {i * 10} 2000 1 1 50 51 52 53" for i in range(n)]
        cpu = ["# reading-time " + " ".join(f"cpu-{i}{c}[{u}]" for u in ("uJ", "W") for i in (0, 1) for c in ("", "-core"))]
        cpu += [f"{time(i)} {(i * 9_000_000_000) % 65_500_000_000} 5 6 7 {i} 90 9 5" for i in range(n)]
        for kind, lines in (("nvml", gpu), ("rapl", cpu)):
            (path / f"{kind}_wattameter_{node}.log").write_text("\n".join(lines) + "\n")


def test_a_line_is_taken_apart_once(spark, tmp_path):
    _write_logs(tmp_path, 5)
    assert len(re.findall("map_from_arrays", plan(logs.nvml(spark, f"{tmp_path}/nvml_*")))) <= 2  # once for the rows, once for their positions


def test_node_frames_in_parts(spark, tmp_path, monkeypatch):
    _write_logs(tmp_path, 100)
    whole = logs.node_frames(spark, str(tmp_path)).toPandas()
    monkeypatch.setattr(logs, "LINES", 7)
    parts = logs.node_frames(spark, str(tmp_path))
    assert not re.search(r"windowspecdefinition\(node_id#\d+, (__)?pos#", plan(parts))  # no scan of a node's whole series
    pd.testing.assert_frame_equal(ordered(whole), ordered(parts.toPandas()))
    assert len(whole) == 18 and whole["cpu-0[uJ]"].max() > 7e11  # readings of 9 kJ each, unwrapped


def test_pairs_within_a_component_are_not_verified(spark):
    texts = [" ".join(f"w{j}" if j != 7 * i + 3 else f"own{i}" for j in range(300)) for i in range(12)]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rule = jaccard.Rule(85)
    classes = minhash.describe(given, 3).where("cid IS NOT NULL").select("cid", F.col("doc_id").alias("rep"), "n", "sketch").localCheckpoint()
    a, b = classes.select(F.col("cid").alias("a")), classes.select(F.col("cid").alias("b"))
    pairs = a.crossJoin(b).where("a < b").withColumn("far", F.lit(3).cast("long"))  # 66, all of them links
    labels, left = minhash.nearest_first(pairs, None, given, classes, 3, rule)
    assert labels.count() == 12 and labels.select("label").distinct().count() == 1 and left.count() == 0


def test_a_word_costs_the_same_in_any_number_of_parts():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 1 << 62, 3000).astype(np.uint64)
    few = [(cid, 7, rng.choice(words, 90, replace=False)) for cid in range(1, 10)]
    long = (1 << 62, 7, rng.integers(1, 1 << 62, 20_000).astype(np.uint64))
    found = []
    for parts in (3, 4000):
        blocks = pd.concat([b.to_pandas() for b in jaccard.blocked(iter([long, *few]), parts)])
        assert sum(len(v) for c in blocks for v in blocks[c] if c != "part") <= 15 * (20_000 + 9 * 90)
        pairs = [jaccard.shared_words((k,), g, parts) for k, g in blocks.groupby("part")]
        found.append(set(pd.concat(pairs)[["a", "b"]].itertuples(index=False, name=None)))
    assert found[0] == found[1] == {(a, b) for a, _, x in few for b, _, y in few if a < b and set(x.tolist()) & set(y.tolist())}


def test_the_classifier_is_not_trained_in_the_driver(spark, monkeypatch):
    monkeypatch.setattr(quality, "train", lambda bags, y: SimpleNamespace(bias=0.0, pid=os.getpid(), n=len(bags), y=y.tolist()))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model.pid != os.getpid() and model.n == len(model.y) > 20 and sorted(model.y) == model.y  # in the order in which they were picked


def test_frames_of_the_verifier_are_computed_once(spark):
    assert not any("events.parquet" in f for f in catalog.QUERIES["verify_runs"](spark, SF).inputFiles())


class _Calls:
    """A state that counts how often it is asked."""

    def __init__(self, count):
        self.held, self.count = {}, count

    def __getattr__(self, name):
        def call(key=(), value=None):
            self.count.append(name)
            if name in ("get", "getValue"):
                return self.held.get(key if name == "getValue" else ())
            if name in ("exists", "containsKey"):
                return (key if name == "containsKey" else ()) in self.held
            if name in ("update", "put", "updateValue"):
                self.held[key if name == "updateValue" else ()] = value if name == "updateValue" else key

        return call


def test_a_key_asks_for_its_state_a_few_times():
    count = []
    made = checks.NodeChecks(catalog_verify.NODES, ["run_id", "node_id", "channel"], 60.0, 60.0)
    made.init(SimpleNamespace(getValueState=lambda *a: _Calls(count), getListState=lambda *a: _Calls(count), getMapState=lambda *a: _Calls(count)))
    made.wake = lambda timers: None
    rows = pd.DataFrame({"idx": range(40), "value": [float(i % 9 * 10) for i in range(40)], "frame": range(40), "kind": "gpu_power"})
    told = []
    for part in (rows[:17], rows[17:]):
        told += list(made.handleInputRows((1, "n", "c"), iter([part]), None))
        assert len(count) <= 4
        count.clear()
    assert "REPLAY" in set(told[1]["code"])  # with the values that the first part left
