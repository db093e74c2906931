"""Raw files, records and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from voltwarden.sources import bus, logs
from voltwarden.streaming import live


def test_frequency(spark, tmp_path):
    (tmp_path / "Dev1_ENF_Hr03.csv").write_text("UTC: 2025-07-17 08:00:00,Duration: 1 Hour\n0,60.01\n\n1\n2,bad\n3,-5.0\n4,123.5\n")
    rows = logs.frequency(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.idx, r.frq) for r in rows] == [(0, 60.01), (1, -5.0), (2, 123.5)]
    assert logs.frequency(spark, str(tmp_path), keep_unparsable=True).count() == 5
    (d,) = logs.device_catalog(logs.files(spark, str(tmp_path))).collect()
    assert d.device == "Dev1" and list(d.hours) == ["Hr03"]


GPU = "# a comment\n# reading-time gpu-0[mW] gpu-1[mW] gpu-2[mW] gpu-3[mW] gpu-0[C] gpu-1[C] gpu-2[C] gpu-3[C]\n"


def test_nvml(spark, tmp_path):
    line = lambda i, w: f"2025-01-01_00:00:{i * 0.2:09.6f} {w} 1000 1000 1000 50 51 52 53\n"
    (tmp_path / "nvml_wattameter_x3115c0s33b0n0.log").write_text(GPU + line(0, 800000) + line(1, 800100) + "short row\n" + line(2, "oops") + "\n" + line(3, 70000))
    rows = logs.nvml(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r["gpu-0[W]"] for r in rows] == [800.0, 70.0] and rows[0]["gpu-3[C]"] == 53
    assert logs.nvml(spark, str(tmp_path), cap=1).count() == 1
    assert logs.sample_rate(logs.log_rows(spark, str(tmp_path))).first().hz == 5
    (tmp_path / "nvml_bad_x1c0s1b0n0.log").write_text("1 2 3\n" + GPU)
    with pytest.raises(Exception, match="data before a header"):
        logs.nvml(spark, str(tmp_path)).count()


def test_node_frames(spark, tmp_path):
    cpu = "# reading-time " + " ".join(f"cpu-{i}{p}[{u}]" for u in ("uJ", "W") for i in (0, 1) for p in ("", "-core")) + "\n"
    time = lambda i: f"2025-01-01_00:00:{i * 0.2:09.6f}"
    for node in ("x1c0s0b0n0", "x1c0s1b0n0"):
        (tmp_path / f"nvml_{node}.log").write_text(GPU + "".join(f"{time(i)} {1000 * i} 1 1 1 50 51 52 53\n" for i in range(25)))
        (tmp_path / f"rapl_{node}.log").write_text(cpu + "".join(f"{time(i)} {65.4e9 + i * 1e7 if i < 10 else (i - 10) * 1e7} 1 1 1 90 5 91 5\n" for i in range(25)))
    rows = logs.node_frames(spark, str(tmp_path)).orderBy("node_id", "frame").collect()
    assert [(r.node_id, r.frame) for r in rows] == [(n, f) for n in ("x1c0s0b0n0", "x1c0s1b0n0") for f in range(3)]
    assert [r["gpu-0[W]"] for r in rows[:3]] == [4.5, 14.5, 22.0]
    assert rows[1]["cpu-0[uJ]"] == pytest.approx(65.5e9 + 4.5e7) and rows[0]["cpu-0[W]"] == 90


def test_pairs(spark):
    names = ["nvml_wattameter_emissions_parsed_slurmid_10742842_node_x3105c0s41b0n0.log", "rapl_wattameter_emissions_parsed_slurmid_10742842_node_x3105c0s41b0n0.log", "nvml_wattameter_11763012-x3101c0s37b0n0.log", "notes.txt"]
    cat = lambda n: logs.log_catalog(spark.createDataFrame([(f"/d/{x}", x) for x in n], "path string, name string"))
    assert [r.slurm_id for r in logs.slurm_ids(cat(names)).collect()] == ["10742842", "11763012"]
    assert [p[0] for p in logs.pair_logs(cat(names[:2]))] == ["x3105c0s41b0n0"]
    for bad in (names, names[:2] + names[:1], ["notes.txt"]):
        with pytest.raises(ValueError):
            logs.pair_logs(cat(bad))


def test_bus(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, "ENF", "trusted", 0.95, None, "ok")], bus.RECORDS["VerificationResult"])
    other = spark.createDataFrame([("a1", "replay", "ENF", 1.0, 2.0, {"k": "v"})], bus.RECORDS["AttackEvent"])
    bus.append(rows, "VerificationResult", str(tmp_path), "r1")
    bus.append(other, "AttackEvent", str(tmp_path), "r1")
    assert bus.read(spark, str(tmp_path), "r1", "VerificationResult").collect() == rows.collect()
    assert bus.read(spark, str(tmp_path), "r1", "AttackEvent").first().params == {"k": "v"}
    assert bus.read(spark, str(tmp_path), "none", "AttackEvent").count() == 0
    assert bus.placeholder_twin(spark).where(F.col("object") == "rack_00").count() == 3


def test_guarded_stream(spark, tmp_path):
    for k, part in enumerate([[(0, 1.0), (1, 2.0)], [(1, 9.0), (3, 50.0), (2, 1.0)], [(4, 50.5)]]):
        (tmp_path / f"{k}.json").write_text("".join(json.dumps({"node_id": "n", "channel": "c", "idx": i, "value": v}) + "\n" for i, v in part))
        os.utime(tmp_path / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = live.guarded_steps(live.frames(spark, str(tmp_path), "node_id string, channel string, idx long, value double"), 10.0)
    q = stream.writeStream.format("memory").queryName("steps").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r.idx, r.code) for r in spark.table("steps").collect()]
    assert got == [(0, "ok"), (1, "ok"), (1, "REPLAY"), (3, "DISCONTINUITY"), (2, "OUT OF ORDER"), (4, "ok")]
    assert live.frame_due(5.9) == 2
