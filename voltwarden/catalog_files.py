"""Queries over files: the driver's tables are written as logs, records and histories, and read by the library's sources.

Each has SQL over the tables themselves. `events` gives readings: user_id % 4 the node, event_id the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import _SQL_LONG, _SQL_POLLS, SPAN, SQL_ENF, SQL_FRAMES, _episodes, _long, frames, grid, query, sql_cleaned
from .functions import channels, status
from .operators import align, attacks, calibrate, enf, scoring, views
from .operators.spans import positions
from .sources import bus, logs, scratch

NODES = [f"x1000c0s{i}b0n0" for i in range(4)]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _i() -> Column:
    return F.col("event_id")


def _v() -> Column:
    return F.col("value")


def _text(c: Column) -> Column:
    return c.cast("string")


# Frequency files: a line of metadata, then index and frequency; some rows are blank, cut or not numbers

_SQL_LINES = "lines AS (SELECT 'Dev' || (event_id % 3)::VARCHAR AS device, event_id, CASE WHEN event_id % 53 = 0 THEN 'bad' WHEN event_id % 59 = 0 THEN 'blank' WHEN event_id % 61 = 0 THEN 'cut' ELSE 'good' END AS state, ('59.' || lpad((event_id % 1000)::VARCHAR, 3, '0'))::DOUBLE AS frq FROM events)"


def _frequency_files(spark: SparkSession, sf_dir: str) -> str:
    number = F.concat(F.lit("59."), F.lpad(_text(_i() % 1000), 3, "0"))
    value = F.when(_i() % 53 == 0, F.concat(_text(_i()), F.lit(",bad"))).when(_i() % 59 == 0, "").when(_i() % 61 == 0, _text(_i())).otherwise(F.concat(_text(_i()), F.lit(","), number))
    name = F.concat(F.lit("Dev"), _text(_i() % 3), F.lit("_ENF_Hr00.csv"))
    rows = _events(spark, sf_dir).select(name.alias("name"), _i().alias("place"), value.alias("value"))
    head = spark.createDataFrame([(f"Dev{i}_ENF_Hr00.csv", -1, "UTC: 2025-07-17 08:00:00,Duration: 1 Hour") for i in range(3)], "name string, place long, value string")
    return scratch.put_texts(rows.unionByName(head), scratch.folder(spark, "enf"))


def _device() -> Column:
    return F.regexp_extract("path", r"(Dev\d+)_ENF", 1)


@query(f"WITH {_SQL_LINES} SELECT device, row_number() OVER (PARTITION BY device ORDER BY event_id) - 1 AS idx, frq FROM lines WHERE state = 'good'")
def log_frequency(spark, sf_dir):
    return logs.frequency(spark, _frequency_files(spark, sf_dir)).select(_device().alias("device"), "idx", "frq")


@query(f"WITH {_SQL_LINES} SELECT device, row_number() OVER (PARTITION BY device ORDER BY event_id) - 1 AS idx, CASE WHEN state = 'good' THEN frq ELSE -1 END AS frq FROM lines WHERE state <> 'blank'")
def log_frequency_raw(spark, sf_dir):
    rows = logs.frequency(spark, _frequency_files(spark, sf_dir), keep_unparsable=True)
    return rows.select(_device().alias("device"), "idx", F.nanvl("frq", F.lit(-1.0)).alias("frq"))


@query("SELECT 'Dev' || (c_custkey % 7)::VARCHAR AS device, count(DISTINCT c_custkey % 24) AS n_hours, string_agg(DISTINCT 'Hr' || lpad((c_custkey % 24)::VARCHAR, 2, '0'), ',' ORDER BY 'Hr' || lpad((c_custkey % 24)::VARCHAR, 2, '0')) AS hours FROM customer WHERE c_custkey % 5 <> 0 GROUP BY c_custkey % 7")
def log_devices(spark, sf_dir):
    k = F.col("c_custkey")
    end = F.when(k % 5 == 0, "_notes.txt").otherwise(F.concat(F.lit("_ENF_Hr"), F.lpad(_text(k % 24), 2, "0"), F.lit(".csv")))
    name = F.concat(F.lit("Dev"), _text(k % 7), end)
    listed = spark.read.parquet(f"{sf_dir}/customer.parquet").select(name.alias("name")).distinct()
    found = logs.device_catalog(listed.withColumn("path", F.concat(F.lit("/d/"), "name")))
    return found.select("device", F.size("hours").cast("long").alias("n_hours"), F.array_join(F.map_keys("hours"), ",").alias("hours"))


@query("SELECT event_id::DOUBLE AS timestamp, 'x1000c0s' || (user_id % 4)::VARCHAR || 'b0n0' AS node_id, floor(value * 100) / 4 AS power_w, CASE WHEN event_id % 2 = 0 THEN 'idle' ELSE 'llm_training' END AS workload_class FROM events")
def log_profile(spark, sf_dir):
    path = scratch.folder(spark, "profile")
    node = F.concat(F.lit("x1000c0s"), _text(F.col("user_id") % 4), F.lit("b0n0"))
    rows = _events(spark, sf_dir).select(_i().cast("double").alias("timestamp"), node.alias("node_id"), (F.floor(_v() * 100) / 4).alias("power_w"), F.when(_i() % 2 == 0, "idle").otherwise("llm_training").alias("workload_class"))
    rows.write.option("header", True).csv(path)
    return logs.power_profile(spark, path)


# Names of logs

_SQL_NAMES = """names AS (
SELECT 'nvml_wattameter_emissions_parsed_slurmid_' || (1000000 + c_custkey % 7)::VARCHAR || '_node_x' || c_custkey::VARCHAR || 'c0s1b0n0.log' AS name, c_custkey AS k, 'nvml' AS source FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT 'rapl_wattameter_emissions_parsed_slurmid_' || (1000000 + c_custkey % 7)::VARCHAR || '_node_x' || c_custkey::VARCHAR || 'c0s1b0n0.log', c_custkey, 'rapl' FROM customer WHERE c_custkey % 5 <> 0)"""


def _log_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    both = c.where(k % 3 != 0).withColumn("source", F.lit("nvml")).unionByName(c.where(k % 5 != 0).withColumn("source", F.lit("rapl")))
    name = F.concat("source", F.lit("_wattameter_emissions_parsed_slurmid_"), _text(1000000 + k % 7), F.lit("_node_x"), _text(k), F.lit("c0s1b0n0.log"))
    others = c.where(k % 50 == 0).select(F.concat(F.lit("nvml_x"), _text(k), F.lit("c0s1b0n0.txt")).alias("name"))
    return both.select(name.alias("name")).unionByName(others).withColumn("path", F.concat(F.lit("/d/"), "name"))


@query(f"WITH {_SQL_NAMES} SELECT name, 'x' || k::VARCHAR || 'c0s1b0n0' AS node_id, source, (1000000 + k % 7)::VARCHAR AS slurm_id FROM names")
def log_catalog(spark, sf_dir):
    return logs.log_catalog(_log_names(spark, sf_dir)).select("name", "node_id", "source", "slurm_id")


@query(f"WITH {_SQL_NAMES} SELECT DISTINCT (1000000 + k % 7)::VARCHAR AS slurm_id FROM names")
def log_slurm_ids(spark, sf_dir):
    return logs.slurm_ids(logs.log_catalog(_log_names(spark, sf_dir)))


@query(f"WITH {_SQL_NAMES} SELECT 'x' || k::VARCHAR || 'c0s1b0n0' AS node_id, CASE WHEN max(source) = 'nvml' THEN 'NVML without RAPL' ELSE 'RAPL without NVML' END AS problem FROM names GROUP BY k HAVING count(DISTINCT source) = 1")
def log_orphans(spark, sf_dir):
    return logs.orphans(logs.log_catalog(_log_names(spark, sf_dir)))


# NVML and RAPL logs, at 5 Hz; some rows are short, unreadable or over the ceiling

_SQL_LOGS = """pos AS (SELECT event_id, value, 'x1000c0s' || (user_id % 4)::VARCHAR || 'b0n0' AS node_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS p FROM events),
gpu AS (SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY p) AS pos, floor(value * 5000)::BIGINT * 1e-3 AS gpu0_w, (event_id % 500 * 1000)::BIGINT * 1e-3 AS gpu1_w, (20 + event_id % 60)::DOUBLE AS gpu0_c FROM pos WHERE event_id % 37 <> 0 AND event_id % 41 <> 0 AND floor(value * 5000) <= 800000),
cpu AS (SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY p) AS pos, ((p * 3000000000 + event_id % 1000) % 65500000000)::DOUBLE AS cpu0_uj, floor(value * 4) AS cpu0_w FROM pos WHERE event_id % 43 <> 0 AND floor(value * 4) <= 800)"""


def _logs(spark: SparkSession, sf_dir: str) -> str:
    k = F.col("user_id") % 4
    rows = positions(_events(spark, sf_dir).select("event_id", "value", k.alias("k")), ["k"], "event_id", logs.LINES, "p")
    time = F.date_format(F.timestamp_micros(F.lit(1_750_000_000_000_000) + F.col("p") * 200_000), logs.TIME)
    mw = F.when(_i() % 37 == 0, "oops").otherwise(_text(F.floor(_v() * 5000)))
    gpu = F.concat_ws(" ", time, mw, _text(_i() % 500 * 1000), F.lit("1000 1000"), _text(20 + _i() % 60), F.lit("50 51 52"))
    gpu = F.when(_i() % 41 == 0, F.concat(time, F.lit(" 1 2"))).otherwise(gpu)
    uj = _text((F.col("p") * 3_000_000_000 + _i() % 1000) % 65_500_000_000)
    cpu = F.concat_ws(" ", time, uj, F.lit("5 6 7"), F.when(_i() % 43 == 0, "n/a").otherwise(_text(F.floor(_v() * 4))), F.lit("900 90 5"))
    name = lambda kind: F.concat(F.lit(f"{kind}_wattameter_x1000c0s"), _text(F.col("k")), F.lit("b0n0.log"))
    lines = rows.select(name("nvml").alias("name"), F.col("p").alias("place"), gpu.alias("value")).unionByName(rows.select(name("rapl").alias("name"), F.col("p").alias("place"), cpu.alias("value")))
    gpus = "# reading-time " + " ".join(f"gpu-{i}[{u}]" for u in ("mW", "C") for i in range(4))
    cpus = "# reading-time " + " ".join(f"cpu-{i}{c}[{u}]" for u in ("uJ", "W") for i in (0, 1) for c in ("", "-core"))
    heads = [(f"{kind}_wattameter_{n}.log", place, text) for n in NODES for kind, head in (("nvml", gpus), ("rapl", cpus)) for place, text in ((-2, "# wattameter"), (-1, head))]
    return scratch.put_texts(lines.unionByName(spark.createDataFrame(heads, "name string, place long, value string")), scratch.folder(spark, "logs"))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("node_id", channels.host_of(F.element_at(F.split("path", "/"), -1)))


@query(f"WITH {_SQL_LOGS} SELECT node_id, pos, gpu0_w, gpu1_w, gpu0_c FROM gpu")
def log_nvml(spark, sf_dir):
    rows = _named(logs.nvml(spark, f"{_logs(spark, sf_dir)}/nvml_*"))
    return rows.select("node_id", F.col("pos").cast("long").alias("pos"), F.col("`gpu-0[W]`").alias("gpu0_w"), F.col("`gpu-1[W]`").alias("gpu1_w"), F.col("`gpu-0[C]`").alias("gpu0_c"))


@query(f"WITH {_SQL_LOGS} SELECT node_id, pos, gpu0_w FROM gpu WHERE pos <= 100")
def log_first_rows(spark, sf_dir):
    rows = _named(logs.nvml(spark, f"{_logs(spark, sf_dir)}/nvml_*", cap=100))
    return rows.select("node_id", F.col("pos").cast("long").alias("pos"), F.col("`gpu-0[W]`").alias("gpu0_w"))


@query(f"WITH {_SQL_LOGS} SELECT node_id, pos, cpu0_uj, cpu0_w FROM cpu")
def log_rapl(spark, sf_dir):
    rows = _named(logs.rapl(spark, f"{_logs(spark, sf_dir)}/rapl_*"))
    return rows.select("node_id", F.col("pos").cast("long").alias("pos"), F.col("`cpu-0[uJ]`").alias("cpu0_uj"), F.col("`cpu-0[W]`").alias("cpu0_w"))


@query(f"WITH {_SQL_LOGS} SELECT DISTINCT node_id, 5.0::DOUBLE AS hz FROM pos")
def log_sample_rate(spark, sf_dir):
    rates = logs.sample_rate(logs.log_rows(spark, f"{_logs(spark, sf_dir)}/nvml_*"))
    return _named(rates).select("node_id", F.col("hz").cast("double").alias("hz"))


@query(f"""WITH {_SQL_LOGS}, fell AS (SELECT *, CASE WHEN cpu0_uj < lag(cpu0_uj) OVER (PARTITION BY node_id ORDER BY pos) - 2e9 THEN 1 ELSE 0 END AS f FROM cpu),
un AS (SELECT node_id, pos, cpu0_w, cpu0_uj + 65.5e9 * sum(f) OVER (PARTITION BY node_id ORDER BY pos) AS uj FROM fell),
a AS (SELECT node_id, (pos - 1) // 10 AS frame, avg(gpu0_w) AS gpu0_w, avg(gpu0_c) AS gpu0_c FROM gpu GROUP BY ALL), b AS (SELECT node_id, (pos - 1) // 10 AS frame, avg(cpu0_w) AS cpu0_w, avg(uj) AS uj FROM un GROUP BY ALL)
SELECT node_id, frame, round(gpu0_w, 4) AS gpu0_w, round(gpu0_c, 4) AS gpu0_c, round(cpu0_w, 4) AS cpu0_w, round(uj / 1e6, 2) AS cpu0_j FROM a JOIN b USING (node_id, frame)""")
def log_node_frames(spark, sf_dir):
    rows = logs.node_frames(spark, _logs(spark, sf_dir), most=1 << 40)
    own = {"gpu0_w": "gpu-0[W]", "gpu0_c": "gpu-0[C]", "cpu0_w": "cpu-0[W]"}
    return rows.select("node_id", "frame", *[F.round(F.col(f"`{c}`"), 4).alias(k) for k, c in own.items()], F.round(F.col("`cpu-0[uJ]`") / 1e6, 2).alias("cpu0_j"))


# Combined frames and records

_CHANNELS = {"click": "gpu-0[W]", "view": "gpu-1[W]", "error": "gpu-0[C]", "signup": "cpu-0-core[W]", "purchase": "cpu-0[uJ]"}
_SQL_NAMED = SQL_FRAMES + ", named AS (SELECT idx, node_id, CASE channel WHEN 'click' THEN 'gpu-0[W]' WHEN 'view' THEN 'gpu-1[W]' WHEN 'error' THEN 'gpu-0[C]' WHEN 'signup' THEN 'cpu-0-core[W]' ELSE 'cpu-0[uJ]' END AS channel, round(value, 4) AS value FROM frames)"


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in _CHANNELS.items() for x in kv])
    return frames(spark, sf_dir).select("idx", "node_id", names[F.col("channel")].alias("channel"), F.round("value", 4).alias("value"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.to_wide(_channels(spark, sf_dir), [f"{n}_{c}" for n in NODES for c in _CHANNELS.values()])


def _frq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("idx").distinct().withColumn("frq", 59 + F.col("idx") % 100 / 50.0)


_SQL_FRQ = "f AS (SELECT DISTINCT idx, 59 + idx % 100 / 50.0 AS frq FROM frames)"


@query(f"WITH {_SQL_NAMED} SELECT idx, node_id, channel, value FROM named")
def bus_frames(spark, sf_dir):
    path = scratch.folder(spark, "frames")
    wide = _wide(spark, sf_dir)
    bus.write_frames(wide, path)
    return channels.to_long(bus.read_frames(spark, path, wide.schema)).select("idx", "node_id", "channel", "value")


@query(f"WITH {_SQL_NAMED}, {_SQL_FRQ}, s AS (SELECT node_id, 'node0' || (row_number() OVER (ORDER BY node_id) - 1)::VARCHAR AS short_id FROM (SELECT DISTINCT node_id FROM named)) SELECT short_id, idx, frq, n.channel, n.value FROM named n JOIN s USING (node_id) JOIN f USING (idx)")
def split_nodes(spark, sf_dir):
    path = scratch.folder(spark, "split")
    bus.split_by_node(_channels(spark, sf_dir), _frq(spark, sf_dir), path)
    schema = "index long, FRQ double, short_id string, " + ", ".join(f"`{c}` double" for c in _CHANNELS.values())
    rows = spark.read.schema(schema).json(path)
    long = rows.unpivot(["short_id", "index", "FRQ"], [F.col(f"`{c}`") for c in _CHANNELS.values()], "channel", "value").where("value IS NOT NULL")
    return long.select("short_id", F.col("index").alias("idx"), F.col("FRQ").alias("frq"), "channel", "value")


@query(f"WITH {SQL_FRAMES} SELECT node_id, 'node0' || (row_number() OVER (ORDER BY node_id) - 1)::VARCHAR AS short_id, count(DISTINCT idx) AS frames FROM frames GROUP BY node_id")
def split_counts(spark, sf_dir):
    return bus.split_by_node(_channels(spark, sf_dir), _frq(spark, sf_dir), scratch.folder(spark, "split"))


@query(f"WITH {_SQL_NAMED}, {_SQL_FRQ} SELECT idx, node_id, channel, n.value, frq FROM named n JOIN f USING (idx)")
def enf_by_node(spark, sf_dir):
    return align.combined(_frq(spark, sf_dir), _channels(spark, sf_dir)).select("idx", "node_id", "channel", "value", "frq")


@query(f"WITH {_SQL_NAMED}, s AS (SELECT node_id, 'node0' || (row_number() OVER (ORDER BY node_id) - 1)::VARCHAR AS short_id FROM (SELECT DISTINCT node_id FROM named)), c AS (SELECT idx, short_id || '_' || channel AS name, value FROM named JOIN s USING (node_id) UNION ALL SELECT idx, short_id || '_status', max(CASE WHEN value > 120 THEN 1.0 ELSE 0.0 END)::DOUBLE FROM named JOIN s USING (node_id) GROUP BY ALL) SELECT * FROM c")
def short_columns(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    state = _channels(spark, sf_dir).groupBy(F.col("idx").alias("index")).pivot("node_id", NODES).agg(F.max(F.when(F.col("value") > 120, 1.0).otherwise(0.0)))
    wide = wide.join(state.withColumnsRenamed({n: f"{n}_status" for n in NODES}), "index")
    short = {n: f"node{i:02d}" for i, n in enumerate(channels.nodes_of(wide.columns))}
    out = channels.renamed_columns(wide, short)
    return out.unpivot([F.col("index").alias("idx")], [F.col(f"`{c}`").cast("double").alias(c) for c in out.columns if c != "index"], "name", "value").where("value IS NOT NULL").withColumnRenamed("index", "idx")


@query(f"""WITH {_SQL_NAMED}, g AS (SELECT 'gpus' AS name, count(*) FILTER (channel LIKE 'gpu%') AS n FROM named UNION ALL SELECT 'gpu_watts', count(*) FILTER (channel LIKE 'gpu%[W]') FROM named
UNION ALL SELECT 'gpu_temps', count(*) FILTER (channel LIKE 'gpu%[C]') FROM named UNION ALL SELECT 'cpus', count(*) FILTER (channel LIKE 'cpu%') FROM named UNION ALL SELECT 'all', count(*) FROM named UNION ALL SELECT node_id, count(*) FROM named GROUP BY node_id) SELECT name, n FROM g""")
def target_groups(spark, sf_dir):
    """How many readings each group of targets would change."""
    wide = _wide(spark, sf_dir)
    groups = channels.target_groups(wide.columns)
    counts = [F.sum(sum((F.col(f"`{c}`").isNotNull().cast("long") for c in own), F.lit(0).cast("long"))).alias(k) for k, own in groups.items() if k != "frq"]
    row = wide.agg(*counts)
    return row.unpivot([], [F.col(f"`{c}`") for c in row.columns], "name", "n")


@query("SELECT 'x1000c0s' || k::VARCHAR || 'b0n0' AS node_id, 'x1000c0s' || k::VARCHAR || 'b0n0' IN (SELECT DISTINCT 'x1000c0s' || (user_id % 4)::VARCHAR || 'b0n0' FROM events) AS found FROM (SELECT unnest([1, 3, 7]) AS k)")
def requested_nodes(spark, sf_dir):
    return views.requested(frames(spark, sf_dir), ["x1000c0s7b0n0", "x1000c0s1b0n0", "x1000c0s3b0n0", "x1000c0s1b0n0"])


@query("SELECT DISTINCT 'x1000c0s' || (user_id % 4)::VARCHAR || 'b0n0' AS node_id, TRUE AS found FROM events ORDER BY node_id LIMIT 2")
def first_nodes(spark, sf_dir):
    return views.requested(frames(spark, sf_dir), count=2)


# Results on the bus, joined to samples

_SQL_RESULTS = "results AS (SELECT floor(event_id / 10) + (event_id % 4) / 4.0 AS timestamp, 'run1/' || CASE WHEN event_id % 9 = 0 THEN 'ENF' ELSE 'x1000c0s' || (user_id % 4)::VARCHAR || 'b0n0_' || event_type END AS component_id, CASE WHEN value > 120 THEN 'failed' WHEN value > 80 THEN 'suspect' ELSE 'trusted' END AS status, round(1 / (1 + abs(value)), 4) AS score, 'r' || (event_id % 5)::VARCHAR AS reason FROM events)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(_i() % 9 == 0, "ENF").otherwise(F.concat(F.lit("x1000c0s"), _text(F.col("user_id") % 4), F.lit("b0n0_"), "event_type"))
    state = F.when(_v() > 120, "failed").when(_v() > 80, "suspect").otherwise("trusted")
    return _events(spark, sf_dir).select((F.floor(_i() / 10) + _i() % 4 / 4.0).alias("timestamp"), F.concat(F.lit("run1/"), part).alias("component_id"), state.alias("status"), F.round(1 / (1 + F.abs(_v())), 4).alias("score"), F.lit(None).cast("double").alias("anchor_ref"), F.concat(F.lit("r"), _text(_i() % 5)).alias("reason"))


@query(f"WITH {_SQL_RESULTS} SELECT floor(timestamp)::BIGINT AS sample, count(*) AS n, min(component_id) AS first FROM results GROUP BY 1")
def verification_index(spark, sf_dir):
    path = scratch.folder(spark, "bus")
    bus.append(_results(spark, sf_dir), "VerificationResult", path, "run1")
    found = views.by_sample(bus.read(spark, path, "run1", "VerificationResult"))
    return found.select("sample", F.size("records").cast("long").alias("n"), F.col("records")[0]["component_id"].alias("first"))


@query(f"""WITH {_SQL_RESULTS}, w AS (SELECT DISTINCT floor(event_id / 10)::BIGINT + CASE WHEN event_id % 30 = 0 THEN 1000000000 ELSE 0 END AS sample, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'x1000c0s' || (event_id % 3)::VARCHAR || 'b0n0' END AS node_id FROM events),
r AS (SELECT floor(timestamp)::BIGINT AS sample, component_id, substr(component_id, 6) AS part, CASE status WHEN 'failed' THEN 2 WHEN 'suspect' THEN 1 ELSE 0 END AS rank, score, reason FROM results),
b AS (SELECT w.sample, w.node_id, r.part, r.rank, r.score, r.reason, max(r.rank) OVER (PARTITION BY w.sample, w.node_id) AS worst FROM w JOIN r ON w.sample = r.sample AND (w.node_id IS NULL OR part = 'ENF' OR starts_with(part, w.node_id || '_'))),
a AS (SELECT sample, node_id, max(worst) AS worst, min(score) FILTER (rank = worst) AS score, string_agg(part || ':' || reason, ',' ORDER BY part, reason) FILTER (rank > 0) AS reasons FROM b GROUP BY ALL)
SELECT w.sample, w.node_id, CASE worst WHEN 2 THEN 'warning' WHEN 1 THEN 'suspect' WHEN 0 THEN 'good' ELSE '--' END AS label, round(CASE WHEN worst = 0 THEN least(score, 1.0) ELSE score END, 4) AS score, coalesce(reasons, '') AS reasons FROM w LEFT JOIN a ON a.sample = w.sample AND a.node_id IS NOT DISTINCT FROM w.node_id""")
def sample_verdicts(spark, sf_dir):
    sample = F.floor(_i() / 10) + F.when(_i() % 30 == 0, 1_000_000_000).otherwise(0)
    wanted = _events(spark, sf_dir).select(sample.cast("long").alias("sample"), F.when(_i() % 3 != 0, F.concat(F.lit("x1000c0s"), _text(_i() % 3), F.lit("b0n0"))).alias("node_id")).distinct()
    out = views.verified_samples(wanted, _results(spark, sf_dir))
    told = F.array_join(F.transform("reasons", lambda x: F.concat_ws(":", x["part"], x["reason"])), ",")
    return out.select("sample", "node_id", "label", "score", told.alias("reasons"))


# Histories

_SQL_LAYERED = SQL_FRAMES + ", l AS (SELECT idx, node_id AS layer, max((idx % 50 BETWEEN 5 AND 19)::INT) AS truth, max(CASE WHEN value > 120 THEN 1.0 WHEN value > 80 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score FROM frames GROUP BY ALL)"


def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return frames(spark, sf_dir).groupBy("idx", F.col("node_id").alias("layer")).agg(F.max(F.col("idx").try_cast("long") % 50).alias("m"), F.max(F.when(v > 120, 1.0).when(v > 80, 0.5).otherwise(0.0)).alias("score")).select("idx", "layer", F.col("m").between(5, 19).cast("int").alias("truth"), "score")


def _sql_metrics(name: str, least: float) -> str:
    return f"""{name} AS (SELECT layer, tp, fp, tn, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS p, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS r, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS x, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f FROM (
SELECT layer, (count(*) FILTER (truth = 1 AND score >= {least}))::DOUBLE AS tp, (count(*) FILTER (truth = 0 AND score >= {least}))::DOUBLE AS fp, (count(*) FILTER (truth = 0 AND score < {least}))::DOUBLE AS tn, (count(*) FILTER (truth = 1 AND score < {least}))::DOUBLE AS fn FROM l GROUP BY layer))"""


@query(f"""WITH {_SQL_LAYERED}, {_sql_metrics('s', 1.0)}, {_sql_metrics('t', 0.5)} SELECT s.layer, s.tp::BIGINT AS strict_tp, s.fp::BIGINT AS strict_fp, s.tn::BIGINT AS strict_tn, s.fn::BIGINT AS strict_fn, s.p AS strict_precision, s.r AS strict_recall, s.f AS strict_f1, s.x AS strict_fpr, t.tp::BIGINT AS lenient_tp, t.fn::BIGINT AS lenient_fn, t.p AS lenient_precision, t.r AS lenient_recall, 'drift' AS scenario_id, 'truth.jsonl' AS truth_file FROM s JOIN t USING (layer)""")
def detection_history(spark, sf_dir):
    path = scratch.folder(spark, "history")
    rows = bus.history_rows(_layered(spark, sf_dir), "drift", "easy", "truth.jsonl", "detector.jsonl", "2025-07-17T08:00:00", SPAN)
    bus.append_history(rows, path)
    strict = [f"strict_{c}" for c in ("tp", "fp", "tn", "fn", "precision", "recall", "f1", "fpr")]
    return bus.read_history(spark, path).select("layer", *strict, "lenient_tp", "lenient_fn", "lenient_precision", "lenient_recall", "scenario_id", "truth_file")


@query(f"WITH {SQL_FRAMES}, t AS (SELECT node_id AS rack_id, idx AS sample_index, idx * 2.0 AS captured_at, round(max(value), 4) AS total_power_w, CASE WHEN max(value) > 120 THEN 'warning' ELSE '--' END AS status FROM frames GROUP BY node_id, idx), k AS (SELECT *, row_number() OVER (PARTITION BY rack_id ORDER BY captured_at DESC) AS place FROM t) SELECT rack_id, sample_index, captured_at, total_power_w, status FROM k WHERE place <= 20")
def rack_history(spark, sf_dir):
    path = scratch.folder(spark, "racks")
    rows = frames(spark, sf_dir).groupBy(F.col("node_id").alias("rack_id"), F.col("idx").alias("sample_index")).agg(F.round(F.max("value"), 4).alias("total_power_w"), F.when(F.max("value") > 120, "warning").alias("status"))
    rows = rows.select("*", (F.col("sample_index") * 2.0).alias("captured_at"), F.lit(60.0).alias("frq_hz"), F.lit(None).cast("double").alias("average_gpu_temp_c"))
    for half in (0, 1):  # two inserts
        bus.append_rack_history(rows.where(F.col("sample_index") % 2 == half), path)
    return views.newest(bus.rack_history(spark, path), ["rack_id"], 20, "captured_at").select("rack_id", "sample_index", "captured_at", "total_power_w", "status")


# Attacks as files


@query(f"WITH {_SQL_NAMED}, h AS (SELECT *, (channel LIKE 'gpu%' AND idx >= 50 AND idx < 100) AS hit FROM named), v AS (SELECT idx, node_id, channel, CASE WHEN hit THEN round_even(value + 25.0, 4) ELSE value END AS value, max(hit::INT) OVER (PARTITION BY idx) AS attack, max(hit::INT) OVER (PARTITION BY idx, node_id) AS own FROM h) SELECT idx, node_id, channel, round(value, 4) AS value, attack, own FROM v")
def attack_files(spark, sf_dir):
    path = scratch.folder(spark, "attack")
    cells = _channels(spark, sf_dir)
    cells = cells.withColumn("target", channels.target_group(F.concat_ws("_", "node_id", "channel"), "gpus"))
    bus.write_attack_pair(attacks.output(attacks.inject(cells, 50, 100, "bias", 25.0)), path, "bias")
    names = _wide(spark, sf_dir).columns[1:]
    plain = bus.read_frames(spark, f"{path}/bias.jsonl", _schema(names))
    check = bus.read_frames(spark, f"{path}/bias_check.jsonl", _schema(names, ["attack", *[f"{n}_attack" for n in NODES]]))
    label = F.create_map(*[x for n in NODES for x in (F.lit(n), F.col(f"{n}_attack"))])
    labels = check.select(F.col("index").alias("idx"), "attack", label.alias("own"))
    return channels.to_long(plain).join(labels, "idx").select("idx", "node_id", "channel", F.round("value", 4).alias("value"), "attack", F.col("own")[F.col("node_id")].alias("own"))


def _schema(values: list[str], labels: list[str] = []) -> str:
    return ", ".join(["index long", *[f"`{n}` double" for n in values], *[f"`{n}` int" for n in labels]])


@query(f"WITH {_SQL_NAMED} SELECT idx, node_id, channel, value AS attacked, 0 AS label FROM named")
def attack_none(spark, sf_dir):
    return attacks.none(_channels(spark, sf_dir)).select("idx", "node_id", "channel", "attacked", "label")


def _preset(which: str, target: str, change: str, lo: float, hi: float, hit: str = "TRUE") -> str:
    return f"WITH {_SQL_NAMED}, m AS (SELECT max(idx) + 1 AS n FROM named), h AS (SELECT named.*, floor(n * {lo})::BIGINT AS lo, floor(n * {hi})::BIGINT AS hi FROM named, m), g AS (SELECT *, {target} AND idx >= lo AND idx < hi AND {hit} AS hit FROM h) SELECT idx, node_id, channel, round(CASE WHEN hit THEN {change} ELSE value END, 6) AS attacked, hit::INT AS label FROM g"


def _scenario(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    cells = _channels(spark, sf_dir)
    n = cells.agg(F.max("idx")).first()[0] + 1
    out = attacks.scenario(cells, ["node_id", "channel"], F.concat_ws("_", "node_id", "channel"), n, which)
    return out.select("idx", "node_id", "channel", F.round("attacked", 6).alias("attacked"), "label")


@query(_preset("201", "channel LIKE 'gpu%'", "value + 25.0", 0.30, 0.70))
def scenario_201(spark, sf_dir):
    return _scenario(spark, sf_dir, "201")


@query(_preset("203", "channel LIKE 'cpu%'", "value * 1.15", 0.15, 0.85))
def scenario_203(spark, sf_dir):
    return _scenario(spark, sf_dir, "203")


@query(_preset("301", "channel LIKE 'cpu%'", "value + 0.02 * ((idx - lo) / greatest(1, hi - lo))", 0.10, 0.90))
def scenario_301(spark, sf_dir):
    return _scenario(spark, sf_dir, "301")


@query(f"""WITH {_SQL_NAMED}, m AS (SELECT max(idx) + 1 AS n FROM named), h AS (SELECT named.*, floor(n * 0.4)::BIGINT AS lo, floor(n * 0.6)::BIGINT AS hi, floor(n * 0.02)::BIGINT AS first, floor(n * 0.22)::BIGINT - floor(n * 0.02)::BIGINT AS len FROM named, m)
SELECT a.idx, a.node_id, a.channel, round(coalesce(b.value, a.value), 6) AS attacked, (b.value IS NOT NULL)::INT AS label FROM h a LEFT JOIN named b ON a.node_id = b.node_id AND a.channel = b.channel AND a.idx >= a.lo AND a.idx < a.hi AND b.idx = a.first + (a.idx - a.lo) % greatest(1, a.len)""")
def scenario_305(spark, sf_dir):
    return _scenario(spark, sf_dir, "305")


@query(f"""WITH {_SQL_NAMED}, m AS (SELECT max(idx) + 1 AS n FROM named), h AS (SELECT named.*, floor(n * 0.2::DOUBLE)::BIGINT AS lo, floor(n * 0.8::DOUBLE)::BIGINT AS hi, floor(n * 0.01::DOUBLE)::BIGINT AS first, floor(n * (0.01::DOUBLE + 0.05::DOUBLE))::BIGINT - floor(n * 0.01::DOUBLE)::BIGINT AS len FROM named, m)
SELECT a.idx, a.node_id, a.channel, round(coalesce(b.value, a.value), 6) AS attacked, (b.value IS NOT NULL)::INT AS label FROM h a LEFT JOIN named b ON a.node_id = b.node_id AND a.channel = b.channel AND a.channel LIKE 'gpu%[W]' AND a.value > 450 AND a.idx >= a.lo AND a.idx < a.hi AND b.idx = a.first + (a.idx - a.lo) % greatest(1, a.len)""")
def scenario_303(spark, sf_dir):
    """Values over 450 of GPU power alone are replaced by earlier ones; few tables have any."""
    return _scenario(spark, sf_dir, "303")


def _easy(spark: SparkSession, sf_dir: str, mode: int, group: str, params: dict | None = None) -> DataFrame:
    cells = _channels(spark, sf_dir)
    n = cells.agg(F.max("idx")).first()[0] + 1
    out = attacks.easy(cells, ["node_id", "channel"], F.concat_ws("_", "node_id", "channel"), n, mode, group, params)
    return out.select("idx", "node_id", "channel", F.round("attacked", 6).alias("attacked"), "label")


@query(_preset("1", "channel LIKE 'gpu%[W]'", "0.0", 0.10, 0.60))
def easy_extreme(spark, sf_dir):
    return _easy(spark, sf_dir, 1, "gpu_watts")


@query(f"""WITH {_SQL_NAMED}, m AS (SELECT max(idx) + 1 AS n FROM named), h AS (SELECT named.*, floor(n * 0.1)::BIGINT AS lo, floor(n * 0.6)::BIGINT AS hi, floor(n * 0.01)::BIGINT AS first, floor(n * (0.01 + 0.05))::BIGINT - floor(n * 0.01)::BIGINT AS len FROM named, m)
SELECT a.idx, a.node_id, a.channel, round(coalesce(b.value, a.value), 6) AS attacked, (b.value IS NOT NULL)::INT AS label FROM h a LEFT JOIN named b ON a.node_id = b.node_id AND a.channel = b.channel AND a.idx >= a.lo AND a.idx < a.hi AND b.idx = a.first + (a.idx - a.lo) % greatest(1, a.len)""")
def easy_replay(spark, sf_dir):
    return _easy(spark, sf_dir, 2, "all")


@query(_preset("3", "channel LIKE 'gpu%'", "value * 1.05", 0.10, 0.60))
def easy_scale(spark, sf_dir):
    """The injection mode with its other kind."""
    return _easy(spark, sf_dir, 3, "gpus", {"type": "scale", "value": 1.05})


@query(_preset("4", "channel LIKE 'cpu%'", "value + 50.0 * ((idx - lo) / greatest(1, hi - lo))", 0.10, 0.60))
def easy_drift(spark, sf_dir):
    return _easy(spark, sf_dir, 4, "cpus")


# Scoring and views


@query(f"WITH {_SQL_LAYERED} SELECT idx, max(truth) AS truth, max(score) AS score FROM l GROUP BY idx")
def scoring_aligned(spark, sf_dir):
    rows = _layered(spark, sf_dir)
    both = scoring.aligned(rows.groupBy("idx").agg(F.max("truth").alias("truth")), rows.groupBy("idx").agg(F.max("score").alias("score")))
    return scoring.without_labels(both.select("idx", "truth", "score"))


@query(f"WITH {SQL_FRAMES} SELECT idx, round(min(value), 4) AS frq, 'ENF' AS node_id FROM frames GROUP BY idx")
def facility_rows(spark, sf_dir):
    return views.facility_entry(frames(spark, sf_dir).withColumn("frq", F.round("value", 4)))


@query(f"WITH {_SQL_POLLS} SELECT node_id, severity, start_ts, end_ts, ongoing FROM episodes")
def episodes_all(spark, sf_dir):
    own = _episodes(spark, sf_dir)
    both = views.all_episodes(own.where("NOT ongoing").drop("ongoing"), own.where("ongoing").drop("ongoing"))
    return both.select("node_id", "severity", "start_ts", "end_ts", "ongoing")


@query(f"""WITH {_SQL_POLLS}, o AS (SELECT *, max(end_ts) OVER (PARTITION BY severity ORDER BY start_ts, end_ts, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM episodes),
g AS (SELECT *, sum(CASE WHEN start_ts - latest <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY severity ORDER BY start_ts, end_ts, node_id) AS grp FROM o), i AS (SELECT severity, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(DISTINCT node_id) AS nodes FROM g GROUP BY severity, grp)
SELECT row_number() OVER (ORDER BY end_ts DESC, start_ts DESC, severity) AS place, severity, start_ts, end_ts, nodes FROM i""")
def incident_order(spark, sf_dir):
    listed = views.latest_first(views.incidents(_episodes(spark, sf_dir), 5.0, ["severity"]))
    place = F.row_number().over(Window.orderBy(F.col("end_ts").desc(), F.col("start_ts").desc(), "severity"))
    return listed.select(place.cast("long").alias("place"), "severity", "start_ts", "end_ts", "nodes")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Warning' WHEN 2 THEN 'Alert' END AS title, CASE event_id % 4 WHEN 0 THEN 'NOM' WHEN 1 THEN 'WRN' WHEN 2 THEN 'ALR' END AS badge, CASE event_id % 4 WHEN 0 THEN '#16a34a' WHEN 1 THEN '#ca8a04' WHEN 2 THEN '#dc2626' END AS border FROM events")
def status_tiles(spark, sf_dir):
    score = F.when(_i() % 4 != 3, _i() % 4 / 2.0)
    return _events(spark, sf_dir).select("event_id", status.tile(status.label(score)).alias("t")).select("event_id", "t.title", "t.badge", "t.border")


@query("SELECT o_orderkey, 'sc' || (o_orderkey % 40)::VARCHAR || CASE WHEN o_orderkey % 3 = 0 THEN '_Easy' ELSE '' END AS scenario, CASE WHEN o_orderkey % 3 = 0 THEN 'easy' ELSE 'unknown' END AS difficulty, CASE WHEN o_orderkey % 2 = 0 THEN 'training' ELSE 'inference' END AS workload, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 100 END AS folder FROM orders")
def file_facts(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("/out/sc"), _text(k % 40), F.when(k % 3 == 0, "_Easy").otherwise(""), F.when(k % 2 == 0, "_check").otherwise(""), F.lit(".jsonl"))
    data = F.when(k % 2 == 0, "NLR_Training_16").otherwise("NLR_infer_1")
    folder = F.when(k % 5 == 0, "latest").otherwise(F.concat(F.lit("run "), _text(k % 100)))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("scenario", status.scenario_of(name))
    return o.select("o_orderkey", "scenario", status.difficulty_of(F.col("scenario")).alias("difficulty"), status.workload_of(data).alias("workload"), status.folder_number(folder).cast("long").alias("folder"))


@query(f"""WITH {SQL_ENF}, e AS (SELECT run_id, idx, frq, idx BETWEEN 800 AND 899 AS win, abs(frq - lag(frq) OVER (PARTITION BY run_id ORDER BY idx)) AS step FROM (SELECT run_id, idx, 60 + (frq - 60) * 12 AS frq FROM enf)),
v AS (SELECT run_id, round(frq, 4) AS v, count(*) AS c FROM e WHERE win GROUP BY ALL), s AS (SELECT run_id, max(c) AS c FROM v GROUP BY run_id),
a AS (SELECT run_id, count(*) FILTER (win) AS n, count(*) FILTER (win AND step > 1 AND idx <> 800) AS jumps, stddev_samp(frq) FILTER (win) AS w, stddev_samp(frq) FILTER (NOT win) AS b FROM e GROUP BY run_id)
SELECT run_id, round(c / n::DOUBLE, 6) AS repeated, jumps, round(w / b, 6) AS ratio, c / n::DOUBLE > 0.10 AS stuck, jumps BETWEEN 1 AND 3 AS shifted, w / b > 3 AS noisy FROM a JOIN s USING (run_id)""")
def glitch_conclusions(spark, sf_dir):
    wide = grid(spark, sf_dir).select("run_id", "idx", (60 + (F.col("frq") - 60) * 12).alias("frq"))
    out = calibrate.diagnosis(calibrate.stretch(wide, 800, 899))
    return out.select("run_id", F.round("repeated", 6).alias("repeated"), "jumps", F.round("ratio", 6).alias("ratio"), "stuck", "shifted", "noisy")


@query(f"""WITH {_SQL_LONG}, d AS (SELECT * FROM (VALUES ('cpu-0', 'power_draw_w'), ('cpu-0', 'core_power_w'), ('cpu-1', 'power_draw_w'), ('cpu-1', 'core_power_w'), ('gpu-0', 'power_draw_w'), ('gpu-0', 'temp_c'), ('gpu-1', 'power_draw_w'), ('gpu-1', 'temp_c'), ('gpu-2', 'power_draw_w'), ('gpu-2', 'temp_c'), ('gpu-3', 'power_draw_w'), ('gpu-3', 'temp_c')) AS t(device, property)),
f AS (SELECT DISTINCT idx FROM long), n AS (SELECT DISTINCT node_id FROM long),
k AS (SELECT idx, node_id, CASE WHEN kind LIKE 'gpu%' THEN 'gpu-' ELSE 'cpu-' END || ordinal::VARCHAR AS device, CASE WHEN kind = 'gpu_temp' THEN 'temp_c' WHEN is_core THEN 'core_power_w' ELSE 'power_draw_w' END AS property, round(value, 4) AS value FROM long),
p AS (SELECT idx, node_id || '_' || device AS object, property, coalesce(value, 0.0) AS value, TRUE AS node FROM f CROSS JOIN n CROSS JOIN d LEFT JOIN k USING (idx, node_id, device, property)
 UNION ALL SELECT idx, 'grid_anchor', 'grid_frequency_hz', CASE WHEN idx % 6 = 2 THEN 60.0 ELSE 59 + idx % 100 / 50.0 END, FALSE FROM f)
SELECT object, property, value, idx * 2.0 AS ts, CASE WHEN NOT node OR idx % 5 = 4 THEN NULL WHEN idx % 5 = 0 THEN 'good' WHEN idx % 5 = 1 THEN 'suspect' ELSE 'warning' END AS label, CASE WHEN NOT node OR idx % 5 = 4 THEN NULL WHEN idx % 5 = 0 THEN 'green' WHEN idx % 5 = 1 THEN 'yellow' ELSE 'red' END AS colour FROM p""")
def twin_playback(spark, sf_dir):
    """A playback of frames of which some lack devices or the frequency, appended to the bus and read back."""
    unit = F.when(F.col("kind") == "gpu_temp", "[C]").otherwise("[W]")
    device = F.concat_ws("-", F.split_part("kind", F.lit("_"), F.lit(1)), _text(F.col("ordinal")))
    long = _long(spark, sf_dir).withColumn("channel", F.concat(device, F.when(F.col("is_core"), "-core").otherwise(""), unit))
    score = F.when(F.col("idx") % 5 == 0, 0.0).when(F.col("idx") % 5 == 1, 0.5).otherwise(1.0)
    scores = long.where("idx % 5 <> 4").select("idx").distinct().withColumn("node_id", F.explode(F.array(*map(F.lit, NODES)))).withColumn("score", score)
    out = bus.playback(long, _frq(spark, sf_dir).where("idx % 6 <> 2"), scores).withColumn("value", F.round("value", 4))
    path = scratch.folder(spark, "playback")
    bus.append_playback(out, path, "run")
    again = bus.read(spark, path, "run", "StateVariable")
    shown = out.select(F.col("object").alias("source_object"), F.col("ts").alias("timestamp"), F.col("property").alias("name"), "label", "colour")
    both = again.join(shown, ["source_object", "timestamp", "name"])
    return both.select(F.col("source_object").alias("object"), F.col("name").alias("property"), "value", F.col("timestamp").alias("ts"), "label", "colour")


# Streams, run to their end


@query(f"WITH {_SQL_NAMED} SELECT idx, node_id, channel, value, CASE WHEN value < 0 OR value > 150 THEN 'OUT OF RANGE' ELSE 'ok' END AS code FROM named")
def stream_fork(spark, sf_dir):
    """Frames as a stream, forked to a copy and to a check; what the check says is read back."""
    from .operators.nlr import value_range
    from .streaming import live

    path = scratch.folder(spark, "stream")
    _channels(spark, sf_dir).write.json(f"{path}/in")
    stream = live.frames(spark, f"{path}/in", "idx long, node_id string, channel string, value double")

    def copy(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/copy/batch={i}")

    def check(batch: DataFrame, i: int) -> None:
        value_range(batch, 0, 150).write.mode("overwrite").parquet(f"{path}/results/batch={i}")

    live.fork(stream, f"{path}/state", copy, check).trigger(availableNow=True).start().awaitTermination()
    results = spark.read.parquet(f"{path}/results").drop("batch")
    return results.join(spark.read.parquet(f"{path}/copy").drop("batch").select("idx", "node_id", "channel"), ["idx", "node_id", "channel"]).select("idx", "node_id", "channel", "value", "code")


_FOLD = "WITH RECURSIVE"


@query(f"""{_FOLD} {SQL_ENF}, e AS (SELECT run_id, idx, frq, (idx * 31 % 11 - 5) / 1000.0 AS noise FROM enf WHERE idx >= 199 AND idx < 400), f AS (
SELECT run_id, idx, NULL::DOUBLE AS last FROM e WHERE idx = 199
UNION ALL SELECT e.run_id, e.idx, e.frq + least(0.01, greatest(-0.01, 0.95 * (coalesce(f.last, e.frq) - e.frq) + e.noise)) + 0.06 * ((e.idx - 200) / 200.0) FROM f JOIN e ON e.run_id = f.run_id AND e.idx = f.idx + 1)
SELECT n.run_id, n.idx, round(coalesce(f.last, n.frq), 9) AS attacked, (f.last IS NOT NULL)::INT AS label FROM enf n LEFT JOIN f ON f.run_id = n.run_id AND f.idx = n.idx AND f.last IS NOT NULL""")
def attack_tracked_drift(spark, sf_dir):
    rows = grid(spark, sf_dir).select("run_id", "idx", "frq", ((F.col("idx") * 31 % 11 - 5) / 1000.0).alias("noise"))
    return attacks.tracked(rows, 200, 400, 0.95, "additive", 0.06).select("run_id", "idx", F.round("attacked", 9).alias("attacked"), "label")


_WILD = {97: 250.0, 101: 35.0, 103: 85.0}


@query(f"WITH RECURSIVE {SQL_ENF}, c AS (SELECT run_id, idx, CASE {' '.join(f'WHEN idx % {k} = 13 THEN {v}' for k, v in _WILD.items())} ELSE frq END AS frq FROM enf), {sql_cleaned('c', 40, 80)}")
def clean_enf(spark, sf_dir):
    """Frequencies with values beyond 40 and 80 Hz and outliers among them, cleaned."""
    wild = F.col("frq")
    for k, v in reversed(_WILD.items()):
        wild = F.when(F.col("idx") % k == 13, v).otherwise(wild)
    rows = grid(spark, sf_dir).select("run_id", "idx", wild.alias("frq"))
    return enf.cleaned(rows).select("run_id", "idx", "flagged", F.round("frq", 6).alias("clean"))
