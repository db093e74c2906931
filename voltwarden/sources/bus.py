"""Records on a bus of JSON lines, combined frames, and tables that runs append to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.status import colour, label

RECORDS = {
    "StateVariable": "name string, value double, unit string, source_object string, timestamp double, workload_class string",
    "PowerSample": "timestamp double, node_id string, power_w double, workload_class string",
    "AnchorRecord": "timestamp double, anchor_type string, signature array<double>, confidence double, source string",
    "VerificationResult": "timestamp double, component_id string, status string, score double, anchor_ref double, reason string",
    "AttackEvent": "attack_id string, attack_class string, target_component string, start_ts double, end_ts double, params map<string,string>",
}


def envelope(df: DataFrame, record: str) -> DataFrame:
    """value: each row as a JSON line with its type."""
    fields = [f.split()[0] for f in RECORDS[record].replace("map<string,string>", "map").split(", ")]
    return df.select(F.to_json(F.struct(F.lit(record).alias("_type"), F.struct(*[F.col(f) for f in fields]).alias("data"))).alias("value"))


def append(df: DataFrame, record: str, folder: str, run_id: str) -> None:
    """Appends to the run's part of the bus; give a run a new id rather than run it twice."""
    envelope(df, record).write.mode("append").text(f"{folder}/run_id={run_id}")


def parse(lines: DataFrame, record: str) -> DataFrame:
    """The rows of one type of record among lines (value)."""
    rows = lines.where(F.get_json_object("value", "$._type") == record)
    return rows.select(F.from_json("value", f"_type string, data struct<{_struct(record)}>").alias("x")).select("x.data.*")


def _struct(record: str) -> str:
    return T._parse_datatype_string(RECORDS[record]).simpleString().removeprefix("struct<").removesuffix(">")


def read(spark: SparkSession, folder: str, run_id: str, record: str) -> DataFrame:
    """A run's records of a type; none where there is no such run."""
    try:
        lines = spark.read.text(f"{folder}/run_id={run_id}")
        lines.schema
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], T._parse_datatype_string(RECORDS[record]))
    return parse(lines, record)


def read_frames(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Wide frames from JSON lines; blank lines are ignored. A schema saves a pass."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_frames(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_by_node(long: DataFrame, path: str) -> None:
    """A folder for each node."""
    long.write.mode("overwrite").partitionBy("node_id").json(path)


def split_by_node(long: DataFrame, enf: DataFrame, folder: str) -> DataFrame:
    """Frames of each node in a folder of its own, node00, node01... in order of the ids, and node_id, short_id, frames.

    long: idx, node_id, channel, value; enf: idx, frq. A line holds index, FRQ and the node's channels that the frame has.
    """
    from ..operators.views import normal_ids

    ids = normal_ids(long)
    rows = long.join(ids, "node_id").join(enf, "idx")
    wide = rows.groupBy(F.col("idx").alias("index"), F.col("frq").alias("FRQ"), "short_id").pivot("channel").agg(F.first("value"))
    wide.write.mode("overwrite").partitionBy("short_id").json(folder)
    return long.groupBy("node_id").agg(F.count_distinct("idx").alias("frames")).join(ids, "node_id").select("node_id", "short_id", "frames")


def write_attack_pair(attacked: DataFrame, folder: str, name: str) -> None:
    """An attack's frames (idx, node_id, channel, value, label; FRQ without a node) as `name`, and with labels as `name`_check.

    Labels are integers: attack for the frame, ENF_attack, and one a node.
    """
    from ..operators.attacks import layer_labels

    named = attacked.withColumn("name", F.concat_ws("_", "node_id", "channel"))
    plain = named.groupBy(F.col("idx").alias("index")).pivot("name").agg(F.first("value"))
    layer = F.when(F.col("layer") == "Global", "attack").otherwise(F.concat("layer", F.lit("_attack")))
    layers = layer_labels(attacked).withColumn("name", layer)
    labels = layers.groupBy(F.col("idx").alias("index")).pivot("name").agg(F.max("truth").cast("int"))
    write_frames(plain, f"{folder}/{name}.jsonl")
    write_frames(plain.join(labels, "index"), f"{folder}/{name}_check.jsonl")


#: The columns of the history of detections.
HISTORY = (
    "timestamp string, scenario_id string, difficulty string, layer string, strict_tp long, strict_fp long, strict_tn long, strict_fn long, "
    "strict_precision double, strict_recall double, strict_f1 double, strict_fpr double, lenient_tp long, lenient_fp long, lenient_tn long, lenient_fn long, "
    "lenient_precision double, lenient_recall double, lenient_f1 double, lenient_fpr double, strict_avg_ttd double, lenient_avg_ttd double, truth_file string, detector_file string"
)


def history_rows(layers: DataFrame, scenario: str, difficulty: str, truth_file: str, detector_file: str, at: str, span: int | None = None) -> DataFrame:
    """HISTORY, a row a layer, of idx, layer, truth, score as scoring.by_layer() gives them.

    Strict counts failed frames as detections, lenient suspect ones too. Ratios have 6 places, mean times to detection 3,
    null where nothing was detected. With `span`, layers are scanned in parts of so many idx.
    """
    from ..operators import scoring

    out = None
    for name, least in (("strict", 1.0), ("lenient", 0.5)):
        hit = F.col("score") >= least
        own = scoring.confusion(layers, ["layer"], F.col("truth") == 1, hit)
        times = scoring.time_to_detection(layers, ["layer"], F.col("truth") == 1, hit, span).groupBy("layer").agg(F.bround(F.avg("ttd"), 3).alias(f"{name}_avg_ttd"))
        ratios = [F.bround(c, 6).alias(f"{name}_{c}") for c in ("precision", "recall", "f1", "fpr")]
        own = own.select("layer", *[F.col(c).alias(f"{name}_{c}") for c in ("tp", "fp", "tn", "fn")], *ratios).join(times, "layer", "left")
        out = own if out is None else out.join(own, "layer")
    said = {"timestamp": at, "scenario_id": scenario, "difficulty": difficulty, "truth_file": truth_file, "detector_file": detector_file}
    out = out.withColumns({k: F.lit(v) for k, v in said.items()})
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(HISTORY).fields])


def append_history(rows: DataFrame, path: str) -> None:
    """Appends rows of HISTORY to CSV files; what is null is blank."""
    rows.select(*[f.name for f in T._parse_datatype_string(HISTORY).fields]).repartition(1).write.mode("append").option("header", True).csv(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).option("header", True).csv(path)


RACK_HISTORY = "rack_id string, sample_index long, captured_at double, frq_hz double, total_power_w double, average_gpu_temp_c double, status string"


def append_rack_history(rows: DataFrame, path: str) -> None:
    """Appends samples of racks; a status that is null is --. rack_id and captured_at must be there."""
    for c in ("rack_id", "captured_at"):
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} is missing"))))
    own = [F.coalesce("status", F.lit("--")).alias("status") if f.name == "status" else F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(RACK_HISTORY).fields]
    rows.select(*own).write.mode("append").parquet(path)


def rack_history(spark: SparkSession, path: str, rack_id: str | None = None, limit: int | None = None) -> DataFrame:
    """The samples, the newest first, of one rack and so many if asked for."""
    rows = spark.read.schema(RACK_HISTORY).parquet(path)
    rows = rows if rack_id is None else rows.where(F.col("rack_id") == rack_id)
    rows = rows.orderBy(F.col("captured_at").desc(), F.col("sample_index").desc())
    return rows if limit is None else rows.limit(limit)


#: Devices of a node in the twin, with the properties that a playback writes.
TWIN = [(f"cpu-{i}", p) for i in range(2) for p in ("power_draw_w", "core_power_w")] + [(f"gpu-{i}", p) for i in range(4) for p in ("power_draw_w", "temp_c")]


def playback(long: DataFrame, enf: DataFrame, scores: DataFrame, grid: str = "grid_anchor", absent: float = 0.0, nominal: float = 60.0) -> DataFrame:
    """object, property, value, ts, label, colour: what a playback writes to the twin for each frame.

    long: idx, node_id, channel, kind, is_core, value; enf: idx, frq; scores: idx, node_id (ENF for the grid), score. Every
    frame writes every device of every node, `absent` where it has no reading, and the grid, `nominal` where it has no
    frequency. Every device of a node has the node's label and colour; without a score there is none.
    """
    prop = F.when(F.col("kind") == "gpu_temp", "temp_c").when(F.col("is_core"), "core_power_w").otherwise("power_draw_w")
    known = long.where("kind IN ('gpu_power', 'gpu_temp', 'cpu_power')").select("idx", "node_id", F.regexp_replace("channel", r"(-core)?\[.*$", "").alias("device"), prop.alias("property"), "value")
    frames = long.select("idx").unionByName(enf.select("idx")).distinct()
    # one row: the nodes of a facility
    nodes = frames.crossJoin(F.broadcast(long.agg(F.collect_set("node_id").alias("nodes")))).select("idx", F.explode("nodes").alias("node_id"))
    devices = F.explode(F.array(*[F.struct(F.lit(d).alias("device"), F.lit(p).alias("property")) for d, p in TWIN]))
    spine = nodes.withColumn("x", devices).select("idx", "node_id", "x.device", "x.property")
    # readings of devices that a twin usually lacks are written too
    parts = spine.join(known, ["idx", "node_id", "device", "property"], "full_outer").select("idx", "node_id", F.concat_ws("_", "node_id", "device").alias("object"), "property", F.coalesce("value", F.lit(absent)).alias("value"))
    anchor = frames.join(enf, "idx", "left").select("idx", F.lit("ENF").alias("node_id"), F.lit(grid).alias("object"), F.lit("grid_frequency_hz").alias("property"), F.coalesce("frq", F.lit(nominal)).alias("value"))
    both, s = parts.unionByName(anchor).join(scores, ["idx", "node_id"], "left"), F.col("score")
    shown = lambda f: F.when(s.isNotNull(), f(s))
    return both.select("object", "property", "value", (F.col("idx") * 2.0).alias("ts"), shown(label).alias("label"), shown(colour).alias("colour"))


#: Units of the twin's properties.
UNITS = {"power_draw_w": "W", "core_power_w": "W", "temp_c": "C", "grid_frequency_hz": "Hz"}


def append_playback(played: DataFrame, folder: str, run_id: str) -> None:
    """Appends what playback() writes to a run's part of the bus, as StateVariable records."""
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    rows = played.select(F.col("property").alias("name"), "value", units[F.col("property")].alias("unit"), F.col("ts").alias("timestamp"), F.col("object").alias("source_object"), F.lit(None).cast("string").alias("workload_class"))
    append(rows, "StateVariable", folder, run_id)


def placeholder_twin(spark: SparkSession, racks: int = 6) -> DataFrame:
    """object, property, value of a twin without data: racks, power distribution, cooling."""
    rows = [(f"rack_{i:02d}", p, v) for i in range(racks) for p, v in (("power_w", 120.0), ("temp_c", 22.0), ("load_pct", 0.0))]
    rows += [(f"pdu_{i:02d}", "power_w", 400.0) for i in range(max(1, racks // 3))] + [("cooling_00", "temp_c", 18.0)]
    return spark.createDataFrame(rows, "object string, property string, value double")
