"""Raw inputs: frequency CSV files, NVML and RAPL logs, and what their names say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.channels import host_of
from ..operators.spans import earlier, positions
from . import scratch

#: Lines of a file that are numbered in one task.
LINES = 1 << 20
TIME = "yyyy-MM-dd_HH:mm:ss.SSSSSS"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, path, part, nth of text files: parts and the lines of each are numbered upwards."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("nth"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line_no, line of text files in file order.

    Files of any size are read in parts: a line's place is the offset of its part and its place in that.
    """
    rows = positions(_lines(spark, path), ["path"], "nth", F.col("part"), "line_no")
    return rows.select("path", "line_no", F.col("value").alias("line"))


def frequency(spark: SparkSession, path: str, keep_unparsable: bool = False) -> DataFrame:
    """path, idx, frq: the second column after one line of metadata; rows that can't be read are left out, or kept as NaN."""
    rows = numbered_lines(spark, path).where("line_no >= 1")
    if keep_unparsable:
        rows = rows.where(F.trim("line") != "")
    value = F.try_element_at(F.split("line", ","), F.lit(2)).try_cast("double")
    rows = rows.select("path", "line_no", "line", (F.coalesce(value, F.lit(float("nan"))) if keep_unparsable else value).alias("frq")).where("frq IS NOT NULL")
    rows = positions(rows, ["path"], "line_no", LINES, "idx")
    return rows.select("path", "idx", "frq", *(["line"] if keep_unparsable else []))


def log_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, cells (map of column name to text) of whitespace-separated logs.

    The header is the latest line that begins with # and holds reading-time; other comments, blank lines and lines
    shorter than the header are left out. Data before any header raises.
    """
    lines = _lines(spark, path).withColumn("line", F.trim("value"))
    is_header = F.col("line").startswith("#") & F.contains("line", F.lit("reading-time"))
    names = F.split(F.trim(F.regexp_replace("line", "^#+", "")), r"\s+")
    one = F.lit(1).cast("long")
    headed = earlier(lines, ["path"], "nth", F.col("part"), sums={"line_no": one}, last={"header": F.when(is_header, names)}).where("line <> '' AND NOT startswith(line, '#')")
    header = F.when(F.col("header").isNull(), F.raise_error(F.concat(F.lit("data before a header in "), F.col("path")))).otherwise(F.col("header"))
    # filters are not moved to before an explode, so a line is taken apart once, and not again for each cell that one asks for
    rows = headed.select("path", "line_no", F.inline(F.array(F.struct(header.alias("header"), F.split("line", r"\s+").alias("parts"))))).where("size(parts) >= size(header)")
    return rows.select("path", "line_no", F.explode(F.array(F.map_from_arrays("header", F.slice("parts", F.lit(1), F.size("header"))))).alias("cells"))


def _cell(name: str, scale: float = 1.0) -> Column:
    return F.col("cells").getItem(name).try_cast("double") * scale


def readings(rows: DataFrame, columns: dict[str, Column], ceilings: list[str], most: float = 800.0, cap: int | None = None) -> DataFrame:
    """path, pos and columns of log_rows(): rows with a cell that can't be read, or with a reading over the ceiling, are left out; at most `cap` kept rows a file."""
    out = rows.select("path", "line_no", F.col("cells").getItem("reading-time").alias("time"), *[c.alias(n) for n, c in columns.items()])
    out = out.where(" AND ".join(f"`{n}` IS NOT NULL" for n in columns))
    if ceilings:
        out = out.where(F.greatest(*[F.col(f"`{c}`") for c in ceilings], F.lit(float("-inf"))) <= most)
    out = positions(out, ["path"], "line_no", LINES, "pos").withColumn("pos", F.col("pos") + 1)
    return (out if cap is None else out.where(F.col("pos") <= cap)).drop("line_no")


def nvml(spark: SparkSession, path: str, gpus: int = 4, cap: int | None = None) -> DataFrame:
    """GPU readings: watts (from mW) and degrees."""
    columns = {f"gpu-{i}[W]": _cell(f"gpu-{i}[mW]", 1e-3) for i in range(gpus)} | {f"gpu-{i}[C]": _cell(f"gpu-{i}[C]") for i in range(gpus)}
    return readings(log_rows(spark, path), columns, [f"gpu-{i}[W]" for i in range(gpus)], cap=cap)


def rapl(spark: SparkSession, path: str, cpus: int = 2, cap: int | None = None) -> DataFrame:
    """CPU readings: counters and watts of sockets and cores; the ceiling holds for sockets."""
    names = [f"cpu-{i}{part}[{unit}]" for unit in ("uJ", "W") for i in range(cpus) for part in ("", "-core")]
    return readings(log_rows(spark, path), {n: _cell(n) for n in names}, [f"cpu-{i}[W]" for i in range(cpus)], cap=cap)


def sample_rate(rows: DataFrame, n: int = 30) -> DataFrame:
    """path, hz: from the mean interval of a file's first `n` readable times; fewer than two raise, and where none passes between them hz is null."""
    times = rows.select("path", "line_no", F.try_to_timestamp(F.col("cells").getItem("reading-time"), F.lit(TIME)).alias("t")).where("t IS NOT NULL")
    w = Window.partitionBy("path").orderBy("line_no")
    first = times.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
    span = (F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))) / 1e6 / (F.count("*") - 1)
    found = first.groupBy("path").agg(F.count("*").alias("n"), F.when(F.count("*") > 1, span).alias("interval"))
    hz = F.when(F.col("n") < 2, F.raise_error(F.lit("fewer than two readable times"))).otherwise(F.bround(F.try_divide(F.lit(1.0), F.col("interval")), 0))
    return found.select("path", hz.alias("hz"))


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, name of a folder's files, without reading them."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    return listed.withColumn("name", F.element_at(F.split("path", "/"), -1))


def log_catalog(listed: DataFrame, slurm: str | None = None) -> DataFrame:
    """path, name, node_id, source (nvml, rapl), slurm_id of .log files."""
    name = F.col("name")
    slurm_id = F.nullif(F.regexp_extract(name, r"(?:slurmid_|[_-])(\d{6,})(?:[_-]|$)", 1), F.lit(""))
    out = listed.where(F.lower(name).endswith(".log")).select("path", "name", host_of(name).alias("node_id"), F.when(F.lower(name).startswith("nvml"), "nvml").when(F.lower(name).startswith("rapl"), "rapl").alias("source"), slurm_id.alias("slurm_id"))
    out = out.where("node_id IS NOT NULL AND source IS NOT NULL")
    return out if slurm is None else out.where(F.col("slurm_id") == slurm)


def pair_logs(catalog: DataFrame) -> list[tuple[str, str, str]]:
    """(node, nvml path, rapl path) in node order; raises on a node twice, on a log without its partner, and where there is none."""
    by_node = catalog.groupBy("node_id").agg(F.count_if(F.col("source") == "nvml").alias("n"), F.count_if(F.col("source") == "rapl").alias("r"), F.max(F.when(F.col("source") == "nvml", F.col("path"))).alias("nvml"), F.max(F.when(F.col("source") == "rapl", F.col("path"))).alias("rapl"))
    rows = by_node.orderBy("node_id").collect()  # a row a node
    for problem, bad in (("more than one log", lambda r: r.n > 1 or r.r > 1), ("NVML without RAPL", lambda r: r.n and not r.r), ("RAPL without NVML", lambda r: r.r and not r.n)):
        if names := [r.node_id for r in rows if bad(r)]:
            raise ValueError(f"{problem}: {', '.join(names)}")
    if not rows:
        raise ValueError("no pairs of logs")
    return [(r.node_id, r.nvml, r.rapl) for r in rows]


def orphans(catalog: DataFrame) -> DataFrame:
    """node_id, problem of logs without their partner."""
    by_node = catalog.groupBy("node_id").agg(F.bool_or(F.col("source") == "nvml").alias("n"), F.bool_or(F.col("source") == "rapl").alias("r"))
    problem = F.when(F.col("n") & ~F.col("r"), "NVML without RAPL").when(F.col("r") & ~F.col("n"), "RAPL without NVML")
    return by_node.select("node_id", problem.alias("problem")).where("problem IS NOT NULL")


def slurm_ids(catalog: DataFrame) -> DataFrame:
    return catalog.select("slurm_id").where("slurm_id IS NOT NULL").distinct().orderBy("slurm_id")


def device_catalog(listed: DataFrame) -> DataFrame:
    """device, hours (map of hour to path) of files named Dev<n>_ENF_Hr<n>.csv."""
    name = F.col("name")
    pattern = r"^(Dev\d+)_ENF_(Hr\d+)\.csv$"
    rows = listed.select("path", F.regexp_extract(name, pattern, 1).alias("device"), F.regexp_extract(name, pattern, 2).alias("hour")).where("device <> ''")
    return rows.groupBy("device").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("hour", "path")))).alias("hours"))


def power_profile(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, node_id, power_w, workload_class of a CSV file with a header; a cell that can't be read raises."""
    schema = "timestamp double, node_id string, power_w double, workload_class string"
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def node_frames(spark: SparkSession, folder: str, hz: int | None = None, frame_hz: float = 0.5, most: int = 1800, slurm: str | None = None, gpus: int = 4, cpus: int = 2) -> DataFrame:
    """node_id, frame and the mean of each reading for all pairs of logs of a folder: as many rows a frame as the first log's rate gives, at most `most` frames.

    Counters are unwrapped before they are averaged. One job reads all nodes' files.
    """
    from ..config import Nlr
    from ..operators.align import tumbling

    cfg = Nlr()
    catalog = log_catalog(files(spark, folder), slurm)
    pairs = pair_logs(catalog)
    rate = hz or int(sample_rate(log_rows(spark, pairs[0][1])).first().hz)
    per = max(1, round(rate / frame_hz))
    named = lambda df: df.withColumn("node_id", host_of(F.element_at(F.split("path", "/"), -1)))
    gpu, cpu = named(nvml(spark, [p for _, p, _ in pairs], gpus)), named(rapl(spark, [p for _, _, p in pairs], cpus))
    counters = [c for c in cpu.columns if c.endswith("[uJ]")]
    gpu, cpu = scratch.kept(gpu, "gpu"), scratch.kept(cpu, "cpu")  # what is scanned more than once is read once
    at = {c: F.col(f"`{c}`") for c in counters}
    cpu = earlier(cpu, ["node_id"], "pos", LINES, last={f"__b{k}": c for k, c in enumerate(at.values())})
    cpu = cpu.withColumns({f"__f{k}": F.when(c < F.col(f"__b{k}") - cfg.wrap_tolerance_uj, 1).otherwise(0) for k, c in enumerate(at.values())})
    cpu = earlier(cpu, ["node_id"], "pos", LINES, sums={f"__s{k}": F.col(f"__f{k}") for k in range(len(at))})
    cpu = cpu.withColumns({n: c + cfg.wrap_ceiling_uj * (F.col(f"__s{k}") + F.col(f"__f{k}")) for k, (n, c) in enumerate(at.items())}).drop(*[f"__{x}{k}" for x in "bfs" for k in range(len(at))])
    plain = lambda df: df.withColumnsRenamed({c: c.replace("[", "__").replace("]", "") for c in df.columns})
    values = lambda df: [c for c in df.columns if "__" in c]
    gpu, cpu = plain(gpu), plain(cpu)
    a, b = (tumbling(df, per, ["node_id"], values(df), "pos", LINES) for df in (gpu, cpu))
    both = a.join(b, ["node_id", "frame"]).where(F.col("frame") < most)
    return both.withColumnsRenamed({c: c.replace("__", "[") + "]" for c in both.columns if "__" in c})
