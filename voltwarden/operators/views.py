"""What dashboards show: node states, racks, alert episodes, incidents, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def node_totals(long: DataFrame) -> DataFrame:
    """idx, node_id, gpu_w, cpu_w (without cores), total_w, gpu_c: sums of what is there (0 for none), mean temperature (null for none)."""
    watts = lambda kind: F.coalesce(F.sum(F.when((F.col("kind") == kind) & ~F.col("is_core"), F.col("value"))), F.lit(0.0))
    out = long.groupBy("idx", "node_id").agg(watts("gpu_power").alias("gpu_w"), watts("cpu_power").alias("cpu_w"), F.avg(F.when(F.col("kind") == "gpu_temp", F.col("value"))).alias("gpu_c"))
    return out.withColumn("total_w", F.col("gpu_w") + F.col("cpu_w"))


def samples(long: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """idx, node_id and maps of ordinal to value: gpu_w, gpu_c, cpu_w, cpu_uj, core_w, core_uj.

    With scores (idx, node_id, score; node_id ENF for the frequency) also status, the node's own score of the frame, and
    enf_status, that of the frequency, which all nodes share; null where there is none.
    """

    def values(kind: str, core: bool) -> Column:
        own = F.when((F.col("kind") == kind) & (F.col("is_core") == core), F.struct("ordinal", "value"))
        return F.map_from_entries(F.array_sort(F.collect_list(own)))

    out = long.groupBy("idx", "node_id").agg(values("gpu_power", False).alias("gpu_w"), values("gpu_temp", False).alias("gpu_c"), values("cpu_power", False).alias("cpu_w"), values("cpu_uj", False).alias("cpu_uj"), values("cpu_power", True).alias("core_w"), values("cpu_uj", True).alias("core_uj"))
    if scores is None:
        return out
    own = scores.where("node_id <> 'ENF'").select("idx", "node_id", F.col("score").alias("status"))
    shared = scores.where("node_id = 'ENF'").select("idx", F.col("score").alias("enf_status"))
    return out.join(own, ["idx", "node_id"], "left").join(shared, "idx", "left")


def devices(sample: DataFrame, left: str, right: str) -> DataFrame:
    """idx, node_id, ordinal, a, b over the union of two maps' keys."""
    both = F.map_zip_with(left, right, lambda k, a, b: F.struct(a.alias("a"), b.alias("b")))
    return sample.select("idx", "node_id", F.explode(both).alias("ordinal", "v")).select("idx", "node_id", "ordinal", "v.a", "v.b")


def normal_ids(nodes: DataFrame) -> DataFrame:
    """node_id, short_id: node00, node01... in order of the ids."""
    return nodes.select("node_id").distinct().withColumn("short_id", F.format_string("node%02d", F.row_number().over(Window.orderBy("node_id")) - 1))


def racks(nodes: DataFrame, size: int = 4) -> DataFrame:
    """node_id, rack: sorted nodes in groups of `size`."""
    place = F.row_number().over(Window.orderBy("node_id")) - 1
    return nodes.select("node_id").distinct().withColumn("rack", F.concat(F.lit("Rack "), (F.floor(place / size) + 1).cast("string")))


def rack_totals(state: DataFrame, rack: DataFrame) -> DataFrame:
    """idx, rack, total_w, worst: sums with nulls as 0, and the worst status rank."""
    return state.join(rack, "node_id").groupBy("idx", "rack").agg(F.sum(F.coalesce("total_w", F.lit(0.0))).alias("total_w"), F.max("status_rank").alias("worst"))


def summary(state: DataFrame, by: list[str], facility: str = "ENF") -> DataFrame:
    """by, total, normal, warning, alert: nodes by status, the facility's own entry left out."""
    real = state.where(F.col("node_id") != facility)
    n = lambda k: F.count_if(F.col("status_rank") == k)
    return real.groupBy(*by).agg(F.count("*").alias("total"), n(0).alias("normal"), n(1).alias("warning"), n(2).alias("alert"))


def episodes(polls: DataFrame, last: Column) -> DataFrame:
    """node_id, severity, start_ts, end_ts, samples, vector, peak, ongoing: maximal runs of one severity other than good.

    polls: node_id, ts, severity (0 good), vector, value. The first vector of an episode that is one counts; an episode
    is ongoing where it ends with the polls (`last`).
    """
    w = Window.partitionBy("node_id").orderBy("ts")
    changed = F.coalesce(F.col("severity") != F.lag("severity").over(w), F.lit(True)).cast("int")
    runs = polls.withColumn("__new", changed).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("severity > 0")
    first = F.min_by(F.when(F.col("vector") != "Unclassified", F.col("vector")), F.when(F.col("vector") != "Unclassified", F.col("ts")))
    out = runs.groupBy("node_id", "__run", "severity").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("samples"), F.coalesce(first, F.lit("Unclassified")).alias("vector"), F.max("value").alias("peak"), F.max_by("value", "ts").alias("last_value"))
    return out.withColumn("ongoing", F.col("end_ts") == last).drop("__run")


def incidents(episode: DataFrame, gap: float, keys: list[str]) -> DataFrame:
    """keys, start_ts, end_ts, nodes, severity, samples, peak, children: episodes of alike keys that start at most `gap` after the latest end before them.

    Episodes without a start are incidents by themselves.
    """
    w = Window.partitionBy(*keys).orderBy("start_ts", "end_ts", "node_id")
    known = episode.where("start_ts IS NOT NULL")
    latest = F.max("end_ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = known.withColumn("__new", F.when(F.col("start_ts") - latest <= gap, 0).otherwise(1))
    marked = marked.withColumn("__group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    alone = episode.where("start_ts IS NULL").withColumn("__new", F.lit(1)).withColumn("__group", (-1 - F.monotonically_increasing_id()).cast("long"))
    own = [k for k in keys if k != "severity"]
    return marked.unionByName(alone).groupBy(*keys, "__group").agg(
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        F.count_distinct("node_id").alias("nodes"),
        *([] if "severity" in keys else [F.max("severity").alias("severity")]),
        F.sum("samples").alias("samples"),
        F.max("peak").alias("peak"),
        F.bool_or("ongoing").alias("ongoing"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start_ts", "vector"))), lambda x: x["vector"])).alias("vectors"),
        F.array_sort(F.collect_list(F.struct("start_ts", "node_id", "end_ts", "samples"))).alias("children"),
    ).drop("__group") if own or "severity" in keys else marked


def latest_first(incident: DataFrame) -> DataFrame:
    """Incidents as they are listed: the latest end first, ties by start."""
    return incident.orderBy(F.col("end_ts").desc(), F.col("start_ts").desc())


def requested(nodes: DataFrame, ids: list[str] | None = None, count: int | None = None) -> DataFrame:
    """node_id, found: the nodes asked for, in order; ids that are not there have found = false. Without ids, the first `count`; without either, all."""
    have = nodes.select("node_id").distinct()
    if ids:
        wanted = nodes.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "node_id string")
        return wanted.join(have.withColumn("found", F.lit(True)), "node_id", "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy("node_id")
    out = have.withColumn("found", F.lit(True)).orderBy("node_id")
    return out.limit(count) if count else out


def by_sample(results: DataFrame) -> DataFrame:
    """sample, records: the results (timestamp, component_id, status, score, reason) of each sample, whose index is the whole part of the time."""
    record = F.struct("component_id", "status", "score", "reason")
    return results.groupBy(F.col("timestamp").cast("long").alias("sample")).agg(F.array_sort(F.collect_list(record)).alias("records"))


def verified_samples(samples: DataFrame, results: DataFrame) -> DataFrame:
    """sample, node_id, label, score, reasons: the worst of a sample's results that concern a node, or all where node_id is null.

    A component concerns a node where, behind a run's name and a slash, it is ENF or begins with the node's id. Failed is
    warning, suspect is suspect, else good; a sample without results is --. The score is the lowest of the worst results
    (1 at most where all are good), the reasons are those of results that are not trusted, in order of their components.
    """
    part = F.element_at(F.split("component_id", "/", 2), -1)
    rows = results.select(F.col("timestamp").cast("long").alias("sample"), "component_id", part.alias("part"), "status", F.col("score").alias("s"), "reason")
    near = F.col("node_id").isNull() | (F.col("part") == "ENF") | F.startswith("part", F.concat("node_id", F.lit("_")))
    rank = F.when(F.col("status") == "failed", 2).when(F.col("status") == "suspect", 1).otherwise(0)
    both = samples.select("sample", "node_id").join(rows, "sample").where(near).withColumn("rank", rank)
    told = F.when(F.col("rank") > 0, F.struct("part", "reason"))
    worst = both.groupBy("sample", "node_id").agg(F.max("rank").alias("rank"), F.min(F.struct(F.negative("rank").alias("r"), "s"))["s"].alias("lowest"), F.array_sort(F.collect_list(told)).alias("reasons"))
    same = samples["sample"].eqNullSafe(F.col("w_sample")) & samples["node_id"].eqNullSafe(F.col("w_node"))
    out = samples.join(worst.withColumnsRenamed({"sample": "w_sample", "node_id": "w_node"}), same, "left")
    label = F.when(F.col("rank") == 2, "warning").when(F.col("rank") == 1, "suspect").when(F.col("rank") == 0, "good").otherwise("--")
    score = F.round(F.when(F.col("rank") == 0, F.least("lowest", F.lit(1.0))).otherwise(F.col("lowest")), 4)
    return out.select("sample", "node_id", label.alias("label"), score.alias("score"), F.coalesce("reasons", F.array().cast("array<struct<part:string,reason:string>>")).alias("reasons"))


def alert_stats(polls: DataFrame) -> DataFrame:
    """node_id, alerts, last_ts, last_severity of polls that aren't good."""
    bad = F.col("severity") > 0
    return polls.groupBy("node_id").agg(F.count_if(bad).alias("alerts"), F.max(F.when(bad, F.col("ts"))).alias("last_ts"), F.max_by("severity", F.when(bad, F.col("ts"))).alias("last_severity"))


def timeline(episode: DataFrame, limit: int = 100, severity: int | None = None, node_id: str | None = None) -> DataFrame:
    """The latest episodes, of a severity or node if asked for."""
    rows = episode if severity is None else episode.where(F.col("severity") == severity)
    rows = rows if node_id is None else rows.where(F.col("node_id") == node_id)
    return rows.orderBy(F.col("end_ts").desc(), "node_id", "start_ts").limit(limit)


def newest(df: DataFrame, keys: list[str], n: int, order: str) -> DataFrame:
    """The n newest rows of each key; Spark limits them before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return df.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def sticky(df: DataFrame, keys: list[str], value: str, order: str = "idx") -> DataFrame:
    """df with `sticky`: the last known value where there is none."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("sticky", F.last(value, ignorenulls=True).over(w))


def recent(df: DataFrame, keys: list[str], seconds: float, order: str = "ts") -> DataFrame:
    """Rows of the last `seconds` of each key; a key with none there keeps all."""
    last = df.groupBy(*keys).agg(F.max(order).alias("__last"))
    least = df.agg((F.max(order) - seconds).alias("__least"))
    both = df.join(last, keys).crossJoin(F.broadcast(least))  # one row
    return both.where((F.col(order) >= F.col("__least")) | (F.col("__last") < F.col("__least"))).select(*df.columns)


def latest_state(states: DataFrame) -> DataFrame:
    """object, property, value, ts: the newest value of each property of each object."""
    return states.groupBy("object", "property").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def facility_entry(frames: DataFrame) -> DataFrame:
    """A row a frame for the facility itself, beside those of the nodes: idx, node_id ENF, frq (a frame's nodes share it; the least counts)."""
    return frames.groupBy("idx").agg(F.min("frq").alias("frq")).withColumn("node_id", F.lit("ENF"))


def header(frames: DataFrame) -> DataFrame:
    """idx, frq, label: the first known frequency and status label over a frame's nodes in order."""
    known = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("node_id")))
    return frames.groupBy("idx").agg(known("frq").alias("frq"), F.coalesce(known("label"), F.lit("--")).alias("label"))


def renamed_components(records: DataFrame, ids: DataFrame) -> DataFrame:
    """records with component_id (node/channel) under short node ids; those without a node stay."""
    node = F.split_part("component_id", F.lit("/"), F.lit(1))
    both = records.join(ids.withColumnRenamed("node_id", "__node"), node == F.col("__node"), "left")
    new = F.concat_ws("/", "short_id", F.when(F.contains("component_id", F.lit("/")), F.split_part("component_id", F.lit("/"), F.lit(2))))
    return both.withColumn("component_id", F.when(F.col("short_id").isNotNull(), new).otherwise(F.col("component_id"))).select(*records.columns)


def all_episodes(closed: DataFrame, running: DataFrame) -> DataFrame:
    """Closed episodes and those still running, told apart by `ongoing`."""
    return closed.withColumn("ongoing", F.lit(False)).unionByName(running.withColumn("ongoing", F.lit(True)))


def with_rack(episode: DataFrame, rack: DataFrame) -> DataFrame:
    return episode.join(rack, "node_id", "left").withColumn("rack", F.coalesce("rack", F.lit("--")))


def ticks(low: float, high: float, step: float) -> Column:
    """An axis's ticks: multiples of step within low..high."""
    return F.transform(F.sequence(F.ceil(F.lit(low / step)).cast("long"), F.floor(F.lit(high / step)).cast("long")), lambda k: k * step)


def missing_objects(required: DataFrame, existing: DataFrame) -> DataFrame:
    """object of those required that do not exist."""
    return required.select("object").distinct().join(existing.select("object").distinct(), "object", "left_anti")


def anchor_at(series: DataFrame, times: DataFrame, rate_hz: float) -> DataFrame:
    """times (ts) with the frq at idx = ts * rate, held within the series."""
    ends = series.agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    at = times.crossJoin(F.broadcast(ends)).withColumn("idx", F.greatest(F.col("lo"), F.least(F.col("hi"), F.floor(F.col("ts") * rate_hz).cast("long"))))  # one row
    return at.join(series.select("idx", "frq"), "idx").select("ts", "idx", "frq")
