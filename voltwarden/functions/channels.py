"""Channel names of wide telemetry: `<node>_<gpu|cpu>-<n>[-core][unit]`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERN = r"^(?:(.+?)_)?((gpu|cpu)-(\d+)(-core)?)\[(W|C|uJ)\]$"
HOST = r"(?i)(x\d+c\d+s\d+b\d+n\d+)"


def _group(name: Column, i: int) -> Column:
    found = F.regexp_extract(name, PATTERN, i)
    return F.when(found != "", found)


def node_of(name: Column) -> Column:
    """The node of a channel name; null where it has none."""
    return _group(name, 1)


def bare(name: Column) -> Column:
    """The name without its node."""
    return F.when(_group(name, 2).isNotNull(), F.concat(_group(name, 2), F.lit("["), _group(name, 6), F.lit("]")))


def kind(name: Column) -> Column:
    """gpu_power, cpu_power, gpu_temp or cpu_uj; null for any other name."""
    device, unit = _group(name, 3), _group(name, 6)
    return F.when(unit == "W", F.concat(device, F.lit("_power"))).when((unit == "C") & (device == "gpu"), "gpu_temp").when((unit == "uJ") & (device == "cpu"), "cpu_uj")


def is_core(name: Column) -> Column:
    return F.regexp_extract(name, PATTERN, 5) != ""


def ordinal(name: Column) -> Column:
    return F.regexp_extract(name, PATTERN, 4).try_cast("int")


def host_of(file_name: Column) -> Column:
    """The host in a file's name; null where there is none."""
    found = F.regexp_extract(file_name, HOST, 1)
    return F.when(found != "", F.lower(found))


def to_long(wide: DataFrame, index: str = "index", run: str | None = None) -> DataFrame:
    """One row a channel that a frame has: idx, node_id, channel, kind, ordinal, is_core, unit, value. Absent channels have no row."""
    ids = [c for c in (run, index) if c]
    names = [c for c in wide.columns if c.endswith(("[W]", "[C]", "[uJ]"))]
    long = wide.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`").cast("double").alias(c) for c in names], "name", "value").where("value IS NOT NULL")
    name = F.col("name")
    return long.select(*[F.col(f"`{c}`").alias("run_id" if c == run else "idx") for c in ids], node_of(name).alias("node_id"), bare(name).alias("channel"), kind(name).alias("kind"), ordinal(name).alias("ordinal"), is_core(name).alias("is_core"), _group(name, 6).alias("unit"), "value")


def to_wide(long: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """The inverse of to_long() for one run: a row an idx. Give the channel names where they are known: it saves a job."""
    named = long.select("idx", F.concat_ws("_", "node_id", "channel").alias("name"), "value")
    return named.groupBy(F.col("idx").alias("index")).pivot("name", channels).agg(F.first("value"))


def renamed_columns(wide: DataFrame, ids: dict[str, str]) -> DataFrame:
    """wide with every column that begins with a node's id and _ under its short id, status columns too; the longest id counts."""
    new = {}
    for c in wide.columns:
        own = max((i for i in ids if c.startswith(f"{i}_")), key=len, default=None)
        if own:
            new[c] = ids[own] + c[len(own) :]
    return wide.withColumnsRenamed(new)


def nodes_of(names: list[str]) -> list[str]:
    """The sorted nodes of the channels among column names."""
    import re

    return sorted({m[1] for n in names if (m := re.match(PATTERN, n)) and m[1]})


def target_groups(names: list[str]) -> dict[str, list[str]]:
    """What attacks may aim at, from a frame's column names: each named group's channels, and each node's."""
    import re

    found = {n: m for n in names if (m := re.match(PATTERN, n))}
    own = {"frq": [n for n in names if n == "FRQ"]}
    own["gpus"] = [n for n, m in found.items() if m[3] == "gpu"]
    own["gpu_watts"] = [n for n, m in found.items() if m[3] == "gpu" and m[6] == "W"]
    own["gpu_temps"] = [n for n, m in found.items() if m[3] == "gpu" and m[6] == "C"]
    own["cpus"] = [n for n, m in found.items() if m[3] == "cpu"]
    own["all"] = own["frq"] + own["gpus"] + own["cpus"]
    return own | {node: [n for n, m in found.items() if m[1] == node] for node in nodes_of(names)}


def target_group(name: Column, group: str) -> Column:
    """Whether a channel is in a named group of attack targets: frq, gpus, gpu_watts, gpu_temps, cpus, all."""
    device, unit = _group(name, 3), _group(name, 6)
    groups = {"frq": name == "FRQ", "gpus": device == "gpu", "gpu_watts": (device == "gpu") & (unit == "W"), "gpu_temps": (device == "gpu") & (unit == "C"), "cpus": device == "cpu", "all": F.lit(True)}
    return F.coalesce(groups[group], F.lit(False))
