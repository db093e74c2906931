"""Merging check results into verdicts: worst of, corroboration across nodes, scores, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SCORES
from ..functions.status import name_of

FIRM = ["OUT OF RANGE", "MONOTONICITY VIOLATION", "ENERGY SPIKE"]


def merged(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status_rank, codes, reason, step, step_limit: the worst status and the codes in check order; nothing is masked.

    results: keys, check_ord, status_rank, code, observed, limit. step and step_limit are the continuity check's.
    """
    bad = F.when(F.col("code") != "ok", F.struct("check_ord", "code"))
    step = F.col("code") == "DISCONTINUITY"
    out = results.groupBy(*keys).agg(
        F.max("status_rank").alias("status_rank"),
        F.transform(F.array_sort(F.collect_list(bad)), lambda x: x["code"]).alias("codes"),
        F.max(F.when(step, F.col("observed"))).alias("step"),
        F.max(F.when(step, F.col("limit"))).alias("step_limit"),
    )
    return out.withColumn("reason", F.when(F.size("codes") == 0, "ok").otherwise(F.array_join("codes", " | ")))


def corroborated(verdicts: DataFrame, min_nodes: int, fraction: float, multiple: float, places: int = 2) -> DataFrame:
    """A step that enough nodes make at once on the same channel is suspect, not failed.

    It counts where the step is at most `multiple` times its limit and no firm code stands beside it. Enough: at least
    max(2, min(min_nodes, nodes)) and the fraction of the nodes that report the channel in that frame.
    """
    run = [c for c in ["run_id"] if c in verdicts.columns]
    pure = (F.col("status_rank") == 2) & F.array_contains("codes", "DISCONTINUITY") & ~F.arrays_overlap("codes", F.array(*map(F.lit, FIRM)))
    pure = F.coalesce(pure & (F.round("step", places) <= F.col("step_limit") * multiple), F.lit(False))
    frame = Window.partitionBy(*run, "idx", "channel")
    marked = verdicts.withColumn("__pure", pure)
    marked = marked.withColumn("__same", F.sum(F.col("__pure").cast("int")).over(frame)).withColumn("__nodes", F.count("*").over(frame))
    enough = (F.col("__same") >= F.greatest(F.lit(2), F.least(F.lit(min_nodes), F.col("__nodes")))) & (F.col("__same") >= fraction * F.col("__nodes"))
    soft = F.col("__pure") & enough
    out = marked.withColumn("status_rank", F.when(soft, 1).otherwise(F.col("status_rank"))).withColumn("corroborated", soft)
    return out.drop("__pure", "__same", "__nodes")


def scored(verdicts: DataFrame, confidence: str | None = None) -> DataFrame:
    """verdicts with status and score; a suspect ENF verdict has its confidence for a score."""
    half = F.col(confidence) if confidence else F.lit(SCORES["suspect"])
    score = F.when(F.col("status_rank") == 2, SCORES["failed"]).when(F.col("status_rank") == 1, half).otherwise(SCORES["trusted"])
    return verdicts.withColumn("status", name_of(F.col("status_rank"))).withColumn("score", F.round(score, 4))


def annotated(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """by, status: the worst status of the verdicts of each `by`, as a name."""
    return verdicts.groupBy(*by).agg(name_of(F.max("status_rank")).alias("status"))


def layers(spine: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """spine (keys) with score: 0, 0.5 or 1 by the worst verdict; without any, trusted."""
    worst = verdicts.groupBy(*keys).agg(F.max("status_rank").alias("__rank"))
    return spine.join(worst, keys, "left").select(*spine.columns, (F.coalesce("__rank", F.lit(0)) / 2.0).alias("score"))


def scoreboard(layer_rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A row an idx with `<layer>_status` columns."""
    named = layer_rows.withColumn("layer", F.concat("layer", F.lit("_status")))
    return named.groupBy("idx").pivot("layer", [f"{n}_status" for n in names] if names else None).agg(F.max("score"))


def component_counts(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """by, trusted, suspect, failed, total."""
    n = lambda k: F.count_if(F.col("status_rank") == k)
    return verdicts.groupBy(*by).agg(n(0).alias("trusted"), n(1).alias("suspect"), n(2).alias("failed"), F.count("*").alias("total"))


def rack_summary(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """by, status_rank, score, reasons: the worst status, the least score among its rows, and what isn't trusted, in channel order."""
    worst = verdicts.groupBy(*by).agg(
        F.max("status_rank").alias("status_rank"),
        F.min_by("score", F.struct(-F.col("status_rank"), F.col("score"))).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("status_rank") > 0, F.struct("channel", "reason")))).alias("reasons"),
    )
    return worst
