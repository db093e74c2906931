"""The verifier: every check on every channel, merged into a verdict a channel and frame, always."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SCORES, Enf, Nlr
from ..functions.status import name_of
from ..operators import enf as E
from ..operators import nlr as N
from ..operators import verdict as V
from ..operators.scoring import without_labels
from ..sources.scratch import kept

KEYS = ["run_id", "idx", "node_id", "channel"]


def _numbered(long: DataFrame) -> DataFrame:
    """long with frame: how many frames of its run came before."""
    frames = long.select("run_id", "idx").distinct()
    frames = frames.withColumn("frame", F.row_number().over(Window.partitionBy("run_id").orderBy("idx")) - 1)
    return long.join(frames, ["run_id", "idx"])


def node_results(long: DataFrame, cfg: Nlr | None = None) -> DataFrame:
    """KEYS, check_ord, status_rank, code, observed, limit of all node checks, in the verifier's order.

    long: run_id, idx, node_id, channel, kind, is_core, value. The numbered rows are stored, since every check reads them.
    """
    cfg = cfg or Nlr()
    rows = kept(_numbered(without_labels(long)), "numbered")
    gpu_w, cpu_w, gpu_c, uj = (rows.where(F.col("kind") == k) for k in ("gpu_power", "cpu_power", "gpu_temp", "cpu_uj"))
    sockets = cpu_w.where("NOT is_core")
    watts = gpu_w.unionByName(cpu_w)
    parts = [
        (0, N.value_range(watts, cfg.floor_w, cfg.ceiling_w)),
        (1, N.continuity(gpu_w, cfg.gpu_step_w)),
        (1, N.continuity(cpu_w, cfg.cpu_step_w)),
        (2, N.monotonicity(uj, cfg.wrap_ceiling_uj, cfg.wrap_tolerance_uj, cfg.energy_step_uj)),
        (3, N.sibling_ratio(gpu_w, *cfg.sibling_gpu_w)),
        (3, N.sibling_ratio(gpu_c, *cfg.sibling_gpu_c)),
        (3, N.sibling_ratio(sockets, *cfg.sibling_cpu_w)),
        (4, N.sustained(gpu_w, cfg.gpu_step_w, cfg.recovery_w, cfg.quiet_frames, cfg.recovery_run)),
        (4, N.sustained(gpu_c, cfg.temp_step_c, cfg.recovery_c, cfg.quiet_frames, cfg.recovery_run)),
        (5, N.startup_ramp(gpu_w, cfg.ramp_low_w, cfg.ramp_high_w, cfg.ramp_deadline, cfg.ramp_run)),
        (6, N.replay(watts.unionByName(gpu_c), cfg.replay_gram, cfg.replay_lookback, cfg.replay_floor_w)),
        (7, N.value_range(gpu_c, cfg.temp_floor_c, cfg.temp_ceiling_c, low_fails=True)),
        (8, N.continuity(gpu_c, cfg.temp_step_c)),
    ]
    out = None
    for order, part in parts:
        own = part.select(*KEYS, F.lit(order).alias("check_ord"), "status_rank", "code", F.col("observed").cast("double").alias("observed"), "limit")
        out = own if out is None else out.unionByName(own)
    return out


def enf_results(series: DataFrame, cfg: Enf | None = None, alternative: bool = False) -> DataFrame:
    """run_id, idx, status_rank, codes, confidence: a row a frame. series: run_id, idx, frq, and alt if there is another stream.

    With ts, idx is the order in which frames arrived, and a time that was accepted before, or is not later than all
    accepted, fails the frame.
    """
    cfg = cfg or Enf()
    guarded = E.sequence_guard(series, "idx", "ts") if "ts" in series.columns else series.withColumn("code", F.lit("ok"))
    series = guarded.withColumnRenamed("code", "sequence")
    a = E.anchors(series, cfg.anchor_radius, cfg.nominal_hz)
    a = E.raw_drift(a, cfg.raw_drift_window, cfg.raw_drift_hz)
    a = E.alternative(a, cfg.alt_window, cfg.alt_threshold, cfg.alt_min_variance, cfg.nominal_hz) if alternative else a.withColumn("mismatch", F.lit(False))
    a = E.local_cusum(a, cfg.cusum_baseline, cfg.local_threshold, cfg.local_window, cfg.suspect, cfg.local_recovery)
    a = E.drift_cusum(a, cfg.cusum_baseline, cfg.cusum_threshold, cfg.warmup, cfg.cusum_history)
    checks = [
        ("REPLAY", F.col("sequence") == "REPLAY"),
        ("OUT OF ORDER", F.col("sequence") == "OUT OF ORDER"),
        ("OUT OF NOMINAL RANGE", F.abs(F.col("frq") - cfg.nominal_hz) > cfg.tolerance_hz),
        ("RAW VALUE TREND", F.col("drifting")),
        ("CORRELATION MISMATCH", F.col("mismatch")),
        ("FLAT SIGNATURE", F.col("flat")),
        ("DISCONTINUITY", F.col("confidence") < cfg.suspect),
        ("DRIFT DETECTED", F.col("drifted")),
        ("LOCAL ANOMALY", F.col("shifted")),
    ]
    codes = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())
    rank = F.when(F.size("codes") > 0, 2).when(F.col("confidence") < cfg.trusted, 1).otherwise(0)
    return a.withColumn("codes", codes).select("run_id", "idx", rank.alias("status_rank"), "codes", "confidence")


def verify(series: DataFrame, long: DataFrame, enf: Enf | None = None, nlr: Nlr | None = None, alternative: bool = False) -> DataFrame:
    """run_id, idx, component_id, status, score, reason: one row for the frequency and one for each channel of each frame."""
    nlr = nlr or Nlr()
    merged = V.merged(node_results(long, nlr), KEYS)
    present = long.select(*KEYS).distinct().join(merged, KEYS, "left")
    present = present.withColumns({"status_rank": F.coalesce("status_rank", F.lit(0)), "codes": F.coalesce("codes", F.array().cast("array<string>")), "reason": F.coalesce("reason", F.lit("ok"))})
    nodes = V.scored(V.corroborated(present, nlr.sync_nodes, nlr.sync_fraction, nlr.sync_step_multiple))
    note = F.when(F.col("corroborated"), F.concat("reason", F.lit(" | corroborated across nodes"))).otherwise(F.col("reason"))
    nodes = nodes.select("run_id", "idx", F.concat_ws("/", "node_id", "channel").alias("component_id"), "status", "score", note.alias("reason"))
    grid = enf_results(series, enf, alternative)
    score = F.when(F.col("status_rank") == 2, SCORES["failed"]).when(F.col("status_rank") == 1, F.col("confidence")).otherwise(SCORES["trusted"])
    reason = F.when(F.size("codes") > 0, F.array_join("codes", " | ")).otherwise("ok")
    grid = grid.select("run_id", "idx", F.lit("ENF").alias("component_id"), name_of(F.col("status_rank")).alias("status"), F.round(score, 4).alias("score"), reason.alias("reason"))
    return grid.unionByName(nodes)
