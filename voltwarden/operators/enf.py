"""Checks and cleaning of the grid frequency: one series a run, in rows of run_id, idx, frq.

Window frames give whatever depends on values only; a fold a run is kept for what depends on its own earlier outcomes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import Enf
from .stretches import folded


def by_run(df: DataFrame, order: str | Column = "idx") -> WindowSpec:
    return Window.partitionBy(*[c for c in ["run_id"] if c in df.columns]).orderBy(order)


def pearson(x: Column, y: Column, w: WindowSpec) -> Column:
    """Correlation over a frame; 0 where one side doesn't vary, and within -1..1."""
    spread = F.var_pop(x).over(w) * F.var_pop(y).over(w)
    r = F.try_divide(F.covar_pop(x, y).over(w), F.sqrt(F.greatest(spread, F.lit(0.0))))
    return F.greatest(F.least(F.coalesce(r, F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))


def padded(df: DataFrame, by: int) -> DataFrame:
    """df with `pos` from 1 and `by` rows more at each end that repeat the first and the last value."""
    w = by_run(df)
    n = Window.partitionBy(*[c for c in ["run_id"] if c in df.columns])
    marked = df.withColumn("pos", F.row_number().over(w)).withColumn("__n", F.count("*").over(n)).withColumn("real", F.lit(True))
    copies = F.when(F.col("pos") == 1, F.sequence(F.lit(-by + 1), F.lit(0))).otherwise(F.array().cast("array<int>"))
    copies = F.concat(copies, F.when(F.col("pos") == F.col("__n"), F.sequence((F.col("pos") + 1).cast("int"), (F.col("pos") + by).cast("int"))).otherwise(F.array().cast("array<int>")))
    edges = marked.where((F.col("pos") == 1) | (F.col("pos") == F.col("__n"))).withColumn("pos", F.explode(copies)).withColumn("real", F.lit(False))
    return marked.unionByName(edges).drop("__n")


def anchors(df: DataFrame, radius: int, nominal: float = 60.0) -> DataFrame:
    """df with signature (its window scaled to 0..1; all 0.5 where flat), flat, and confidence: the correlation with the window before it (the first: 1)."""
    all_rows = padded(df, radius + 1)
    w = by_run(all_rows, "pos")
    frame = w.rowsBetween(-radius, radius)
    centred = all_rows.withColumn("__x", F.col("frq") - nominal).withColumn("__y", F.lag(F.col("frq") - nominal).over(w))
    low, high = F.min("frq").over(frame), F.max("frq").over(frame)
    out = centred.withColumn("__low", low).withColumn("__high", high).withColumn("__window", F.collect_list("frq").over(frame)).withColumn("confidence", pearson(F.col("__x"), F.col("__y"), frame))
    out = out.where("real")
    scale = F.transform("__window", lambda v: F.when(F.col("__high") == F.col("__low"), 0.5).otherwise((v - F.col("__low")) / (F.col("__high") - F.col("__low"))))
    out = out.withColumn("signature", scale).withColumn("flat", F.col("__high") == F.col("__low")).withColumn("confidence", F.when(F.col("pos") == 1, 1.0).otherwise(F.col("confidence")))
    return out.drop("__x", "__y", "__low", "__high", "__window", "real", "pos")


def raw_drift(df: DataFrame, window: int, limit: float) -> DataFrame:
    """df with drift, the means' distance of the halves of the last `window` values, and drifting; neither before the window is full."""
    w, half = by_run(df), window // 2
    late, early = w.rowsBetween(-half + 1, 0), w.rowsBetween(-window + 1, -half)
    full = F.count("frq").over(w.rowsBetween(-window + 1, 0)) == window
    moved = F.abs(F.avg("frq").over(late) - F.avg("frq").over(early))
    return df.withColumn("drift", F.when(full, moved)).withColumn("drifting", F.coalesce(F.col("drift") > limit, F.lit(False)))


def paired(observed: DataFrame, other: DataFrame) -> DataFrame:
    """observed (run_id, idx, frq) with alt, another stream's frequency of the same frame (run_id, idx, alt); null where it has none."""
    return observed.join(other.select("run_id", "idx", "alt"), ["run_id", "idx"], "left")


def alternative(df: DataFrame, window: int, threshold: float, least: float, nominal: float = 60.0) -> DataFrame:
    """df (with alt) with r, the correlation over the last `window` pairs, and mismatch.

    r is null before there are as many, where either side is too steady, and at frames without alt, which are in no window.
    """
    both = F.col("alt").isNotNull() & F.col("frq").isNotNull()
    w = Window.partitionBy(*[c for c in ["run_id"] if c in df.columns], both).orderBy("idx").rowsBetween(-window + 1, 0)
    x, y = F.col("frq") - nominal, F.col("alt") - nominal
    ready = both & (F.count("alt").over(w) == window) & (F.var_samp(x).over(w) >= least) & (F.var_samp(y).over(w) >= least)
    r = F.try_divide(F.covar_samp(x, y).over(w), F.sqrt(F.greatest(F.var_samp(x).over(w) * F.var_samp(y).over(w), F.lit(0.0))))
    return df.withColumn("r", F.when(ready, r)).withColumn("mismatch", F.coalesce(F.col("r") < threshold, F.lit(False)))


def sequence_guard(df: DataFrame, arrival: str = "seq", time: str = "ts", strict: bool = True) -> DataFrame:
    """df with code: REPLAY for a time accepted before, OUT OF ORDER (strict only) for one that is not later than all accepted; else ok.

    In arrival order a time is accepted where it exceeds all before it, so the accepted ones are the records of the running maximum.
    """
    run = [c for c in ["run_id"] if c in df.columns]
    if not strict:
        nth = F.row_number().over(Window.partitionBy(*run, time).orderBy(arrival))
        return df.withColumn("code", F.when(nth > 1, "REPLAY").otherwise("ok"))
    most = F.max(time).over(by_run(df, arrival).rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__record", F.coalesce(F.col(time) > most, F.lit(True)))
    seen = F.max(F.col("__record").cast("int")).over(Window.partitionBy(*run, time).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    code = F.when(F.col("__record"), "ok").when(seen == 1, "REPLAY").otherwise("OUT OF ORDER")
    return marked.withColumn("code", code).drop("__record")


def local_cusum(df: DataFrame, baseline: float, limit: float, warm: int, good: float, recovery: int) -> DataFrame:
    """df (with confidence) with cusum and shifted, by the rule of Lindley.

    S = max(0, S + deviation - baseline), less the baseline once more for a good deviation after `warm` values; a run of
    `recovery` confidences of at least `good` sets it to 0. The resets depend on the input alone, so within the rows
    between them S is the running sum less its lowest value so far, or 0 if that is lower.
    """
    w = by_run(df)
    deviation = 1 - F.col("confidence")
    marked = df.withColumn("__pos", F.row_number().over(w)).withColumn("__bad", F.when(F.col("confidence") >= good, 0).otherwise(1))
    marked = marked.withColumn("__island", F.sum("__bad").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = [c for c in ["run_id"] if c in df.columns]
    streak = F.sum(1 - F.col("__bad")).over(Window.partitionBy(*run, "__island").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("__reset", F.when(streak >= recovery, 1).otherwise(0))
    marked = marked.withColumn("__segment", F.sum("__reset").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = deviation - baseline - F.when((F.col("__pos") >= warm) & (deviation < baseline), baseline).otherwise(0.0)
    marked = marked.withColumn("__step", F.when(F.col("__reset") == 1, 0.0).otherwise(step))
    upto = Window.partitionBy(*run, "__segment").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("__sum", F.sum("__step").over(upto))
    s = F.col("__sum") - F.least(F.lit(0.0), F.min("__sum").over(upto))
    out = marked.withColumn("cusum", F.when(F.col("__reset") == 1, 0.0).otherwise(s)).withColumn("shifted", F.col("cusum") > limit)
    return out.drop("__pos", "__bad", "__island", "__reset", "__segment", "__step", "__sum")


def _folded(df: DataFrame, more: str, fold) -> DataFrame:
    """A fold over each run's rows in idx order."""
    keys = [c for c in ["run_id"] if c in df.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*keys).applyInPandas(lambda rows: fold(rows.sort_values("idx", kind="stable")), f"{schema}, {more}")


def drift_cusum(df: DataFrame, baseline: float, limit: float, warm: int, history: int, span: int | None = None) -> DataFrame:
    """df (with confidence) with drift_sum and drifted: a CUSUM that starts again when it fires.

    After `warm` values the baseline becomes the mean deviation so far (of the last `history` at most) and the sum 0. A
    run is folded in order, or, with `span`, in stretches of so many idx at once.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", drift_sum double, drifted boolean"
    keys, names = [c for c in ["run_id"] if c in df.columns], df.columns

    def fold(rows: pd.DataFrame, state: list[float]) -> tuple[pd.DataFrame, list[float]]:
        n, s, base, *seen = state
        sums, fired = [], []
        for c in rows["confidence"]:
            if n < warm:
                seen = [*seen[-history + 1 :], 1 - c]
            n += 1
            s = max(0.0, s + (1 - c) - base)
            if n == warm:
                base, s, seen = float(np.mean(seen)), 0.0, []
            hit = s > limit
            sums.append(s)
            fired.append(hit)
            s = 0.0 if hit else s
        return rows[names].assign(drift_sum=sums, drifted=fired), [min(n, warm), s, base, *seen]

    fresh = [0.0, 0.0, baseline]
    if span is None:
        given = df.groupBy(*keys)
        return given.applyInPandas(lambda rows: fold(rows.sort_values("idx", kind="stable"), fresh)[0], schema)
    # the baseline of a run is known from its first values
    heads = df.withColumn("__n", F.row_number().over(by_run(df))).where(F.col("__n") <= warm)
    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    warmed = heads.groupBy(*keys).applyInPandas(lambda rows: pd.DataFrame([(*rows[keys].iloc[0].tolist(), fold(rows.sort_values("idx", kind="stable"), fresh)[1])], columns=[*keys, "state"]), f"{kinds}state array<double>")
    return folded(df, keys, "idx", span, fold, fresh, schema, warmed)[0]


def hampel_flags(x: np.ndarray, radius: int, sigmas: float, scale: float, flagged: np.ndarray | None = None) -> np.ndarray:
    """Outliers by median and MAD of the values around that are not flagged yet; flags count for the windows after them."""
    values, bad = x.tolist(), [False] * len(x) if flagged is None else flagged.tolist()

    def median(v: list[float]) -> float:
        v.sort()
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2

    for i, v in enumerate(values):
        lo, hi = max(0, i - radius), i + radius + 1
        near = [y for y, b in zip(values[lo:hi], bad[lo:hi]) if not b]
        if not near or bad[i] or math.isnan(sum(near)):  # next to a value that is no number nothing is told
            continue
        middle = median(near)
        mad = median([abs(y - middle) for y in near])
        bad[i] = mad > 0 and abs(v - middle) > sigmas * scale * mad
    return np.array(bad, bool)


def hampel(df: DataFrame, radius: int, sigmas: float, scale: float = 1.4826, physical: tuple[float, float] | None = None) -> DataFrame:
    """df with flagged; values outside the physical range are flagged first."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows["frq"].to_numpy(float)
        first = (x < physical[0]) | (x > physical[1]) if physical else None
        return rows.assign(flagged=hampel_flags(x, radius, sigmas, scale, first))

    return _folded(df, "flagged boolean", fold)


def interpolated(df: DataFrame, flag: str = "flagged") -> DataFrame:
    """df with clean: flagged values replaced on the line between the nearest good ones; at the ends, by the nearest."""
    w = by_run(df)
    good = F.when(~F.col(flag), F.struct("idx", "frq"))
    left = F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # the next good one is the last one from the other end: a frame that shrinks would be gone through again for each row
    right = F.last(good, ignorenulls=True).over(by_run(df, F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0))
    both = df.withColumn("__l", left).withColumn("__r", right)
    line = F.col("__l.frq") + (F.col("__r.frq") - F.col("__l.frq")) * F.try_divide(F.col("idx") - F.col("__l.idx"), F.col("__r.idx") - F.col("__l.idx"))
    return both.withColumn("clean", F.when(~F.col(flag), F.col("frq")).otherwise(F.coalesce(line, F.col("__l.frq"), F.col("__r.frq"), F.col("frq")))).drop("__l", "__r")


def cleaned(df: DataFrame, radius: int = Enf.hampel_radius, sigmas: float = Enf.hampel_sigmas, physical: tuple[float, float] = Enf.physical_hz) -> DataFrame:
    """df with frq cleaned and flagged: values outside the physical range and outliers, replaced on the line between good ones."""
    return interpolated(hampel(df, radius, sigmas, physical=physical)).withColumn("frq", F.col("clean")).drop("clean")


def butterworth(order: int, cutoff: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections of a low-pass, by the bilinear transform; cutoff as a share of the sampling rate."""
    k = np.tan(np.pi * cutoff)
    out = []
    for i in range(order // 2):
        q = 2 * np.sin(np.pi * (2 * i + 1) / (2 * order))
        a0 = 1 + q * k + k * k
        out.append((np.array([1.0, 2.0, 1.0]) * k * k / a0, np.array([1.0, 2 * (k * k - 1) / a0, (1 - q * k + k * k) / a0])))
    if order % 2:
        out.append((np.array([k, k, 0.0]) / (1 + k), np.array([1.0, (k - 1) / (1 + k), 0.0])))
    return out


def _pass(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One direction; each section starts in its steady state for the first value."""
    values = x.tolist()
    for b, a in sections:
        (b0, b1, b2), (_, a1, a2) = b.tolist(), a.tolist()
        gain = float(b.sum() / a.sum())
        z1, z2, out = (gain - b0) * values[0], (b2 - a2 * gain) * values[0], []
        for v in values:
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            out.append(y)
        values = out
    return np.array(values)


def lowpass(x: np.ndarray, order: int, cutoff: float, pad: int = 33) -> np.ndarray:
    """Zero-phase: forwards and backwards over the series, extended by its mirror image through its ends."""
    pad = min(pad, len(x) - 1)
    if pad < 1:
        return x
    ends = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    sections = butterworth(order, cutoff)
    return _pass(_pass(ends, sections)[::-1], sections)[::-1][pad : pad + len(x)]


def smoothed(df: DataFrame, radius: int = 11, sigmas: float = 2.0, order: int = 10, cutoff_hz: float = 0.02, rate_hz: float = 0.5, nominal: float = 60.0) -> DataFrame:
    """df with smooth: Hampel, interpolation and a low-pass on the deviation from nominal. It belongs before any attack."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows["frq"].to_numpy(float)
        bad = hampel_flags(x, radius, sigmas, 1.4826)
        at = np.arange(len(x))
        x = np.interp(at, at[~bad], x[~bad]) if (~bad).any() else x
        return rows.assign(smooth=nominal + lowpass(x - nominal, order, cutoff_hz / rate_hz))

    return _folded(df, "smooth double", fold)


def nominal_range(df: DataFrame, tolerance: float, nominal: float = 60.0) -> DataFrame:
    """df with status_rank: 2 where the frequency is further than `tolerance` from nominal, else 0."""
    return df.withColumn("status_rank", F.when(F.abs(F.col("frq") - nominal) > tolerance, 2).otherwise(0))


def verdict(confidence: Column, frq: Column, flat: Column, nominal: float, tolerance: float, trusted: float, suspect: float) -> Column:
    """status_rank by nominal range, flat signature, continuity, and the soft tier, which only applies where all else is trusted."""
    failed = (F.abs(frq - nominal) > tolerance) | flat | (confidence < suspect)
    return F.when(failed, 2).when(confidence < trusted, 1).otherwise(0)
