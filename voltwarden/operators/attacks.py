"""Labelled perturbations. Each takes rows of idx, a target flag and a value, and gives them with `attacked` and `label`.

Nothing is random unless a seed says so, so a run can be repeated.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Half the width of absolute_jitter where none is given.
JITTER = 0.5


def bounds(n: int, start_share: float, end_share: float) -> tuple[int, int]:
    """The attack's frames, half open."""
    return int(n * start_share), int(n * end_share)


def condition(value: Column, kind: str | None, limit: float | None) -> Column:
    """Whether a value is to be changed: under, below, over, above a limit; without a condition, always; unknown ones never."""
    if kind is None:
        return F.lit(True)
    if kind in ("under", "below"):
        return value < limit
    return value > limit if kind in ("over", "above") else F.lit(False)


def inside(start: int, end: int) -> Column:
    return (F.col("idx") >= start) & (F.col("idx") < end)


def labelled(df: DataFrame, new: Column, hit: Column) -> DataFrame:
    hit = F.coalesce(hit & F.col("target"), F.lit(False))
    return df.withColumn("attacked", F.when(hit, new).otherwise(F.col("value"))).withColumn("label", hit.cast("int"))


def none(df: DataFrame) -> DataFrame:
    return df.withColumn("attacked", F.col("value")).withColumn("label", F.lit(0))


def inject(df: DataFrame, start: int, end: int, mode: str, by: float, jitter: float = JITTER, seed: int = 0, only: tuple[str, float] | None = None) -> DataFrame:
    """bias: value + by; scale: value * by; absolute: by; absolute_jitter: by + U(-jitter, jitter)."""
    v = F.col("value")
    new = {"bias": v + by, "scale": v * by, "absolute": F.lit(float(by)), "absolute_jitter": by + (uniform_draw(seed, *[c for c in ("run_id", "idx", "node_id", "channel") if c in df.columns]) * 2 - 1) * jitter}[mode]
    return labelled(df, new, inside(start, end) & condition(v, *(only or (None, None))))


def drift(df: DataFrame, start: int, end: int, mode: str, most: float, only: tuple[str, float] | None = None) -> DataFrame:
    """additive: value + most * f; multiplicative: value * (1 + most * f); f grows from 0 over the attack's frames."""
    f = (F.col("idx") - start) / F.lit(float(max(1, end - start)))
    v = F.col("value")
    new = v + most * f if mode == "additive" else v * (1 + most * f)
    return labelled(df, new, inside(start, end) & condition(v, *(only or (None, None))))


def replay(df: DataFrame, keys: list[str], start: int, end: int, source: int, length: int, only: tuple[str, float] | None = None) -> DataFrame:
    """Values of frame source + ((idx - start) mod length) of the same key, where there are any."""
    old = df.select(*keys, F.col("idx").alias("__from"), F.col("value").alias("__old")).where(F.col("__from").between(source, source + length - 1))
    src = F.when(inside(start, end), source + F.pmod(F.col("idx") - start, F.lit(length)))
    both = df.withColumn("__from", src).join(old, [*keys, "__from"], "left")
    out = labelled(both, F.col("__old"), inside(start, end) & F.col("__old").isNotNull() & condition(F.col("value"), *(only or (None, None))))
    return out.drop("__from", "__old")


def layer_labels(cells: DataFrame) -> DataFrame:
    """idx, layer, truth: attack (any cell), ENF and each node; cells: idx, node_id (null: ENF), label."""
    nodes = cells.groupBy("idx", F.coalesce("node_id", F.lit("ENF")).alias("layer")).agg(F.max("label").alias("truth"))
    return nodes.unionByName(cells.groupBy("idx").agg(F.max("label").alias("truth")).withColumn("layer", F.lit("Global")))


def profile(enf: DataFrame, before: int) -> DataFrame:
    """mean, noise (RMS of first differences) and phi (AR(1), within 0.99) of the rows before an attack; with fewer than 5, defaults. With run_id, a row a run."""
    from .enf import by_run

    w, keys = by_run(enf), [c for c in ["run_id"] if c in enf.columns]
    rows = enf.where(F.col("idx") < before).withColumn("__d", F.col("frq") - F.lag("frq").over(w))
    mean = rows.groupBy(*keys).agg(F.avg("frq").alias("m"))
    rows = (rows.join(mean, keys) if keys else rows.crossJoin(F.broadcast(mean))).withColumn("__x", F.col("frq") - F.col("m"))  # one row
    rows = rows.withColumn("__p", F.lag("__x").over(by_run(rows)))
    phi = F.try_divide(F.sum(F.col("__x") * F.col("__p")), F.sum(F.when(F.col("__x").isNotNull(), F.col("__p") * F.col("__p"))))
    some = F.count("*") >= 5
    return rows.groupBy(*keys).agg(
        F.when(some, F.avg("frq")).otherwise(60.0).alias("mean"),
        F.when(some, F.sqrt(F.avg(F.col("__d") * F.col("__d")))).otherwise(0.005).alias("noise"),
        F.when(some, F.greatest(F.least(F.coalesce(phi, F.lit(0.0)), F.lit(0.99)), F.lit(-0.99))).otherwise(0.95).alias("phi"),
    )


def tracked(df: DataFrame, start: int, end: int, phi: float | str, mode: str, by: float, clamp: float = 0.01, noise: str = "noise", hit: str | None = None) -> DataFrame:
    """An attack on the frequency that stays close to it: AR(1) steps on the live value, clamped, then changed as inject() or drift() would; the changed value is fed back.

    `noise` is a column of given draws, so the fold over each run is deterministic. `phi` may be a column, one value a
    run. Rows whose column `hit` is not true stay as they are. Absolute modes give the step alone.
    """
    from .enf import _folded

    changes = {"bias": lambda v, f: v + by, "scale": lambda v, f: v * by, "additive": lambda v, f: v + by * f, "multiplicative": lambda v, f: v * (1 + by * f)}
    change = changes[mode] if mode in changes else {"absolute": lambda v, f: v, "absolute_jitter": lambda v, f: v}[mode]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        last, out, labels = None, [], []
        phis = rows[phi] if isinstance(phi, str) else [phi] * len(rows)
        on = rows[hit] if hit else [True] * len(rows)
        for i, live, e, p, h in zip(rows["idx"], rows["frq"], rows[noise], phis, on):
            attack = start <= i < end and h is not None and bool(h)
            labels.append(int(attack))
            if attack:
                before = live if last is None else last
                last = change(live + min(clamp, max(-clamp, p * (before - live) + e)), (i - start) / max(1, end - start))
                out.append(last)
            else:
                out.append(live)
        return rows.assign(attacked=out, label=labels)

    return _folded(df, "attacked double, label int", fold)


def uniform_draw(seed: int, *at: str) -> Column:
    """A draw from 0 to 1 a row, by the hash of its place and a seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *at), F.lit(1 << 52)) / float(1 << 52)


def normal_draws(seed: int, *at: str) -> Column:
    """A standard normal draw a row, by the hash of its place and a seed."""
    u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *at), F.lit(1 << 52)) + 1) / float((1 << 52) + 1) for i in (1, 2)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


def on_frequency(df: DataFrame, start: int, end: int, mode: str, by: float, only: tuple[str, float] | None = None, seed: int = 0) -> DataFrame:
    """inject() or drift() of the frequency's rows (idx, target, value; run_id where there are runs): tracked, by the profile of the rows before the attack."""
    keys = [c for c in ["run_id"] if c in df.columns]
    rows = df.withColumn("frq", F.col("value").cast("double"))
    seen = profile(rows.select(*keys, "idx", "frq").where(F.col("frq").isNotNull()), start)
    seen = seen.select(*keys, F.col("noise").alias("__noise"), F.col("phi").alias("__phi"))
    rows = rows.join(seen, keys, "left") if keys else rows.crossJoin(F.broadcast(seen))  # one row
    # a run without rows before the attack has the defaults of profile()
    rows = rows.withColumn("__noise", normal_draws(seed, *keys, "idx") * F.coalesce("__noise", F.lit(0.005)) * 0.5).withColumn("__phi", F.coalesce("__phi", F.lit(0.95)))
    rows = rows.withColumn("__hit", F.coalesce(F.col("target") & F.col("frq").isNotNull() & condition(F.col("frq"), *(only or (None, None))), F.lit(False)))
    return tracked(rows, start, end, "__phi", mode, by, noise="__noise", hit="__hit").select(*df.columns, "attacked", "label")


#: Presets by id. Engine, targets, shares of the timeline where it starts and ends, and its parameters.
SCENARIOS = {
    "201": ("injection", "gpus", 0.30, 0.70, {"type": "bias", "value": 25.0}),
    "202": ("drift", "frq", 0.20, 0.60, {"type": "additive", "max_value": 0.06}),
    "203": ("injection", "cpus", 0.15, 0.85, {"type": "scale", "value": 1.15}),
    "204": ("injection", "frq", 0.40, 0.80, {"type": "bias", "value": 0.05}),
    "205": ("injection", "frq", 0.25, 0.75, {"type": "bias", "value": -0.2}),
    "301": ("drift", "cpus", 0.10, 0.90, {"type": "additive", "max_value": 0.02}),
    "302": ("injection", "frq", 0.30, 0.70, {"type": "scale", "value": 1.0008}),
    "303": ("replay", "gpu_watts", 0.20, 0.80, {"source_start_pct": 0.01, "condition_type": "above", "condition_val": 450.0}),
    "304": ("drift", "frq", 0.15, 0.85, {"type": "additive", "max_value": -0.03}),
    "305": ("replay", "all", 0.40, 0.60, {"source_start_pct": 0.02, "source_end_pct": 0.22}),
}
#: Manual modes: none, extreme, replay, injection, drift; over 10 to 60 % of the timeline.
EASY = {
    0: ("none", {}),
    1: ("injection", {"type": "absolute", "value": 0.0}),
    2: ("replay", {"source_start_pct": 0.01}),
    3: ("injection", {"type": "bias", "value": 10.0}),
    4: ("drift", {"type": "additive", "max_value": 50.0}),
}
#: The shares of the timeline that they cover.
EASY_SPAN = (0.10, 0.60)


def pool(difficulty: int, grid: bool) -> list[str]:
    """The presets of a difficulty (2, 3) that aim at the grid's frequency, or at nodes; all of them where there is none."""
    own = [k for k in SCENARIOS if k.startswith(str(difficulty))]
    return [k for k in own if (SCENARIOS[k][1] in ("frq", "all")) == grid] or own


def perturb(df: DataFrame, keys: list[str], n: int, engine: str, start: float, end: float, params: dict, frequency: Column | None = None, seed: int = 0) -> DataFrame:
    """An engine over frames start * n to end * n of df (keys, idx, target, value), by parameters as SCENARIOS has them.

    Injection and drift track the rows that are the `frequency`.
    """
    lo, hi = bounds(n, start, end)
    only = (params["condition_type"], params["condition_val"]) if params.get("condition_type") else None
    if frequency is not None and engine in ("injection", "drift"):
        own = F.coalesce(frequency, F.lit(False))
        by = params["value"] if engine == "injection" else params["max_value"]
        rest = perturb(df.where(~own), keys, n, engine, start, end, params, seed=seed)
        return rest.unionByName(on_frequency(df.where(own), lo, hi, params["type"], by, only, seed))
    if engine == "injection":
        return inject(df, lo, hi, params["type"], params["value"], params.get("jitter", JITTER), seed, only)
    if engine == "drift":
        return drift(df, lo, hi, params["type"], params["max_value"], only=only)
    if engine == "replay":
        first = int(n * params["source_start_pct"])
        length = int(n * min(1.0, params.get("source_end_pct", params["source_start_pct"] + 0.05))) - first
        return replay(df, keys, lo, hi, first, max(1, length), only=only)
    return none(df)


def easy(df: DataFrame, keys: list[str], name: Column, n: int, mode: int, group: str = "all", params: dict | None = None, seed: int = 0) -> DataFrame:
    """A manual mode of EASY over df (keys, idx, value) on a group of targets; `params` take the place of the mode's own."""
    from ..functions.channels import target_group

    engine, own = EASY[mode]
    return perturb(df.withColumn("target", target_group(name, group)), keys, n, engine, *EASY_SPAN, {**own, **(params or {})}, name == "FRQ", seed)


def scenario(df: DataFrame, keys: list[str], name: Column, n: int, which: str, seed: int = 0) -> DataFrame:
    """A preset over df (keys, idx, value), whose channels are called `name`."""
    from ..functions.channels import target_group

    engine, group, start, end, params = SCENARIOS[which]
    return perturb(df.withColumn("target", target_group(name, group)), keys, n, engine, start, end, params, name == "FRQ", seed)


def output(attacked: DataFrame) -> DataFrame:
    """value as attack files hold it: attacked cells rounded (counters to 1 place, others but the frequency to 4), all others as they were."""
    name = F.col("channel")
    places = F.when(name.endswith("[uJ]"), F.bround("attacked", 1)).when(name == "FRQ", F.col("attacked")).otherwise(F.bround("attacked", 4))
    return attacked.withColumn("value", F.when(F.col("label") == 1, places).otherwise(F.col("value"))).drop("attacked")
