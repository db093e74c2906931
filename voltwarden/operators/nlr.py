"""Checks of node telemetry in long form: run_id?, idx, node_id, channel, value.

Each check gives its input's keys with status_rank (0 trusted, 1 suspect, 2 failed), code, observed and limit. A series is
a channel of a node (of a run); its checks share one window, so together they sort each series once. A check that stays
silent gives no row there.

A series is scanned in one task, or, with `span`, in parts of so many idx, each in a task of its own; the rows are the same.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .spans import earlier, overlapping, positions
from .stretches import folded

SERIES = ["node_id", "channel"]


def keys_of(df: DataFrame) -> list[str]:
    return [c for c in ["run_id"] if c in df.columns] + SERIES


def series(df: DataFrame, keys: list[str] | None = None) -> WindowSpec:
    """The window of a series in idx order; a run is part of it where there is one."""
    keys = keys or SERIES
    return Window.partitionBy(*[c for c in ["run_id"] if c in df.columns and c not in keys], *keys).orderBy("idx")


def result(df: DataFrame, failed: Column, code: str, observed: Column, limit: float, keep: Column | None = None) -> DataFrame:
    own = [c for c in df.columns if c in ("run_id", "idx", "node_id", "channel", "kind", "value")]
    rows = df if keep is None else df.where(keep)
    bad = F.coalesce(failed, F.lit(False))
    return rows.select(*own, F.when(bad, 2).otherwise(0).alias("status_rank"), F.when(bad, code).otherwise("ok").alias("code"), observed.alias("observed"), F.lit(float(limit)).alias("limit"))


def value_range(df: DataFrame, low: float, high: float, low_fails: bool = False) -> DataFrame:
    """OUT OF RANGE: below low (or at it), or above high."""
    v = F.col("value")
    return result(df, ((v <= low) if low_fails else (v < low)) | (v > high), "OUT OF RANGE", v, high)


def with_before(df: DataFrame, span: int | None = None) -> DataFrame:
    """df with __before, the value of the row before in the series."""
    if span is None:
        return df.withColumn("__before", F.lag("value").over(series(df)))
    return earlier(df, keys_of(df), "idx", span, last={"__last": F.struct("value")}).withColumn("__before", F.col("__last.value")).drop("__last")


def continuity(df: DataFrame, step: float, span: int | None = None) -> DataFrame:
    """DISCONTINUITY: a step of more than `step` from the last value that the series had."""
    df = with_before(df, span)
    moved = F.abs(F.col("value") - F.col("__before"))
    return result(df, moved > step, "DISCONTINUITY", moved, step)


def unwrapped(df: DataFrame, ceiling: float, tolerance: float, span: int | None = None) -> DataFrame:
    """df with `unwrapped`: a counter that goes on where it wrapped, by a ceiling for each fall of more than the tolerance."""
    marked = with_before(df, span).withColumn("__fell", F.when(F.col("value") < F.col("__before") - tolerance, 1).otherwise(0))
    if span is None:
        falls = marked.withColumn("__falls", F.sum("__fell").over(series(df).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        falls = earlier(marked, keys_of(df), "idx", span, sums={"__falls": F.col("__fell")}).withColumn("__falls", F.col("__falls") + F.col("__fell"))
    return falls.withColumn("unwrapped", F.col("value") + ceiling * F.col("__falls")).drop("__fell", "__falls", "__before")


def monotonicity(df: DataFrame, ceiling: float, tolerance: float, step: float, span: int | None = None) -> DataFrame:
    """MONOTONICITY VIOLATION: below the running maximum since the last wrap; ENERGY SPIKE: a rise of more than `step`.

    A fall of nearly the ceiling is a wrap, which starts a new epoch.
    """
    epochs = with_before(df, span)
    epochs = epochs.withColumn("__wrap", F.when(F.abs(F.col("__before") - F.col("value") - ceiling) <= tolerance, 1).otherwise(0))
    if span is None:
        epochs = epochs.withColumn("__epoch", F.sum("__wrap").over(series(df).rowsBetween(Window.unboundedPreceding, 0)))
        high = epochs.withColumn("__most", F.max("value").over(series(df, [*SERIES, "__epoch"]).rowsBetween(Window.unboundedPreceding, -1)))
    else:
        epochs = earlier(epochs, keys_of(df), "idx", span, sums={"__epoch": F.col("__wrap")}).withColumn("__epoch", F.col("__epoch") + F.col("__wrap"))
        high = earlier(epochs, [*keys_of(df), "__epoch"], "idx", span, most={"__most": F.col("value")})
    v = F.col("value")
    back = F.coalesce(v < F.col("__most"), F.lit(False))
    spike = ~back & (F.col("__wrap") == 0) & F.coalesce(v - F.col("__before") > step, F.lit(False))
    own = [c for c in df.columns if c in ("run_id", "idx", "node_id", "channel", "kind", "value")]
    code = F.when(back, "MONOTONICITY VIOLATION").when(spike, "ENERGY SPIKE").otherwise("ok")
    return high.select(*own, F.when(back | spike, 2).otherwise(0).alias("status_rank"), code.alias("code"), F.when(back, F.col("__most") - v).otherwise(v - F.col("__before")).alias("observed"), F.lit(float(step)).alias("limit"))


def sibling_ratio(df: DataFrame, low: float, high: float, group: list[str] | None = None) -> DataFrame:
    """SIBLING MISMATCH: a value out of proportion to the median of its siblings, the other channels of its group and idx.

    Only failures are given; groups of one and medians of at most 1 say nothing.
    """
    keys = [*[c for c in ["run_id"] if c in df.columns], "idx", *(group or ["node_id"])]
    # siblings are few (a node's devices of a kind), so their values travel with each of them
    both = df.withColumn("__all", F.collect_list(F.struct("channel", "value")).over(Window.partitionBy(*keys)))
    others = F.array_sort(F.transform(F.filter("__all", lambda x: x["channel"] != F.col("channel")), lambda x: x["value"]))
    both = both.withColumn("__others", others).where(F.size("__others") > 0)
    n = F.size("__others")
    middle = (F.get("__others", F.floor((n - 1) / 2).cast("int")) + F.get("__others", F.floor(n / 2).cast("int"))) / 2
    both = both.withColumn("__median", middle).where("__median > 1").withColumn("__ratio", F.try_divide(F.col("value"), F.col("__median")))
    return result(both, F.lit(True), "SIBLING MISMATCH", F.col("__ratio"), high, (F.col("__ratio") < low) | (F.col("__ratio") > high))


def startup_ramp(df: DataFrame, low: float, high: float, deadline: int, run: int, frame: str = "frame", span: int | None = None) -> DataFrame:
    """STARTUP RAMP: from frame `deadline` on, until `run` values in a row lie in [low, high]; from then on trusted for good.

    `frame` counts the frames that a verifier has seen, the run counts the values that the series has.
    """
    w = series(df)
    inside = F.col("value").between(low, high)
    if span is not None:
        marked = positions(df, keys_of(df), "idx", span, "__pos").withColumn("__out", F.when(inside, None).otherwise(F.col("__pos")))
        marked = earlier(marked, keys_of(df), "idx", span, most={"__off": F.col("__out")})
        marked = marked.withColumn("__long", F.when(F.col("__out").isNull() & (F.col("__pos") - F.coalesce("__off", F.lit(-1)) >= run), 1).otherwise(0))
        marked = earlier(marked, keys_of(df), "idx", span, most={"__steady": F.col("__long")}).withColumn("__steady", F.greatest("__steady", "__long"))
        return result(marked, (F.col(frame) >= deadline) & (F.col("__steady") == 0), "STARTUP RAMP", F.col("value"), low)
    marked = df.withColumn("__out", F.when(inside, 0).otherwise(1)).withColumn("__pos", F.row_number().over(w))
    marked = marked.withColumn("__island", F.sum("__out").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("__long", F.when(F.sum(1 - F.col("__out")).over(series(df, [*SERIES, "__island"]).rowsBetween(Window.unboundedPreceding, 0)) >= run, 1).otherwise(0))
    marked = marked.withColumn("__steady", F.max("__long").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return result(marked, (F.col(frame) >= deadline) & (F.col("__steady") == 0), "STARTUP RAMP", F.col("value"), low)


def replay(df: DataFrame, gram: int, lookback: int, floor: float, run: int = 5, span: int | None = None) -> DataFrame:
    """REPLAY: the last `gram` values occurred before within `lookback` values, not overlapping; it clears on the `run`th value without such a match.

    Values are rounded to 4 places; those below the floor are left out and not buffered. A gram of one value repeated
    says nothing. Rows are given while the state is failed, and a trusted one where it clears.
    """
    keys = keys_of(df)
    kept = df.where(F.abs(F.col("value")) >= floor).withColumn("__v", F.round("value", 4))
    if span is None:
        kept = kept.withColumn("__pos", F.row_number().over(series(df)))
        near = keys
    else:  # what a part looks back on stands before it
        kept = overlapping(positions(kept, keys, "idx", span, "__pos"), "__pos", max(span, lookback), lookback).withColumn("__pos", F.col("__pos") + 1)
        near = [*keys, "part"]
    w = Window.partitionBy(*near).orderBy("__pos")
    kept = kept.withColumn("__gram", F.array(*[F.lag("__v", k).over(w) for k in range(gram - 1, -1, -1)]))
    varied = (F.col("__pos") >= gram) & (F.size(F.array_distinct("__gram")) >= 2)
    own = Window.partitionBy(*near, "__gram").orderBy("__pos").rangeBetween(-(lookback - gram), -gram)
    kept = kept.withColumn("__match", F.when(varied & (F.count(F.lit(1)).over(own) > 0), F.col("__pos")))
    if span is None:
        kept = kept.withColumn("__hit", F.max("__match").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        kept = earlier(kept.where("NOT ghost"), keys, "__pos", span, most={"__hit": F.col("__match")}).withColumn("__hit", F.greatest("__hit", "__match"))
    kept = kept.withColumn("__since", F.col("__pos") - F.col("__hit"))
    return result(kept, F.col("__since") < run, "REPLAY", F.col("__since").cast("double"), run, F.col("__since") <= run)


def sustained(df: DataFrame, step: float, band: float, quiet: int, run: int, frame: str = "frame", span: int | None = None) -> DataFrame:
    """SUSTAINED DEVIATION: after a step of more than `step` the series stays failed until it is back within `band` of the value before it, or has made `run` steps in a row within `step`.

    Nothing happens in the first `quiet` frames. Where the state ends is known only from what was stored at its start, so a
    series is folded in order, or in stretches of `span` idx at once; a row is given while the state holds, and a trusted
    one where it ends.
    """
    keys = keys_of(df)
    own = [c for c in ["run_id", "idx", "node_id", "channel", "value"] if c in df.columns]

    def fold(rows: pd.DataFrame, state: list[float]) -> tuple[pd.DataFrame, list[float]]:
        out, (stuck, start, calm) = [], state
        for i, v, n, before in zip(rows.index, rows["value"], rows[frame], rows["__before"]):
            known = before is not None and before == before
            moved = abs(v - before) if known else 0.0
            if n >= quiet:
                if stuck:
                    calm = calm + 1 if moved <= step else 0
                    stuck = not (abs(v - start) <= band or calm >= run)
                    out.append((i, 2 if stuck else 0, abs(v - start)))
                elif known and moved > step:
                    stuck, start, calm = True, before, 0
                    out.append((i, 2, moved))
        at = [i for i, _, _ in out]
        states = [r for _, r, _ in out]
        found = {c: rows.loc[at, c].tolist() for c in own}
        told = pd.DataFrame(found | {"status_rank": states, "code": ["SUSTAINED DEVIATION" if r else "ok" for r in states], "observed": [float(x) for _, _, x in out], "limit": [float(band)] * len(out)}, dtype=object)
        # what a state that doesn't hold once was is of no matter
        return told, [1.0, float(start), float(calm)] if stuck else [0.0, 0.0, 0.0]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*own).schema.fields) + ", status_rank int, code string, observed double, limit double"
    rows = with_before(df.select(*own, frame), span)
    if span is not None:
        return folded(rows, keys, "idx", span, fold, [0.0, 0.0, 0.0], schema)[0]
    return rows.groupBy(*keys).applyInPandas(lambda part: fold(part.sort_values("idx", kind="stable"), [0.0, 0.0, 0.0])[0], schema)
