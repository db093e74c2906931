"""Folds with feedback along one long series, in stretches that are folded at once from a guess.

Each stretch is folded from a guessed state. Where a stretch ends in another state than the next one began with, the next is
folded again from that, until none differs. States that are forgotten soon (a sum that returns to 0, a deviation that ends)
settle in two or three rounds; in the worst case there are as many rounds as stretches, and the rows are right all the same:
those of one fold over the whole series, to the bit.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

#: What folds the rows of a stretch, in order, from a state: (rows of the result, state after it).
Fold = Callable[[pd.DataFrame, list[float]], tuple[pd.DataFrame, list[float]]]


def folded(df: DataFrame, keys: list[str], order: str, span: int, fold: Fold, guess: list[float], schema: str, later: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(what fold gives over each series of df, the number of rounds). guess: the state that a series begins with.

    later: keys and state, a better guess for all stretches of a series but its first.

    States hold no NaN. A task holds one stretch of `span` in `order`, and the table of states has a row a stretch.
    """
    own = [*keys, "__part"]
    rows = df.withColumn("__part", F.floor(F.col(order) / span).cast("long"))
    rows = scratch.kept(rows, "stretches")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema.fields)
    first = F.array(*[F.lit(float(x)) for x in guess]).cast("array<double>")
    before = Window.partitionBy(*keys).orderBy("__part")
    state = rows.select(*own).distinct().withColumn("entry", first)
    if later is not None:
        second = F.lag("__part").over(before).isNotNull()
        state = state.join(later.select(*keys, "state"), keys, "left").withColumn("entry", F.when(second, F.coalesce("state", first)).otherwise(first)).drop("state")
    state = state.withColumns({ "exit": F.lit(None).cast("array<double>"), "open": F.lit(True)})
    state, rounds = scratch.kept(state, "states"), 0

    def ended(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        return pd.DataFrame([(*part[own].iloc[0].tolist(), fold(part, list(part["entry"].iloc[0]))[1])], columns=[*own, "new"])

    while True:
        rounds += 1
        some = rows.join(state.where("open").select(*own, "entry"), own).groupBy(*own).applyInPandas(ended, f"{kinds}, new array<double>")
        both = state.join(some, own, "left").withColumn("exit", F.coalesce("new", "exit")).drop("new")
        both = both.withColumn("due", F.coalesce(F.lag("exit").over(before), first))
        state = scratch.kept(both.select(*own, F.col("due").alias("entry"), "exit", (F.col("due") != F.col("entry")).alias("open")), "states")
        if not state.where("open").limit(1).count():
            break

    def given(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        return fold(part, list(part["entry"].iloc[0]))[0]

    return rows.join(state.select(*own, "entry"), own).groupBy(*own).applyInPandas(given, schema), rounds
