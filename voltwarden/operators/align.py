"""Aligning raw readings into frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spans import positions


def tumbling(df: DataFrame, per: int, keys: list[str], values: list[str], order: str = "idx", span: int | None = None) -> DataFrame:
    """keys, frame and the means of `values` over each `per` rows by position, the last rest included; with `span`, a series is counted in parts of so many of `order`."""
    df = positions(df, keys, order, span, "__pos") if span else df.withColumn("__pos", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    return df.withColumn("frame", F.floor(F.col("__pos") / per).cast("long")).groupBy(*keys, "frame").agg(*[F.avg(v).alias(v) for v in values])


def filled(df: DataFrame, keys: list[str], length: int | None, order: str = "frame", value: str = "value") -> DataFrame:
    """keys, order, value for each place below `length` (None: up to the last of all keys): the last value carried on; places before the first have none."""
    if length is None:
        ends = df.agg(F.max(order).cast("long").alias("__last"))
        series = df.select(*keys).distinct().crossJoin(F.broadcast(ends))  # one row
    else:
        series = df.select(*keys).distinct().withColumn("__last", F.lit(length - 1).cast("long"))
    spine = series.withColumn(order, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last")))).drop("__last")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    both = spine.join(df.select(*keys, order, value), [*keys, order], "left")
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where(F.col(value).isNotNull())


def trimmed(df: DataFrame, keys: list[str], order: str = "frame") -> DataFrame:
    """df up to the last place that every key has."""
    ends = df.groupBy(*keys).agg(F.max(order).alias("__end")).agg(F.min("__end").alias("__end"))
    return df.crossJoin(F.broadcast(ends)).where(F.col(order) <= F.col("__end")).drop("__end")  # one row


def combined(enf: DataFrame, long: DataFrame) -> DataFrame:
    """Frames of frequency and channels that both have."""
    return long.join(enf, "idx")


def wide_frames(enf: DataFrame, wide: DataFrame) -> DataFrame:
    return enf.select(F.col("idx").alias("index"), F.col("frq").alias("FRQ")).join(wide, "index")
