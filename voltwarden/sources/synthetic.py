"""Seeded fixtures: power by workload, a wandering frequency, an alternative stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The lowest and highest watts of each class of workload.
ENVELOPE = {"idle": (90.0, 130.0), "llm_inference": (250.0, 600.0), "llm_training": (650.0, 780.0), "image_generation": (300.0, 550.0)}


def power(spark: SparkSession, workload: str, node_id: str = "node_00", seconds: int = 120, hz: int = 5, seed: int = 0) -> DataFrame:
    """timestamp, node_id, power_w, workload_class: the class's shape with Gaussian noise of 8 W, never below 0.

    Training stays within 60 W below the envelope's top, in slow waves; inference is at its bottom with bursts to its top
    (18 in 100 samples); image generation sweeps over all of it; idle is up to 10 W over its bottom.
    """
    t = F.col("id") / float(hz)
    low, high = ENVELOPE[workload]
    shape = {
        "llm_training": high - 30 + 30 * F.sin(t / 8),
        "llm_inference": F.when(F.rand(seed + 1) < 0.18, high).otherwise(low),
        "image_generation": low + (high - low) * (0.5 + 0.5 * F.sin(t / 3)),
        "idle": low + 10 * F.rand(seed + 1),
    }[workload]
    watts = F.greatest(F.lit(0.0), shape + F.randn(seed) * 8)
    return spark.range(0, seconds * hz, 1, 1).select(t.alias("timestamp"), F.lit(node_id).alias("node_id"), watts.alias("power_w"), F.lit(workload).alias("workload_class"))


def frequency(spark: SparkSession, n: int, seed: int = 0, sigma: float = 0.003, pull: float = 0.02, nominal: float = 60.0) -> DataFrame:
    """idx, frq: a mean-reverting walk. x[t] = (1 - pull) x[t-1] + e[t] is a sum of past noise with falling weights, short enough for a frame."""
    keep = 1 - pull
    w = Window.orderBy("idx").rowsBetween(-600, 0)
    rows = spark.range(0, n, 1, 1).select(F.col("id").alias("idx"), (F.randn(seed) * sigma).alias("e"))
    near = F.collect_list("e").over(w)
    walk = F.aggregate(near, F.lit(0.0), lambda s, e: s * keep + e)
    return rows.withColumn("frq", nominal + walk).select("idx", "frq")


def alternative(enf: DataFrame, seed: int, noise: float = 1e-4) -> DataFrame:
    """enf with alt, measured apart; make it before any attack and keep it as a table."""
    return enf.withColumn("alt", F.col("frq") + F.randn(seed) * noise)
