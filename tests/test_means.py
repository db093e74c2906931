"""Means are rounded by what they are, not by the last bits that the order of a sum leaves."""

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from voltwarden import catalog

KINDS = ["click", "view", "signup", "purchase"]


def test_ties(spark, tmp_path):
    rng, rows, frq, temps = random.Random(5), [], {}, {}
    for idx in range(200):  # 16 readings whose mean ends in a 5 at the fifth place
        cents = [rng.randrange(100, 40_000) for _ in range(16)]
        cents[0] += (2 - sum(cents)) % 4
        rows += [(20 * idx + k, k % 4, KINDS[k // 4], c / 100) for k, c in enumerate(cents)]
        mean = (Decimal(sum(cents)) / 1600).quantize(Decimal("1.0000"), ROUND_HALF_UP)
        frq[idx] = 60 + (float(mean) - 50) / 1000
    for idx in range(200, 400):  # 3 readings whose mean is a multiple of 25
        a, b, whole = rng.randrange(100, 20_000), rng.randrange(100, 20_000), 25 * rng.randrange(8, 20)
        rows += [(20 * idx + k, 0, "error", c / 100) for k, c in enumerate((a, b, 300 * whole - a - b))]
        temps[idx] = whole + 10.0
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    series, long = catalog.catalog_verify.recorded(spark, str(tmp_path))
    assert {r["idx"]: r["frq"] for r in series.where("idx < 200").collect()} == frq
    assert {r["idx"]: r["value"] for r in long.where(F.col("kind") == "gpu_temp").collect()} == temps
