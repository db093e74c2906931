"""The verifier's checks as streams, run over the driver's tables to their end, with the SQL of their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import SQL_FRAMES, query
from .catalog_verify import _SQL_GRID, _SQL_NODES, GRID, NODES, recorded
from .sources import scratch
from .streaming import checks


def _in_turn(df: DataFrame, path: str, steps: int) -> None:
    """Writes df in `steps` appends by idx, so that a stream of the folder meets them in that order."""
    for k in range(steps):
        df.where(F.col("idx").between(400 * k // steps, 400 * (k + 1) // steps - 1)).write.mode("append").parquet(path)


def _through(spark: SparkSession, name: str, rows: DataFrame, build, steps: int = 3) -> DataFrame:
    """What a stream says of rows that are read back, some of each run at a time."""
    path = scratch.folder(spark, name)
    _in_turn(rows, f"{path}/in", steps)
    own = checks.session(spark, timers=False)
    files = max(1, len(own.read.parquet(f"{path}/in").inputFiles()) // steps)
    stream = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
    out = build(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query(f"""WITH RECURSIVE {SQL_FRAMES}, {_SQL_GRID}
SELECT run_id, idx, CASE WHEN len(codes) > 0 THEN 2 WHEN confidence < 0.1 THEN 1 ELSE 0 END AS status_rank, array_to_string(codes, ' | ') AS codes, round(confidence, 3) AS confidence FROM said""")
def stream_grid_checks(spark, sf_dir):
    """Every check of the frequency, keyed by run, over several micro-batches."""
    series, _ = recorded(spark, sf_dir)
    last = series.groupBy("run_id").agg(F.lit(400).cast("long").alias("end"))
    ends = last.select("run_id", F.lit(399).cast("long").alias("idx"), F.lit(None).cast("double").alias("frq"), F.lit(None).cast("double").alias("alt"), F.lit(None).cast("double").alias("ts"))
    rows = series.select("run_id", F.col("idx").cast("long").alias("idx"), "frq", "alt", "ts").unionByName(ends)
    told = _through(spark, "grid-checks", rows.repartition(4, "run_id"), lambda s: checks.grid_checks(s, GRID))
    return told.select("run_id", "idx", "status_rank", F.array_join("codes", " | ").alias("codes"), F.round("confidence", 3).alias("confidence"))


@query(f"WITH RECURSIVE {_SQL_NODES} SELECT run_id, idx, node_id, channel, ord AS check_ord, code FROM bad WHERE code <> 'SIBLING MISMATCH'")
def stream_node_checks(spark, sf_dir):
    """Every keyed check of nodes, keyed by run, node and channel, over several micro-batches; what fails is shown."""
    _, long = recorded(spark, sf_dir)
    frames = long.select("run_id", "idx").distinct().selectExpr("*", "row_number() OVER (PARTITION BY run_id ORDER BY idx) - 1 AS frame")
    rows = long.join(frames, ["run_id", "idx"]).select("run_id", "node_id", "channel", "kind", F.col("idx").cast("long").alias("idx"), F.col("frame").cast("long").alias("frame"), "value")
    rows = scratch.kept(rows, "numbered")  # each step reads them
    told = _through(spark, "node-checks", rows.repartition(4, "run_id", "node_id"), lambda s: checks.node_checks(s, NODES))
    return told.where("status_rank = 2").select("run_id", "idx", "node_id", "channel", "check_ord", "code")
