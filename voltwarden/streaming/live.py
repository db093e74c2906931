"""Streams of recorded frames, forked to several sinks, and alert sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def frames(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """Recorded frames as a stream, some files a trigger; pace it with trigger(processingTime="2 seconds")."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def fork(stream: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None]):
    """The same rows to each sink, from one pass over each batch.

    A ledger beside the checkpoint holds which sinks are done with which batch. A batch that is run again after a failure
    goes only to those that are not, under its number: a sink must put a batch in place of what it left of it before.
    """
    spark = stream.sparkSession

    def record(sink: int, batch_id: int):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/ledger/{sink}/{batch_id}")
        return place.getFileSystem(spark._jsc.hadoopConfiguration()), place

    def each(batch: DataFrame, batch_id: int) -> None:
        open_ones = [(k, sink, *record(k, batch_id)) for k, sink in enumerate(sinks)]
        open_ones = [(k, sink, fs, place) for k, sink, fs, place in open_ones if not fs.exists(place)]
        if not open_ones:
            return
        batch.persist()
        try:
            for k, sink, fs, place in open_ones:
                sink(batch, batch_id)
                fs.create(place, True).close()
                old = record(k, batch_id - KEPT)[1]
                fs.delete(old, False)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


#: Batches that a ledger holds; only the last can be run again.
KEPT = 100


def sessions(stream: DataFrame, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """severity, start, end, nodes, polls: alerts (ts, severity, node_id) in sessions that a longer gap ends."""
    window = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(window, "severity").agg(F.size(F.collect_set("node_id")).alias("nodes"), F.count("*").alias("polls")).select("severity", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "nodes", "polls")
