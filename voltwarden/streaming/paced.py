"""Recorded frames as a stream at the pace of the recording.

The offset is the frame that the clock has reached. A poll that comes late goes on with the frame that is due and skips those
before it; one that comes before the next frame is due, or after the last, gives nothing. A restarted stream goes on from
its offset, whatever time has passed.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

CADENCE_S = 2.0


def due(elapsed_s: float, cadence_s: float = CADENCE_S) -> int:
    """The frame that a poll shows."""
    return int(elapsed_s / cadence_s)


class Frame(InputPartition):
    def __init__(self, index: int):
        self.index = index


class Reader(DataSourceStreamReader):
    def __init__(self, schema, options: dict, clock=time.time):
        self.schema, self.path, self.clock = schema, options["path"], clock
        self.cadence, self.frames = float(options.get("cadence", CADENCE_S)), int(options["frames"])
        self.began, self.reached = None, 0

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        if self.began is None:  # the frame that is next is due now
            self.began = self.clock() - self.reached * self.cadence
        self.reached = max(self.reached, min(due(self.clock() - self.began, self.cadence) + 1, self.frames))
        return {"next": self.reached}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.reached < end["next"]:  # after a restart
            self.reached, self.began = end["next"], None
        return [Frame(end["next"] - 1)] if end["next"] > start["next"] else []

    def read(self, partition: Frame) -> Iterator[pa.RecordBatch]:
        """The rows of one frame; the recording's `idx` is its number."""
        names = [f.name for f in self.schema.fields]
        rows = ds.dataset(self.path, format="parquet").to_table(columns=names, filter=ds.field("idx") == partition.index)
        yield from rows.cast(to_arrow_schema(self.schema)).to_batches()

    def commit(self, end: dict) -> None:
        pass


class PacedFrames(DataSource):
    """spark.dataSource.register(PacedFrames); spark.readStream.format("paced").schema(...).options(path=..., frames=..., cadence=2).load()

    path: a Parquet recording with a column idx that pyarrow opens from executors; frames: how many it has.
    """

    @classmethod
    def name(cls) -> str:
        return "paced"

    def streamReader(self, schema) -> Reader:
        return Reader(schema, self.options)
