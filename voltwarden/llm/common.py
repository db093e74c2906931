"""What the corpus operators share: the cluster's shared folder, written tables, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes about, that Python works on at once. What Spark hands over is bounded so while a table is written, and
#: sliced in Python wherever it is larger.
BATCH_ROWS, BATCH_BYTES = 1024, 1 << 22
#: Paths made inside each open scope().
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    In local mode, where every folder is shared, an own one is made if that is unset; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="voltwarden-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; what stands there goes when the innermost scope() ends, or, if it is to be kept, the one around that."""
    path = f"{shared_dir(spark)}/voltwarden/{name}-{uuid.uuid4().hex}"
    if _scopes[: -1 if keep else None]:
        _scopes[-2 if keep else -1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside on leaving; what is written with keep=True goes with the scope around it, or stays."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds the Arrow batches of the jobs run inside, and sets the session back on leaving."""
    least = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {key: spark.conf.get(key) for key in least}
    for key, value in least.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, name, keep)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(nullable(df.schema)).parquet(path)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, fewer where rows are long."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * BATCH_BYTES // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def arrow_rows(schema: pa.Schema, rows: Iterable[tuple]) -> pa.RecordBatch:
    """A record batch of row tuples."""
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def texts_of(batches: Iterator[pa.RecordBatch], text: str, *others: str) -> Iterator[tuple[list, ...]]:
    """The text column (None: as it is) and other columns of each batch as lists."""
    for b in slices(batches):
        yield tuple(b.column(b.schema.get_field_index(c)).to_pylist() for c in (text, *others))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_of(df: DataFrame, by: list[str], most: int, keys: list[str]) -> DataFrame:
    """The `most` rows of each `keys` that come first in the order `by`.

    Each task keeps its own first rows before they meet, so a group of any size, also one of rows that are alike, sends a few.
    """
    task, place = fresh(df, "task", "place")
    df = df.withColumn(task, F.spark_partition_id())
    for more in ([task], []):
        df = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys, *more).orderBy(*by))).where(F.col(place) <= most).drop(place)
    return df.drop(task)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of df's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        own = f"__{name}"
        while own.lower() in taken:
            own = "_" + own
        taken.add(own.lower())
        out.append(own)
    return out


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def clear(spark: SparkSession) -> None:
    """Deletes what written() and shared_path() left in the shared folder. Results that still read it must be stored before."""
    delete(spark, f"{shared_dir(spark)}/voltwarden")
