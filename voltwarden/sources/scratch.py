"""Files under names of their own in the folder that a cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; in local mode, where that is unset, in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="voltwarden-")
    return f"{base.rstrip('/')}/voltwarden/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own: what several scans need is computed once."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_texts(lines: DataFrame, path: str) -> str:
    """Writes lines (name, place, value) as one text file a name, in order of place, and gives the folder."""
    spark = lines.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    part = f"{path}/.parts"
    lines.repartition("name").sortWithinPartitions("name", "place").select("name", "value").write.partitionBy("name").text(part)
    place = jvm.org.apache.hadoop.fs.Path
    fs = place(part).getFileSystem(conf)
    for d in fs.listStatus(place(part)):  # a folder a name
        if not d.isDirectory():
            continue
        (file,) = [f.getPath() for f in fs.listStatus(d.getPath()) if f.getPath().getName().startswith("part-")]
        fs.rename(file, place(f"{path}/{d.getPath().getName().split('=', 1)[1]}"))
    fs.delete(place(part), True)
    return path
