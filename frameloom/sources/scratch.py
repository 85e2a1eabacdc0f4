"""Places in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A path below ``spark.checkpoint.dir`` that no other run uses; only a local master may leave the setting out."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: this needs a folder that all executors share")
    return f"{(base or 'file:///tmp/checkpoints/frameloom').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a table in the shared folder, read again; ``release`` deletes it."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more; other tables stay."""
    for df in tables:
        if path := getattr(df, "written_at", None):
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def filesystem(uri: str):
    """(pyarrow filesystem, path in it) of a uri such as file:///x or hdfs://host/x."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
