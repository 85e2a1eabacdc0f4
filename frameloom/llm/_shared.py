"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/frameloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); only a local master may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    return (named or f"file://{LOCAL_CHECKPOINTS}").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it again.

    A lost executor then costs a re-read of files, not a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more; other tables stay."""
    for df in tables:
        path = getattr(df, "written_at", None)
        if path:
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


#: Bits of a bitmap: 8 MB at any size of the input.
BITMAP_BITS = 1 << 26


class Bitmap:
    """Whether a 64-bit hash may be among those that the bitmap was made of, by two bits of each; it may err by yes alone."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def _held(self, at: np.ndarray) -> np.ndarray:
        at = at & (BITMAP_BITS - 1)
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def hit(self, hashes: np.ndarray) -> np.ndarray:
        out = self._held(hashes)
        likely = np.flatnonzero(out)
        out[likely] = self._held(hashes[likely] >> 32)
        return out


class SharedBitmap:
    """A bitmap that is broadcast; tasks get it when they first ask."""

    def __init__(self, shared):
        self.shared = shared

    def hit(self, hashes: np.ndarray) -> np.ndarray:
        return Bitmap(self.shared.value).hit(hashes)


def bitmap_of(rows: DataFrame, column: str) -> SharedBitmap:
    """A bitmap of the 64-bit hashes in a column, for a filter before rows move.

    It has BITMAP_BITS bits whatever the input: the executors combine bits, the driver gets at most a word for
    each 64 of them. Where it fills up, it excludes fewer rows.
    """
    low = lambda h: h.bitwiseAND(F.lit(BITMAP_BITS - 1))
    at = rows.select(F.explode(F.array(low(F.col(column)), low(F.shiftright(column, 32)))).alias("at"))
    bits = at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(at, 64) AS INT)))").alias("held"))
    words = np.zeros(BITMAP_BITS // 64, np.int64)
    held = bits.toArrow()
    words[held["word"].to_numpy()] = held["held"].to_numpy()
    return SharedBitmap(rows.sparkSession.sparkContext.broadcast(words.view(np.uint64)))


def may_hit(bitmap: SharedBitmap):
    """A function of a column of 64-bit hashes."""

    @F.pandas_udf("boolean")
    def hits(hashes: pd.Series) -> pd.Series:
        return pd.Series(bitmap.hit(hashes.to_numpy().astype(np.int64)))

    return hits


def filesystem(uri: str):
    """(pyarrow filesystem, path in it) of a uri such as file:///x or hdfs://host/x."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Writes byte chunks under a name of this attempt, then renames: readers see whole files only."""
    system, path = filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    temporary, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with system.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    try:
        system.move(temporary, path)
    except OSError:  # some stores don't rename onto a file that an earlier attempt left
        system.delete_file(path)
        system.move(temporary, path)
    return size


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
