"""Sinks: shards, manifests, metric lines, summaries."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import filesystem


def write_shards(rows: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard, rows of a shard written by one task; the commit protocol makes it atomic."""
    rows.repartition(shard).write.partitionBy(shard).mode("errorifexists").parquet(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def append_metrics(rows: DataFrame, path: str, sample: str, fixed: list[str]) -> None:
    """A JSON line per sample: the metrics in ``fixed`` as text with six decimals, the others as numbers."""
    columns = [F.format_string("%05d", F.col(sample).cast("int")).alias("idx")]
    columns += [F.format_string("%.6f", F.col(c).cast("double")).alias(c) if c in fixed else F.col(c) for c in rows.columns if c != sample]
    rows.select(*columns).write.mode("append").json(path)


def write_summary(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_files(files: DataFrame) -> DataFrame:
    """Writes rows (path, content) as a file each, whole or not at all; (path, size) of each, lazily, so act on it once.

    A null content is an empty file; of rows with one path the last written stays.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                system, place = filesystem(path)
                folder, content = os.path.dirname(place), content.as_py() or b""
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                temporary = f"{place}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(temporary) as out:
                    out.write(content)
                system.move(temporary, place)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "size"])

    return files.select("path", F.col("content").cast("binary")).mapInArrow(write, "path string, size long")


def copy_files(files: DataFrame) -> DataFrame:
    """Copies the files of rows (path, target) as they are, streaming; (target, size) of each, lazily, so act on it once."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (source, a), (sink, b) = filesystem(path), filesystem(target)
                sink.create_dir(os.path.dirname(b), recursive=True)
                temporary = f"{b}.{uuid.uuid4().hex}.part"
                with source.open_input_stream(a) as read, sink.open_output_stream(temporary) as write:
                    while chunk := read.read(1 << 20):
                        write.write(chunk)
                sink.move(temporary, b)
                sizes.append(sink.get_file_info(b).size)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes, pa.int64())], ["target", "size"])

    return files.select("path", "target").mapInArrow(copy, "target string, size long")


def fresh_folder(spark: SparkSession, path: str) -> str:
    """The path, or with the first suffix _1, _2 and so on that does not exist."""
    jvm, n, name = spark.sparkContext._jvm, 0, path
    while True:
        p = jvm.org.apache.hadoop.fs.Path(name)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return name
        n += 1
        name = f"{path}_{n}"
