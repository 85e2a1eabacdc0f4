"""Structured Streaming: clip ingest, cache sink and a resumable cursor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 4) -> DataFrame:
    """New Parquet files as a stream; the trigger's file limit is the back-pressure budget."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def select_valid(stream: DataFrame, low: float, high: float) -> DataFrame:
    """The stateless part of the sample pipeline: decode, keep non-null samples in range, derive."""
    return stream.where("value IS NOT NULL").where((F.col("value") > low) & (F.col("value") < high)).withColumn("disparity", 1.0 / F.col("value"))


def run_once(stream: DataFrame, checkpoint: str, target: str) -> None:
    """Exactly one pass over what is there, resumable from the checkpoint."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def cache_sink(stream: DataFrame, checkpoint: str, target: str, key: list[str]) -> None:
    """Put-if-absent into a Parquet cache: a repeated batch inserts nothing new."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key)
        try:
            new = new.join(spark.read.schema(batch.schema).parquet(target).select(*key), key, "left_anti")
        except Exception as e:  # the cache does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(target)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def update_sink(stream: DataFrame, checkpoint: str, target: str) -> None:
    """Appends the updates of each batch to a Parquet table; a batch that is run again writes its own folder anew."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def clip_cursor(stream: DataFrame, by: str, length: int) -> DataFrame:
    """(by, clips, frames): how many clips of ``length`` frames each key has given so far; the position is kept as state."""

    def advance(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        seen += sum(len(r) for r in rows)
        state.update((seen,))
        yield pd.DataFrame({by: [key[0]], "clips": [seen // length], "frames": [seen]})

    return stream.groupBy(by).applyInPandasWithState(advance, f"{by} long, clips long, frames long", "seen long", "update", GroupStateTimeout.NoTimeout)
