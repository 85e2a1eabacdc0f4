"""Catalogs from file listings and manifests: scenes, pairs, intrinsics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import natural_key


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(rgb, depth, filled) from whitespace-separated columns; rows whose depth is the word None are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(F.get(parts, F.lit(0)).alias("rgb"), F.get(parts, F.lit(1)).alias("depth"), F.get(parts, F.lit(2)).alias("filled")).where("depth IS NULL OR depth <> 'None'")


def scene_index(paths: DataFrame, path: str = "path", least: int = 1) -> DataFrame:
    """(scene, n_frames, first_idx, contiguous, frames) from paths scene/…number.ext, frames in natural order; scenes with fewer than ``least`` frames are left out."""
    parsed = paths.select(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("scene"), F.col(path).alias("file"), F.regexp_extract(path, r"(\d+)[^\d/]*$", 1).try_cast("bigint").alias("idx")).where("idx IS NOT NULL")
    grouped = parsed.groupBy("scene").agg(F.count("*").alias("n_frames"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count_distinct("idx").alias("distinct"), F.array_sort(F.collect_list(F.struct(natural_key(F.col("file")).alias("k"), F.col("file")))).alias("fs"))
    return grouped.where(F.col("n_frames") >= least).select("scene", "n_frames", "first_idx", (F.col("last_idx") - F.col("first_idx") + 1 == F.col("distinct")).alias("contiguous"), F.transform("fs", lambda f: f["file"]).alias("frames"))


def intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """(frame, camera, fx, fy, cx, cy) from a space-separated table with a header."""
    rows = spark.read.option("sep", " ").option("header", True).schema("frame int, camera int, k00 double, k11 double, k02 double, k12 double").csv(path)
    return rows.select("frame", "camera", F.col("k00").alias("fx"), F.col("k11").alias("fy"), F.col("k02").alias("cx"), F.col("k12").alias("cy"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The two-level scene manifest: skipped scenes and rows with an error are left out; either spelling of the depth column is read."""
    rows = spark.read.option("header", True).csv(path)
    if "depht_path" in rows.columns and "depth_path" not in rows.columns:
        rows = rows.withColumnRenamed("depht_path", "depth_path")
    for c in ("skipped", "error"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    return rows.where(F.coalesce(F.lower("skipped"), F.lit("false")) != "true").where("error IS NULL OR error = ''")


def focal_lines(spark: SparkSession, path: str, scene: str) -> DataFrame:
    """(scene, frame, fx): a file per scene folder, a line per frame, empty ones counted, the focal length in its first column."""
    read = spark.read.text(path).select(scene, "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    order = Window.partitionBy(scene).orderBy("file", "block", "line")  # lines of a block are read in order, and no file is read whole
    lines = read.withColumn("frame", (F.row_number().over(order) - 1).cast("long"))
    return lines.where("trim(value) <> ''").select(scene, "frame", F.split(F.trim("value"), r"\s+")[0].cast("double").alias("fx"))


def scene_frames(spark: SparkSession, scenes: str, frames: str) -> DataFrame:
    """(scene, idx, depth_path) of a two-level manifest: frames without an error, of scenes that are not skipped, numbered by ``place``."""
    kept = manifest(spark, scenes).select("scene")
    rows = manifest(spark, frames).join(kept, "scene", "left_semi")
    order = Window.partitionBy("scene").orderBy(F.col("place").cast("long"))
    return rows.select("scene", (F.row_number().over(order) - 1).cast("long").alias("idx"), "depth_path")
