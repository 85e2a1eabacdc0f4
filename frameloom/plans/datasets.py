"""Queries over datasets as folders of files: written a file a frame, scanned, and read by a data source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import codecs, frame_source, listing, sinks
from ..sources.scratch import scratch
from ..sources.views import rasters, table
from .registry import query, rounded


def _name(kind: str, ending: str):
    return F.concat(F.col("label").cast("string"), F.lit(f"/{kind}/"), F.lpad(F.col("vec_id").cast("string"), 8, "0"), F.lit(ending))


def _written(spark, sf_dir):
    """Frames of embeddings as files: a PNG and a depth file each, and for two of three a camera."""
    out = scratch(spark, "frames")
    frames = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select("vec_id", "label")
    values = rasters(spark, sf_dir).select("vec_id", "values")
    path = lambda name: F.concat(F.lit(f"{out}/"), name).alias("path")
    unit = values.select("vec_id", F.transform("values", lambda v: F.least(v, F.lit(1.0))).alias("values"))
    files = codecs.encoded(unit, "png8", 8, 8).select("vec_id", "content").join(frames, "vec_id").select(path(_name("rgb", ".png")), "content")
    files = files.unionByName(codecs.encoded(values, "dpt", 8, 8).select("vec_id", "content").join(frames, "vec_id").select(path(_name("depth", ".dpt")), "content"))
    camera = F.to_json(F.struct((F.col("vec_id") * 0.5).alias("fx"), F.lit(8.0).alias("width")))
    files = files.unionByName(frames.where("vec_id % 3 <> 0").select(path(_name("camera", ".json")), camera.cast("binary").alias("content")))
    sinks.write_files(files).write.json(f"{out}/_log")
    return out


@query("""SELECT CAST(label AS VARCHAR) AS scene, count(*) AS n_frames, min(vec_id) AS first_idx, max(vec_id) - min(vec_id) + 1 = count(DISTINCT vec_id) AS contiguous, lpad(CAST(max(vec_id) AS VARCHAR), 8, '0') || '.png' AS last FROM embeddings WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 2""")
def directory_scan(spark, sf_dir):
    """Folders of frames scanned to sequences of two frames at least: number, first index, whether without gaps, and the last file."""
    out = _written(spark, sf_dir)
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(out).select("path")
    found = listing.scene_index(paths, least=2)
    return found.select(F.regexp_extract("scene", r"([^/]+)/rgb$", 1).alias("scene"), "n_frames", "first_idx", "contiguous", F.regexp_extract(F.element_at("frames", -1), r"([^/]+)$", 1).alias("last"))


@query("""SELECT CAST(label AS VARCHAR) AS scene, vec_id AS frame, round(list_sum(list_transform(embedding, lambda e: CAST(CAST(abs(CAST(e AS DOUBLE)) + 0.1 AS FLOAT) AS DOUBLE))), 4) AS depth_total, CASE WHEN vec_id % 3 <> 0 THEN vec_id * CAST(0.5 AS DOUBLE) END AS fx FROM embeddings WHERE label IS NOT NULL""")
def frame_dataset(spark, sf_dir):
    """A dataset of folders read through its hooks: frames with both images, their depths decoded, cameras where there are any."""
    out = _written(spark, sf_dir)
    spark.dataSource.register(frame_source.FolderFrames)
    read = spark.read.format("framefolders").option("path", out).option("framesPerTask", 64).load()
    back = codecs.decoded(read.select("scene", "frame", "fx", F.col("depth").alias("content")), "dpt")
    return rounded(back.select("scene", "frame", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("depth_total"), "fx"))


@query("""SELECT CAST(label AS VARCHAR) AS scene, vec_id AS frame FROM embeddings WHERE label IS NOT NULL""")
def frame_dataset_colour(spark, sf_dir):
    """The same without its depth files, which are neither listed nor read."""
    out = _written(spark, sf_dir)
    spark.dataSource.register(frame_source.FolderFrames)
    read = spark.read.format("framefolders").option("path", out).option("colourOnly", "true").option("batchBytes", 4096).load()
    return read.where("depth IS NULL AND length(rgb) > 0").select("scene", "frame")
