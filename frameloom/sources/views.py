"""Catalog views over the standard tables: frames, rasters, sequences, shots, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered, running_total


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a scene (a user) in time order, with a depth, a camera coordinate and an error flag."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("scene"), (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), F.col("value").alias("depth"),
        F.get_json_object("props", "$.k").cast("double").alias("k"), (F.col("event_type") == "error").alias("err"), "event_type", "event_id", "ts",
    )


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 rasters, one array per frame: scene, frame, values of positive depth.

    Rows are numbered over all scenes in ranges, and a scene's frames count from its first number, so a large scene is
    no single task and arrays move once.
    """
    rows = numbered(table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), ["label", "vec_id"], "place")
    firsts = numbered_firsts(table(spark, sf_dir, "embeddings").select("label"))
    return rows.join(firsts, rows["label"].eqNullSafe(firsts["l"])).select(
        F.col("label").cast("long").alias("scene"), (F.col("place") - F.col("before") - 1).cast("long").alias("frame"), "vec_id",
        F.transform("embedding", lambda e: F.abs(e.cast("double")) + 0.1).alias("values"),
    )


def numbered_firsts(labels: DataFrame) -> DataFrame:
    """(l, before): how many rows stand before each label in ascending order, from a row per label."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    return running_total(counts, ["label"], F.col("n"), "upto").select(F.col("label").alias("l"), (F.col("upto") - F.col("n")).alias("before"))


def pixels(spark: SparkSession, sf_dir: str, width: int = 8) -> DataFrame:
    """The rasters with a row per pixel: scene, frame, y, x, v."""
    flat = rasters(spark, sf_dir).select("scene", "frame", F.posexplode("values").alias("pos", "v"))
    return flat.select("scene", "frame", F.floor(F.col("pos") / width).cast("long").alias("y"), (F.col("pos") % width).cast("long").alias("x"), "v")


def pairs(spark: SparkSession, sf_dir: str, low: float = 0.11, high: float = 0.4) -> DataFrame:
    """Prediction and ground truth: each frame's pixels against the next frame's, with the valid mask of the latter's depth range.

    Frames are paired as arrays before they are exploded, so one row per frame moves, not one per pixel.
    """
    order = Window.partitionBy("scene").orderBy("frame")
    zipped = rasters(spark, sf_dir).withColumn("next", F.lead("values").over(order)).where("next IS NOT NULL")
    flat = zipped.select("scene", "frame", F.posexplode(F.arrays_zip("values", "next")).alias("pos", "z"))
    gt, pred = F.col("z.values"), F.col("z.next")
    return flat.select("scene", "frame", F.floor(F.col("pos") / 8).cast("long").alias("y"), (F.col("pos") % 8).cast("long").alias("x"), pred.alias("pred"), gt.alias("gt"), ((gt > low) & (gt < high)).alias("valid"))


#: The same views in SQL.
SQL = {
    "frames": """frames AS (SELECT user_id AS scene, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_idx,
  value AS depth, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type = 'error' AS err, event_type, event_id, ts FROM events)""",
    "pixels": """pixels AS (SELECT CAST(label AS BIGINT) AS scene, frame, CAST(pos // 8 AS BIGINT) AS y, CAST(pos % 8 AS BIGINT) AS x, abs(CAST(e AS DOUBLE)) + 0.1 AS v
  FROM (SELECT label, frame, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos
    FROM (SELECT label, embedding, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame FROM embeddings)))""",
    "pairs": """pairs AS (SELECT scene, frame, y, x, pred, gt, gt > 0.11 AND gt < 0.4 AS valid
  FROM (SELECT scene, frame, y, x, v AS gt, lead(v) OVER (PARTITION BY scene, y, x ORDER BY frame) AS pred FROM pixels) WHERE pred IS NOT NULL)""",
}


def with_views(*names: str) -> str:
    """WITH clause of the views named and of those that they need."""
    need = [n for n in SQL if n in names or n == "pixels" and "pairs" in names]
    return "WITH " + ",\n".join(SQL[n] for n in need)
