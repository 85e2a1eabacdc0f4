"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import six_stats
from ..operators import stats
from ..sources.views import frames, pixels, table, with_views
from .registry import query, rounded


def six_sql(prefix: str, x: str) -> str:
    return f"""round(min({x}), 6) AS {prefix}_min, round(max({x}), 6) AS {prefix}_max, round(quantile_cont({x}, 0.5), 6) AS {prefix}_median,
  round(avg({x}), 6) AS {prefix}_mean, round(stddev_pop({x}), 6) AS {prefix}_std, round(max({x}) - min({x}), 6) AS {prefix}_range"""


@query(f"""{with_views("frames")}, steps AS (SELECT *, abs(k - lag(k) OVER (PARTITION BY scene ORDER BY frame_idx)) AS step FROM frames WHERE NOT err)
SELECT scene, count(*) AS n_frames, {six_sql("pos", "k")}, {six_sql("delta", "step")}, round(sum(step), 6) AS delta_total FROM steps GROUP BY scene""")
def scene_motion_stats(spark, sf_dir):
    """Camera motion per scene, frames with errors left out."""
    return rounded(stats.motion_stats(frames(spark, sf_dir).where("NOT err"), "scene", "frame_idx", "k"))


_LEVELS = ("min", "max", "mean", "median", "std")


@query(f"""{with_views("pixels")}, f AS (SELECT scene, frame, min(v) AS f_min, max(v) AS f_max, avg(v) AS f_mean, quantile_cont(v, 0.5) AS f_median, stddev_pop(v) AS f_std FROM pixels GROUP BY scene, frame)
SELECT scene, {", ".join(six_sql(f"depth_frame_{x}", f"f_{x}") for x in _LEVELS)} FROM f GROUP BY scene""")
def frame_stats_two_level(spark, sf_dir):
    """Per-frame depth statistics, then their statistics over a scene's frames."""
    return rounded(stats.two_level_stats(pixels(spark, sf_dir), "scene", "frame", "v", "depth_frame"))


@query(f"""{with_views("pixels")} SELECT scene, count(*) AS n_pixels, {six_sql("depth_scene", "v")} FROM pixels GROUP BY scene""")
def pooled_scene_stats(spark, sf_dir):
    """Depth statistics pooled over all pixels of a scene."""
    return rounded(pixels(spark, sf_dir).groupBy("scene").agg(F.count("*").alias("n_pixels"), *six_stats("depth_scene", F.col("v"))))


@query(f"""WITH n AS (SELECT CAST(label AS BIGINT) AS scene, CAST(embedding[1] AS DOUBLE) AS nx, CAST(embedding[2] AS DOUBLE) AS ny, CAST(embedding[3] AS DOUBLE) AS nz FROM embeddings)
SELECT scene, {", ".join(six_sql(f"normal_{a}", a) for a in ("nx", "ny", "nz"))}, round(avg(sqrt(nx * nx + ny * ny + nz * nz)), 6) AS normal_mag_mean FROM n GROUP BY scene""")
def normal_axis_stats(spark, sf_dir):
    """Statistics of each normal axis and the mean length."""
    n = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("scene"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate(("nx", "ny", "nz"))])
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return rounded(n.groupBy("scene").agg(*[s for a in ("nx", "ny", "nz") for s in six_stats(f"normal_{a}", F.col(a))], F.avg(size).alias("normal_mag_mean")))


@query(f"""{with_views("frames")}, r AS (SELECT scene, depth, row_number() OVER (PARTITION BY scene ORDER BY depth) - 1 AS i, count(*) OVER (PARTITION BY scene) AS n FROM frames)
SELECT scene, max(CASE WHEN i = n // 4 THEN depth END) AS p25, max(CASE WHEN i = n * 2 // 4 THEN depth END) AS median, max(CASE WHEN i = n * 3 // 4 THEN depth END) AS p75 FROM r GROUP BY scene""")
def quartile_index_pick(spark, sf_dir):
    """Quartiles of depth picked by index."""
    return stats.index_quartiles(frames(spark, sf_dir), "scene", "depth")


@query(f"""{with_views("frames")}, r AS (SELECT scene, depth, row_number() OVER (PARTITION BY scene ORDER BY depth) - 1 AS i, (count(*) OVER (PARTITION BY scene) - 1) * 0.3::DOUBLE AS place FROM frames),
p AS (SELECT scene, max(CASE WHEN i = floor(place) THEN depth END) AS lo, max(CASE WHEN i = ceil(place) THEN depth END) AS hi, max(CASE WHEN i = round_even(place, 0) THEN depth END) AS near, max(place) - floor(max(place)) AS part FROM r GROUP BY scene)
SELECT scene, round(lo + (hi - lo) * part, 6) AS linear, round(lo, 6) AS lower, round(hi, 6) AS higher, round(near, 6) AS nearest, round((lo + hi) / 2, 6) AS midpoint FROM p""")
def quantile_modes(spark, sf_dir):
    """The 0.3-quantile of depth in five interpolation modes."""
    return rounded(stats.quantile_in_modes(frames(spark, sf_dir), "scene", "depth", 0.3))


@query(f"""{with_views("frames")}, r AS (SELECT scene, depth, row_number() OVER (PARTITION BY scene ORDER BY frame_idx) - 1 AS pos FROM frames)
SELECT scene, round(quantile_cont(depth, 0.98), 6) AS q, count(*) AS n_used FROM r WHERE pos >= 1 AND (pos - 1) % 3 = 0 GROUP BY scene""")
def strided_quantile(spark, sf_dir):
    """A quantile over every third frame from the second on."""
    return rounded(stats.strided_quantile(frames(spark, sf_dir), "scene", "frame_idx", "depth", 0.98, 3, 1))


@query(f"""{with_views("frames")} SELECT event_type, round(sum(depth * k), 6) AS total, round(sum(k), 6) AS counts, round(sum(depth * k) / sum(k), 6) AS average FROM frames GROUP BY event_type""")
def running_weighted_mean(spark, sf_dir):
    """Mean depth by event type, weighted by k."""
    return rounded(stats.running_mean(frames(spark, sf_dir), "event_type", "depth", "k"))


@query(f"""{with_views("frames")}, c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY scene ORDER BY frame_idx) THEN 0 ELSE 1 END AS change FROM frames),
r AS (SELECT *, sum(change) OVER (PARTITION BY scene ORDER BY frame_idx) - 1 AS run FROM c)
SELECT scene, CAST(run AS BIGINT) AS run, event_type, min(frame_idx) AS first_frame, count(*) AS n FROM r GROUP BY scene, run, event_type""")
def consecutive_key_groups(spark, sf_dir):
    """Runs of one event type in a scene (gaps and islands)."""
    from pyspark.sql import Window

    order = Window.partitionBy("scene").orderBy("frame_idx")
    f = frames(spark, sf_dir).withColumn("change", F.when(F.col("event_type").eqNullSafe(F.lag("event_type").over(order)), 0).otherwise(1))
    runs = f.withColumn("run", (F.sum("change").over(order) - 1).cast("long"))
    return runs.groupBy("scene", "run", "event_type").agg(F.min("frame_idx").alias("first_frame"), F.count("*").alias("n"))


@query(f"""{with_views("pixels")}, f AS (SELECT scene, frame, avg(v) AS m FROM pixels GROUP BY scene, frame), s AS (SELECT scene, avg(m) AS m FROM f GROUP BY scene)
SELECT round(avg(m), 6) AS mean_of_means, count(*) AS n_scenes FROM s""")
def mean_of_means(spark, sf_dir):
    """The unweighted mean of scene means of frame means."""
    per_scene = pixels(spark, sf_dir).groupBy("scene", "frame").agg(F.avg("v").alias("m")).groupBy("scene").agg(F.avg("m").alias("m"))
    return rounded(per_scene.agg(F.avg("m").alias("mean_of_means"), F.count("*").alias("n_scenes")))


@query("""SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs, min(n_chars) AS shortest, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY source""")
def dataset_counts(spark, sf_dir):
    """Counts, distinct keys and the shortest sequence of each dataset."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("n_langs"), F.min("n_chars").alias("shortest"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))


@query(f"""{with_views("frames")}, s AS (SELECT scene, count(*) AS n, count(*) FILTER (NOT err) AS n_ok, bool_or(err) AS any_err, bool_and(depth > 1) AS all_far FROM frames GROUP BY scene)
SELECT scene, n, n_ok, any_err, all_far FROM s WHERE n_ok > 0""")
def valid_counts(spark, sf_dir):
    """Valid frame counts and flags per scene; scenes without valid frames are dropped."""
    f = frames(spark, sf_dir).groupBy("scene").agg(F.count("*").alias("n"), F.count_if(~F.col("err")).alias("n_ok"), F.bool_or("err").alias("any_err"), F.bool_and(F.col("depth") > 1).alias("all_far"))
    return f.where("n_ok > 0")
