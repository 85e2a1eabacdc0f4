"""Ranked report queries over a wide row per scene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio_or_inf
from ..operators import reports, stats
from ..operators.joins import first_reason
from ..sources.views import frames, with_views
from .registry import query, rounded

FAR_PLANE, LEAST_RANGE = 480.0, 300.0


def scenes(spark, sf_dir) -> DataFrame:
    """A wide row per scene; some scenes are marked skipped or lack statistics, as in a manifest."""
    f = frames(spark, sf_dir)
    wide = f.groupBy("scene").agg(
        F.count_if(~F.col("err")).alias("n_cameras"), F.round(F.min("depth"), 6).alias("depth_min"), F.round(F.max("depth"), 6).alias("depth_max"), F.round(F.max("depth") - F.min("depth"), 6).alias("depth_range"), F.round(F.stddev_pop("depth"), 6).alias("depth_std"),
        *[F.round(F.max(F.when(F.col("event_type") == t, F.col("k"))) - F.min(F.when(F.col("event_type") == t, F.col("k"))), 6).alias(f"{t}_range") for t in ("click", "view", "purchase", "signup")],
    )
    moved = stats.motion_stats(f.where("NOT err"), "scene", "frame_idx", "k").select("scene", F.round("delta_total", 6).alias("motion"))
    wide = wide.join(moved, "scene", "left")
    return wide.withColumns({"skipped": F.col("scene") % 10 == 0, "depth_range": F.when(F.col("scene") % 7 != 0, F.col("depth_range"))})


_SCENES = f"""{with_views("frames")}, moved AS (SELECT scene, round(sum(step), 6) AS motion FROM (SELECT scene, abs(k - lag(k) OVER (PARTITION BY scene ORDER BY frame_idx)) AS step FROM frames WHERE NOT err) GROUP BY scene),
wide AS (SELECT scene, count(*) FILTER (NOT err) AS n_cameras, round(min(depth), 6) AS depth_min, round(max(depth), 6) AS depth_max, round(max(depth) - min(depth), 6) AS depth_range, round(stddev_pop(depth), 6) AS depth_std,
  {", ".join(f"round(max(k) FILTER (event_type = '{t}') - min(k) FILTER (event_type = '{t}'), 6) AS {t}_range" for t in ("click", "view", "purchase", "signup"))} FROM frames GROUP BY scene),
scenes AS (SELECT wide.* REPLACE (CASE WHEN scene % 7 <> 0 THEN depth_range END AS depth_range), motion, scene % 10 = 0 AS skipped FROM wide LEFT JOIN moved USING (scene))"""


def _base() -> tuple:
    return ("skipped", F.col("skipped")), ("no_camera", F.col("n_cameras") == 0)


@query(f"""{_SCENES} SELECT scene, CASE WHEN skipped THEN 'skipped' WHEN n_cameras = 0 THEN 'no_camera' WHEN depth_range IS NULL THEN 'no_depth' WHEN depth_max >= {FAR_PLANE} THEN 'far_plane' WHEN depth_range < {LEAST_RANGE} THEN 'degenerate' END AS reason FROM scenes""")
def exclusion_reasons_depth(spark, sf_dir):
    """Why a scene is left out of the depth report: the far plane is tested before a flat range."""
    return scenes(spark, sf_dir).select("scene", first_reason([*_base(), ("no_depth", F.col("depth_range").isNull()), ("far_plane", F.col("depth_max") >= FAR_PLANE), ("degenerate", F.col("depth_range") < LEAST_RANGE)]).alias("reason"))


@query(f"""{_SCENES} SELECT scene, CASE WHEN skipped THEN 'skipped' WHEN n_cameras = 0 THEN 'no_camera' WHEN depth_range IS NULL THEN 'no_depth' WHEN depth_range < {LEAST_RANGE} THEN 'zero_depth' WHEN depth_max >= {FAR_PLANE} THEN 'far_plane' END AS reason FROM scenes""")
def exclusion_reasons_camera(spark, sf_dir):
    """Why a scene is left out of the camera report: a flat range is tested before the far plane."""
    return scenes(spark, sf_dir).select("scene", first_reason([*_base(), ("no_depth", F.col("depth_range").isNull()), ("zero_depth", F.col("depth_range") < LEAST_RANGE), ("far_plane", F.col("depth_max") >= FAR_PLANE)]).alias("reason"))


_REPORTS = [("narrowest", "coalesce(depth_range, 0)", False), ("deepest", "coalesce(depth_range, 0)", True), ("near_field", "depth_min", False), ("static", "coalesce(motion, 0)", False), ("moving", "coalesce(motion, 0)", True), ("varied", "depth_std", True), ("far_field", "depth_max", True)]


def _specs():
    return [(name, F.expr(key), down, F.lit(True)) for name, key, down in _REPORTS]


_TOP = " UNION ALL ".join(f"(SELECT '{name}' AS category, row_number() OVER (ORDER BY round({key}, 6) {'DESC' if down else 'ASC'}, scene) AS rank, scene, round(CAST({key} AS DOUBLE), 6) AS value FROM scenes WHERE NOT skipped QUALIFY rank <= {{n}})" for name, key, down in _REPORTS)


@query(f"{_SCENES} {_TOP.format(n=3)}")
def topk_report_union(spark, sf_dir):
    """Seven top-3 reports in one table, in one pass; missing statistics count as 0."""
    return reports.ranked(scenes(spark, sf_dir).where("NOT skipped"), "scene", _specs(), 3)


@query(f"{_SCENES} {_TOP.format(n=1)}")
def summary_top1(spark, sf_dir):
    """The winner of each report."""
    return reports.ranked(scenes(spark, sf_dir).where("NOT skipped"), "scene", _specs(), 1)


_AXES = ["click_range", "view_range", "purchase_range", "signup_range"]
_NORMAL = {a: f"coalesce({a}, 0) / CASE WHEN (SELECT max(coalesce({a}, 0)) FROM scenes) = 0 THEN 1 ELSE (SELECT max(coalesce({a}, 0)) FROM scenes) END" for a in _AXES}


@query(f"""{_SCENES}, n AS (SELECT scene, {", ".join(f"{x} AS {a}" for a, x in _NORMAL.items())} FROM scenes)
SELECT scene, {", ".join(f"round({a} / ({' + '.join(b for b in _AXES if b != a)} + 1e-6), 6) AS purity_{a}" for a in _AXES)} FROM n""")
def purity_scores(spark, sf_dir):
    """How much a scene moves along one axis only."""
    return rounded(reports.purity(scenes(spark, sf_dir).select("scene", *_AXES), _AXES).drop(*_AXES))


@query(f"""{_SCENES}, l AS (SELECT scene, unnest(['depth_min', 'depth_max', 'depth_std']) AS metric, unnest([depth_min, depth_max, depth_std]) AS value FROM scenes)
SELECT metric, scene, rank() OVER (PARTITION BY metric ORDER BY value DESC) AS rank, count(*) OVER (PARTITION BY metric) AS n FROM l""")
def metric_rank_spotlight(spark, sf_dir):
    """A scene's standing in each metric."""
    return reports.standing(scenes(spark, sf_dir).select("scene", "depth_min", "depth_max", "depth_std"), ["depth_min", "depth_max", "depth_std"], "scene")


@query(f"""{_SCENES} SELECT scene, round(CASE WHEN coalesce(motion, 0) > 0 THEN depth_std / motion WHEN depth_std > 0 THEN 1e308 ELSE 0 END, 6) AS depth_per_motion FROM scenes""")
def depth_per_motion_ratio(spark, sf_dir):
    """Depth variation per camera motion, with a sentinel where there is no motion."""
    return rounded(scenes(spark, sf_dir).select("scene", ratio_or_inf(F.col("depth_std"), F.coalesce("motion", F.lit(0.0)), 1e308).alias("depth_per_motion")))


@query(f"""{_SCENES}, q AS (SELECT max(CASE WHEN i = n // 4 THEN motion END) AS p25, max(CASE WHEN i = n * 3 // 4 THEN motion END) AS p75 FROM (SELECT motion, row_number() OVER (ORDER BY motion) - 1 AS i, count(*) OVER () AS n FROM scenes WHERE motion IS NOT NULL))
SELECT scene, motion, CASE WHEN motion <= p25 THEN 'low' WHEN motion >= p75 THEN 'high' ELSE 'mid' END AS band FROM scenes, q WHERE motion IS NOT NULL""")
def motion_bands(spark, sf_dir):
    """Scenes of low and high motion, by index-picked quartiles."""
    moving = scenes(spark, sf_dir).where("motion IS NOT NULL").select("scene", "motion")
    cut = stats.index_cuts(moving, "motion", "scene").select("p25", "p75")
    return moving.crossJoin(F.broadcast(cut)).select("scene", "motion", F.when(F.col("motion") <= F.col("p25"), "low").when(F.col("motion") >= F.col("p75"), "high").otherwise("mid").alias("band"))  # one row of quartiles
