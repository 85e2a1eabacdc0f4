"""Full camera and depth motion statistics, and the ranked reports over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports, stats
from ..sources.scratch import written
from ..sources.views import frames, with_views
from .registry import query, rounded
from .stats import six_sql

_POS, _ROT = ("x", "y", "z"), ("pitch", "yaw", "roll")
#: A camera's place and rotation, put together from a frame's columns.
_CAMERA = {"pos_x": "k", "pos_y": "depth / 10", "pos_z": "k * depth / 100", "rot_pitch": "k % 7", "rot_yaw": "depth % 90", "rot_roll": "CAST(event_id % 5 AS DOUBLE)"}
_CAMERA_SQL = f"""cams AS (SELECT scene, frame_idx, {", ".join(f"{x} AS {n}" for n, x in _CAMERA.items())} FROM frames WHERE NOT err OR frame_idx = 0),
moved AS (SELECT *, {", ".join(f"{n} - lag({n}) OVER w AS d_{n}" for n in _CAMERA)} FROM cams WINDOW w AS (PARTITION BY scene ORDER BY frame_idx)),
steps AS (SELECT *, sqrt(d_pos_x * d_pos_x + d_pos_y * d_pos_y + d_pos_z * d_pos_z) AS d_pos FROM moved),
motion AS (SELECT scene, count(*) AS num_valid_cameras, {", ".join(six_sql(n, n) for n in _CAMERA)}, {six_sql("delta_pos", "d_pos")}, round(sum(d_pos), 6) AS delta_pos_total, {", ".join(six_sql(f"delta_rot_{r}", f"abs(d_rot_{r})") for r in _ROT)} FROM steps GROUP BY scene)"""


def cameras(spark, sf_dir):
    """A camera per frame without an error, and for the first of each scene."""
    f = frames(spark, sf_dir).where("NOT err OR frame_idx = 0")
    return f.select("scene", "frame_idx", *[F.expr(x).alias(n) for n, x in _CAMERA.items()])


@query(f"""{with_views("frames")}, {_CAMERA_SQL} SELECT * FROM motion""")
def camera_motion_stats(spark, sf_dir):
    """Statistics of three positions and three rotations, of the steps between frames and their total length; scenes with one camera have no steps."""
    return rounded(stats.camera_stats(cameras(spark, sf_dir), "scene", "frame_idx", [f"pos_{a}" for a in _POS], [f"rot_{a}" for a in _ROT]))


_AXES = [f"pos_{a}_range" for a in _POS] + ["rot_yaw_range", "rot_pitch_range", "rot_roll_range"]


def _weights(axis: str) -> tuple[str, str]:
    if axis.startswith("pos"):
        return "delta_pos_max", "delta_pos_std"
    name = axis.removesuffix("_range")
    return f"delta_{name}_max", f"delta_{name}_std"


def _purity_specs() -> list[tuple[str, str, str]]:
    """(category, value, condition) of longest, fastest and most jittery along each axis."""
    out = []
    for axis in _AXES:
        family = [a for a in _AXES if a[:3] == axis[:3]]
        keep = f"coalesce({axis}, 0) > 0 AND " + " AND ".join(f"coalesce({axis}, 0) >= coalesce({a}, 0)" for a in family)
        fast, jitter = _weights(axis)
        for kind, weight in (("longest", "1.0"), ("fastest", f"coalesce({fast}, 0)"), ("jittery", f"coalesce({jitter}, 0)")):
            out.append((f"{axis.removesuffix('_range')}_{kind}", f"{weight} * purity_{axis}", keep))
    return out


def _union_sql(specs: list[tuple[str, str, str, bool]], table: str, n: int = 3) -> str:
    part = "SELECT '{name}' AS category, row_number() OVER (ORDER BY round({value}, 6) {way}, scene) AS rank, scene, round(CAST({value} AS DOUBLE), 6) AS value FROM {table} WHERE {keep} QUALIFY rank <= {n}"
    return " UNION ALL ".join("(" + part.format(name=name, value=value, way="DESC" if down else "ASC", table=table, keep=keep, n=n) + ")" for name, value, keep, down in specs)


_NORMAL = {a: f"coalesce({a}, 0) / CASE WHEN max(coalesce({a}, 0)) OVER () = 0 THEN 1 ELSE max(coalesce({a}, 0)) OVER () END" for a in _AXES}


@query(f"""{with_views("frames")}, {_CAMERA_SQL}, normal AS (SELECT *, {", ".join(f"{x} AS n_{a}" for a, x in _NORMAL.items())} FROM motion),
pure AS (SELECT *, {", ".join(f"n_{a} / ({' + '.join(f'n_{b}' for b in _AXES if b != a)} + 1e-6) AS purity_{a}" for a in _AXES)} FROM normal)
{_union_sql([(*s, True) for s in _purity_specs()], "pure")}""")
def axis_purity_reports(spark, sf_dir):
    """Along each of six axes the scenes that move longest, fastest and most jerkily, and along it alone."""
    wide = rounded(stats.camera_stats(cameras(spark, sf_dir), "scene", "frame_idx", [f"pos_{a}" for a in _POS], [f"rot_{a}" for a in _ROT]))
    scored = reports.purity(wide, _AXES)
    return reports.ranked(scored, "scene", [(name, F.expr(value), True, F.expr(keep)) for name, value, keep in _purity_specs()], 3)


_PLANES = {"nx": "k / 50", "ny": "depth / 500", "nz": "(k + depth) / 600"}
_DEPTH_SQL = f"""bursts AS (SELECT *, frame_idx // 4 AS frame, {", ".join(f"{x} AS {n}" for n, x in _PLANES.items())} FROM frames),
per_frame AS (SELECT scene, frame, min(depth) AS f_min, max(depth) AS f_max, avg(depth) AS f_mean, {", ".join(f"avg({n}) AS {n}" for n in _PLANES)} FROM bursts GROUP BY scene, frame),
over_frames AS (SELECT scene, {", ".join(six_sql(f"depth_frame_{k}", f"f_{k}") for k in ("min", "max", "mean"))}, {", ".join(f"round(stddev_pop({n}), 6) AS {n}_std" for n in _PLANES)} FROM per_frame GROUP BY scene),
pooled AS (SELECT scene, {six_sql("depth_scene", "depth")} FROM bursts GROUP BY scene),
wide AS (SELECT *, coalesce(delta_pos_total, 0) AS cam, nx_std + ny_std + nz_std AS normal_var FROM pooled JOIN over_frames USING (scene) JOIN (SELECT scene, delta_pos_total FROM motion) USING (scene)),
cuts AS (SELECT max(cam) FILTER (i = n // 4) AS p25, max(cam) FILTER (i = 3 * n // 4) AS p75 FROM (SELECT cam, row_number() OVER (ORDER BY cam) - 1 AS i, count(*) OVER () AS n FROM wide)),
banded AS (SELECT *, cam <= p25 AS low, cam >= p75 AS high FROM wide, cuts)"""

#: (category, value, condition, whether the greatest come first)
_DEPTH_REPORTS = [
    ("narrowest", "depth_scene_range", "NOT low", False), ("deepest", "depth_scene_max", "TRUE", True), ("near_changes", "depth_frame_min_std", "TRUE", True), ("near_changes_in_front", "depth_frame_min_std", "depth_frame_min_mean < depth_scene_median", True),
    ("static", "depth_frame_mean_std", "TRUE", False), ("static_surfaces", "depth_frame_mean_std + normal_var * 100", "TRUE", False), ("far_with_camera", "depth_frame_max_std", "high", True), ("far_surfaces_with_camera", "depth_frame_max_std + normal_var * 50", "high", True),
    ("changes_with_camera", "depth_frame_mean_std", "high", True), ("range_with_camera", "depth_frame_mean_range", "high", True), ("far_without_camera", "depth_frame_max_std", "low", True), ("far_per_camera", "CASE WHEN cam > 0 THEN depth_frame_max_std / cam ELSE 0 END", "low AND (cam > 0 OR depth_frame_max_std = 0)", True),
    ("changes_without_camera", "depth_frame_mean_std", "low", True), ("changes_per_camera", "CASE WHEN cam > 0 THEN depth_frame_mean_std / cam ELSE 0 END", "low AND (cam > 0 OR depth_frame_mean_std = 0)", True), ("surfaces_without_camera", "normal_var", "low", True),
]


@query(f"""{with_views("frames")}, {_CAMERA_SQL}, {_DEPTH_SQL} {_union_sql(_DEPTH_REPORTS, "banded")}""")
def depth_motion_reports(spark, sf_dir):
    """Fifteen top-3 reports on depth and its change, with and without the camera's motion, in one pass over a written row per scene."""
    f = frames(spark, sf_dir).select("scene", "depth", F.floor(F.col("frame_idx") / 4).alias("frame"), *[F.expr(x).alias(n) for n, x in _PLANES.items()])
    per_frame = f.groupBy("scene", "frame").agg(F.min("depth").alias("f_min"), F.max("depth").alias("f_max"), F.avg("depth").alias("f_mean"), *[F.avg(n).alias(n) for n in _PLANES])
    over = per_frame.groupBy("scene").agg(*[s for k in ("min", "max", "mean") for s in stats.six_stats(f"depth_frame_{k}", F.col(f"f_{k}"))], *[F.stddev_pop(n).alias(f"{n}_std") for n in _PLANES])
    pooled = f.groupBy("scene").agg(*stats.six_stats("depth_scene", F.col("depth")))
    moved = stats.camera_stats(cameras(spark, sf_dir), "scene", "frame_idx", [f"pos_{a}" for a in _POS], [f"rot_{a}" for a in _ROT]).select("scene", "delta_pos_total")
    wide = written(rounded(pooled.join(over, "scene").join(moved, "scene")), "wide").withColumns({"cam": F.coalesce("delta_pos_total", F.lit(0.0)), "normal_var": F.col("nx_std") + F.col("ny_std") + F.col("nz_std")})
    cut = stats.index_cuts(wide.select("cam", "scene"), "cam", "scene").select("p25", "p75")
    banded = wide.crossJoin(F.broadcast(cut)).withColumns({"low": F.expr("cam <= p25"), "high": F.expr("cam >= p75")})  # one row
    return reports.ranked(banded, "scene", [(name, F.expr(value), down, F.expr(keep)) for name, value, keep, down in _DEPTH_REPORTS], 3)
