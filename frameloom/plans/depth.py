"""Depth function queries."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions.depth import power_curve
from ..operators.quantiles import exact_quantiles
from ..sources.views import frames, pixels, table, with_views
from .registry import query, rounded

_NEAR, _FAR, _K = 1.0, 450.0, 10.0
_EXPONENT = 1.0 / math.log(_K)


@query(f"""{with_views("frames")}, c AS (SELECT scene, frame_idx, depth, pow(greatest(depth, 0), {_EXPONENT}) AS curved FROM frames),
q AS (SELECT scene, quantile_cont(curved, 0.02) AS lo, quantile_cont(curved, 0.98) AS hi FROM c WHERE depth > {_NEAR} + 1e-6 AND depth < {_FAR} - 1e-6 GROUP BY scene)
SELECT scene, frame_idx, round(-(CASE WHEN depth >= {_FAR} - 1e-6 THEN 1.0 WHEN depth <= {_NEAR} + 1e-6 THEN -1.0 WHEN lo IS NULL THEN 0.0 WHEN abs(hi - lo) < 1e-6 THEN CASE WHEN curved > lo + 1e-6 THEN 1.0 ELSE -1.0 END ELSE ((curved - lo) / (hi - lo) - 0.5) * 2.0 END), 6) AS n FROM c LEFT JOIN q USING (scene)""")
def depth_norm_percentile(spark, sf_dir):
    """Percentile normalisation with near and far planes, power curve and flipped sign."""
    f = frames(spark, sf_dir).select("scene", "frame_idx", "depth")
    inside = (F.col("depth") > _NEAR + 1e-6) & (F.col("depth") < _FAR - 1e-6)
    q = exact_quantiles(f.where(inside), ["scene"], power_curve(F.col("depth"), _K), [0.02, 0.98])
    n = fn.normalise_percentile(F.col("depth"), F.col("q")[0], F.col("q")[1], _NEAR, _FAR, _K, flip=True)
    return rounded(f.join(q, "scene", "left").select("scene", "frame_idx", n.alias("n")))


@query(f"""{with_views("frames")} SELECT scene, frame_idx, round((ln(1 + 2.0 * greatest(depth, 0)) / ln(1 + 2.0 * 500.0) - 0.5) * 2.0, 6) AS n FROM frames""")
def depth_norm_log(spark, sf_dir):
    """Logarithmic normalisation."""
    return rounded(frames(spark, sf_dir).select("scene", "frame_idx", fn.log_normalise(F.col("depth"), 2.0, 500.0).alias("n")))


@query(f"""{with_views("pixels")}, q AS (SELECT scene, frame, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM pixels GROUP BY scene, frame)
SELECT scene, frame, y, x, round(greatest(-1.0, least(1.0, (v - lo) / (hi - lo) * 2.0 - 1.0)), 6) AS n FROM pixels JOIN q USING (scene, frame)""")
def depth_norm_quantile(spark, sf_dir):
    """Quantile normalisation of each frame, clipped."""
    p = pixels(spark, sf_dir)
    q = exact_quantiles(p, ["scene", "frame"], F.col("v"), [0.02, 0.98])
    return rounded(p.join(q, ["scene", "frame"]).select("scene", "frame", "y", "x", fn.quantile_normalise(F.col("v"), F.col("q")[0], F.col("q")[1]).alias("n")))


@query(f"""{with_views("frames")}, g AS (SELECT scene, frame_idx, depth, CASE WHEN depth > 0 THEN 1 / depth END AS disp FROM frames),
s AS (SELECT scene, min(depth) AS lo, max(depth) AS hi, min(disp) AS dlo, max(disp) AS dhi, quantile_cont(depth, 0.02) AS q2, quantile_cont(depth, 0.98) AS q98, quantile_cont(disp, 0.02) AS d2, quantile_cont(disp, 0.98) AS d98 FROM g GROUP BY scene)
SELECT scene, frame_idx, CASE scene % 5 WHEN 0 THEN 'instnorm' WHEN 1 THEN 'truncnorm' WHEN 2 THEN 'perscene_norm' WHEN 3 THEN 'disparity' ELSE 'trunc_disparity' END AS norm_type,
round(greatest(0.0, least(1.0, CASE scene % 5 WHEN 0 THEN (depth - lo) / (hi - lo + 1e-5) WHEN 1 THEN (depth - q2) / (q98 - q2 + 1e-5) WHEN 2 THEN depth / 500.0 WHEN 3 THEN coalesce((disp - dlo) / (dhi - dlo + 1e-5), 0.0) ELSE coalesce((disp - d2) / (d98 - d2 + 1e-5), 0.0) END)), 6) AS n FROM g JOIN s USING (scene)""")
def norm_type_switch(spark, sf_dir):
    """Five training normalisations, here chosen by scene, each kept within 0 and 1.

    A depth of 0 or less has no disparity: it counts in no disparity statistic and is normalised to 0.
    """
    f = frames(spark, sf_dir).select("scene", "frame_idx", "depth")
    disparity = F.when(F.col("depth") > 0, 1 / F.col("depth"))
    ends = lambda value, name, low, high: exact_quantiles(f, ["scene"], value, [0, 0.02, 0.98, 1]).select("scene", F.slice("q", 2, 2).alias(name), F.get("q", F.lit(0)).alias(low), F.get("q", F.lit(3)).alias(high))
    q = ends(F.col("depth"), "q", "lo", "hi").join(ends(disparity, "d", "dlo", "dhi"), "scene")
    scaled = lambda x, lo, hi: (x - lo) / (hi - lo + 1e-5)
    forms = {
        "instnorm": scaled(F.col("depth"), F.col("lo"), F.col("hi")), "truncnorm": scaled(F.col("depth"), F.col("q")[0], F.col("q")[1]), "perscene_norm": F.col("depth") / 500.0,
        "disparity": F.coalesce(scaled(disparity, F.col("dlo"), F.col("dhi")), F.lit(0.0)), "trunc_disparity": F.coalesce(scaled(disparity, F.col("d")[0], F.col("d")[1]), F.lit(0.0)),
    }
    name, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    for i, (k, form) in enumerate(forms.items()):
        name, value = F.when(F.col("scene") % 5 == i, k).otherwise(name), F.when(F.col("scene") % 5 == i, form).otherwise(value)
    return rounded(f.join(q, "scene").select("scene", "frame_idx", name.alias("norm_type"), fn.clamp(value, 0.0, 1.0).alias("n")))


@query(f"""{with_views("frames")}, d AS (SELECT scene, frame_idx, CASE WHEN event_type = 'error' THEN 0 ELSE depth END AS d, k FROM frames)
SELECT scene, frame_idx, round(CASE WHEN d > 0 THEN 1.0 / d ELSE 0.0 END, 9) AS disparity, round(CASE WHEN k > 0 THEN greatest(0.0, least(300.0, 886.81 * 0.54 / k)) ELSE 300.0 END, 6) AS stereo_depth FROM d""")
def disparity_convert(spark, sf_dir):
    """Depth to disparity (0 where there is none), and stereo disparity to depth with a far limit."""
    d = F.when(F.col("err"), 0.0).otherwise(F.col("depth"))
    return frames(spark, sf_dir).select("scene", "frame_idx", F.round(fn.depth_to_disparity(d), 9).alias("disparity"), F.round(fn.disparity_to_depth(F.col("k"), F.lit(886.81), 0.54, 300.0), 6).alias("stereo_depth"))


@query("""SELECT p_partkey, round(1000.0 * p_size * 40 / (CASE WHEN p_partkey % 4 = 0 THEN p_size * 40.0 ELSE p_retailprice / 36.0 * (p_size * 40) END * 512 + 1e-8), 9) AS scale FROM part""")
def canonical_scale(spark, sf_dir):
    """Canonical depth scale from focal length metadata; without metadata the image width stands in."""
    width = F.col("p_size") * 40
    fx = fn.sensor_focal(F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")), F.lit(36.0), width)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(fn.canonical_scale(1000.0, width, fx, 512), 9).alias("scale"))


_SAMPLES = 1024


def _curve_sql(name: str) -> str:
    """The curve's look-up table in SQL: pieces between samples at even parameters."""
    at = lambda t, p, q: f"3 * (1 - {t}) * (1 - {t}) * {t} * {p} + 3 * (1 - {t}) * {t} * {t} * {q} + {t} * {t} * {t}"
    (ax, ay), (bx, by) = fn.CURVES[name]
    return f"""lut AS (SELECT '{name}' AS curve, {at("s", ax, bx)} AS x0, {at("e", ax, bx)} AS x1, {at("s", ay, by)} AS y0, {at("e", ay, by)} AS y1 FROM (SELECT i / {_SAMPLES - 1}.0::DOUBLE AS s, (i + 1) / {_SAMPLES - 1}.0::DOUBLE AS e FROM (SELECT unnest(range({_SAMPLES - 1})) AS i)))"""


def _curve_query(name: str) -> str:
    return f"""{with_views("pixels")}, {_curve_sql(name)}, p AS (SELECT scene, frame, y, x, (v * 2 - 1 + 1.0) / 2.0 AS t FROM pixels)
SELECT scene, frame, y, x, round(CASE WHEN t >= 1 THEN 1.0 WHEN t < 0 THEN 0.0 ELSE y0 + (t - x0) * ((y1 - y0) / (x1 - x0)) END * 2.0 - 1.0, 6) AS curved FROM p LEFT JOIN lut ON t >= x0 AND t < x1"""


def _curved(spark, sf_dir, name: str):
    n = F.col("v") * 2 - 1
    curved = fn.lut((n + 1.0) / 2.0, *fn.curve_points(name, _SAMPLES)) * 2.0 - 1.0
    return rounded(pixels(spark, sf_dir).select("scene", "frame", "y", "x", curved.alias("curved")))


@query(_curve_query("high"))
def curve_lut(spark, sf_dir):
    """The high tone curve over [-1, 1], by look-up table."""
    return _curved(spark, sf_dir, "high")


@query(_curve_query("medium"))
def curve_lut_medium(spark, sf_dir):
    """The medium tone curve over [-1, 1], by look-up table."""
    return _curved(spark, sf_dir, "medium")


@query(_curve_query("low"))
def curve_lut_low(spark, sf_dir):
    """The low tone curve over [-1, 1], by look-up table."""
    return _curved(spark, sf_dir, "low")


@query("""SELECT p_partkey, round(3 * (1 - t) * (1 - t) * t * 0.25 + 3 * (1 - t) * t * t * 0.75 + t * t * t, 9) AS x, round(3 * (1 - t) * (1 - t) * t * 0.1 + 3 * (1 - t) * t * t * 1.0 + t * t * t, 9) AS y FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS t FROM part)""")
def bezier_points(spark, sf_dir):
    """Points of a cubic Bezier curve from (0, 0) to (1, 1) with given control points."""
    t = F.col("p_size") / F.lit(50.0)
    x, y = fn.bezier(t, (0.0, 0.0), (0.25, 0.1), (0.75, 1.0), (1.0, 1.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))


@query(f"""{with_views("pixels")} SELECT scene, frame, y, x, v > 0.12 AND v < 0.3 AS valid, v > 0.12 AND v >= 0.3 AS sky, y >= 3 AND y < 7 AND x >= 0 AND x < 7 AS garg, y >= 2 AND y < 7 AND x >= 0 AND x < 7 AS eigen FROM pixels""")
def eval_crop_mask(spark, sf_dir):
    """Valid range (exclusive), sky, and the two evaluation crops."""
    v, y, x = F.col("v"), F.col("y"), F.col("x")
    return pixels(spark, sf_dir).select("scene", "frame", "y", "x", fn.in_range(v, 0.12, 0.3).alias("valid"), fn.sky_mask(v, 0.12, 0.3).alias("sky"), fn.crop_mask("garg", y, x, 8, 8).alias("garg"), fn.crop_mask("eigen", y, x, 8, 8).alias("eigen"))


@query(f"""{with_views("pixels")} SELECT scene, frame, count(*) FILTER (v > 0.12 AND v < 0.3) AS n_valid, count(*) FILTER (v > 0.12 AND v < 0.3) = 0 AS empty FROM pixels GROUP BY scene, frame""")
def valid_range_mask(spark, sf_dir):
    """Valid pixels per frame; a frame without any is marked."""
    inside = fn.in_range(F.col("v"), 0.12, 0.3)
    return pixels(spark, sf_dir).groupBy("scene", "frame").agg(F.count_if(inside).alias("n_valid"), (F.count_if(inside) == 0).alias("empty"))


@query("""SELECT p_partkey, round(640.0 / (2.0 * tan(radians(p_size + 30) / 2.0)), 6) AS focal, round(degrees(2.0 * atan(640.0 / (2.0 * (640.0 / (2.0 * tan(radians(p_size + 30) / 2.0)))))), 6) AS fov FROM part""")
def fov_intrinsics(spark, sf_dir):
    """Field of view to focal length and back."""
    focal = fn.fov_to_focal(F.col("p_size") + 30, 640.0)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", focal.alias("focal"), fn.focal_to_fov(focal, 640.0).alias("fov")))


@query(f"""{with_views("pixels")} SELECT scene, frame, y, x, round((x + 0.5 - 4) / 7.0 * v, 6) AS px, round((y + 0.5 - 4) / 7.0 * v, 6) AS py, round(v, 6) AS pz FROM pixels""")
def unproject_points(spark, sf_dir):
    """Pixels to camera coordinates."""
    px, py, pz = fn.unproject(F.col("y"), F.col("x"), F.col("v"), 7.0, 4.0, 4.0)
    return rounded(pixels(spark, sf_dir).select("scene", "frame", "y", "x", px.alias("px"), py.alias("py"), pz.alias("pz")))


@query(f"""{with_views("pixels")} SELECT scene, frame, y, x, round(v * sqrt(((x + 0.5 - 4) / 7.0) * ((x + 0.5 - 4) / 7.0) + ((y + 0.5 - 4) / 7.0) * ((y + 0.5 - 4) / 7.0) + 1.0), 6) AS radial,
round(v / sqrt((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5) + 49.0) * 7.0, 6) AS planar FROM pixels""")
def radial_zbuffer(spark, sf_dir):
    """Planar depth to distance, and distance to planar depth."""
    y, x, v = F.col("y"), F.col("x"), F.col("v")
    return rounded(pixels(spark, sf_dir).select("scene", "frame", "y", "x", fn.z_to_radial(y, x, v, 7.0, 4.0, 4.0).alias("radial"), fn.distance_to_depth(y, x, v, 7.0, 8, 8).alias("planar")))


@query("""SELECT p_partkey, dataset, round(CASE dataset WHEN 'kitti' THEN CASE WHEN raw = 0 THEN -1 ELSE raw / 256.0 END WHEN 'nyu' THEN raw / 1000.0 WHEN 'bonn' THEN raw / 5000.0 WHEN 'vkitti' THEN raw / 100.0 END, 6) AS metres
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'kitti' WHEN 1 THEN 'nyu' WHEN 2 THEN 'bonn' ELSE 'vkitti' END AS dataset, CASE WHEN p_partkey % 12 = 0 THEN 0 ELSE p_size * 100 END AS raw FROM part)""")
def depth_decoders(spark, sf_dir):
    """Raw depth units to metres by dataset."""
    name = F.when(F.col("p_partkey") % 4 == 0, "kitti").when(F.col("p_partkey") % 4 == 1, "nyu").when(F.col("p_partkey") % 4 == 2, "bonn").otherwise("vkitti")
    raw = F.when(F.col("p_partkey") % 12 == 0, 0).otherwise(F.col("p_size") * 100)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", name.alias("dataset"), fn.decode_depth(name, raw).alias("metres")))


@query(f"""{with_views("pixels")}, m AS (SELECT *, min(v) OVER (PARTITION BY scene) AS lo, max(v) OVER (PARTITION BY scene) AS hi FROM pixels) SELECT scene, frame, y, x, round((v - lo) / (hi - lo + 1e-8), 6) AS n, (v - lo) / (hi - lo + 1e-8) * 255 >= 128 AS bright FROM m""")
def min_max_normalise(spark, sf_dir):
    """Per-clip min-max normalisation, as for an 8-bit dump."""
    w = Window.partitionBy("scene")
    n = fn.min_max(F.col("v"), F.min("v").over(w), F.max("v").over(w))
    return pixels(spark, sf_dir).select("scene", "frame", "y", "x", F.round(n, 6).alias("n"), (n * 255 >= 128).alias("bright"))
