"""Raster, alignment and blending queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import align, raster, windows
from ..sources.views import frames, pairs, pixels, rasters, with_views
from .registry import query, rounded

_P = ["scene", "frame", "y", "x"]


@query(f"""{with_views("pairs")}, d AS (SELECT scene, frame, (pred - lag(pred) OVER t) - (gt - lag(gt) OVER t) AS dt, (pred - lag(pred) OVER c) - (gt - lag(gt) OVER c) AS dy, (pred - lag(pred) OVER r) - (gt - lag(gt) OVER r) AS dx FROM pairs
WINDOW t AS (PARTITION BY scene, y, x ORDER BY frame), c AS (PARTITION BY scene, frame, x ORDER BY y), r AS (PARTITION BY scene, frame, y ORDER BY x))
SELECT scene, round(coalesce(avg(abs(dt)), 0) + avg(abs(dy)) + avg(abs(dx)), 6) AS l1, round(coalesce(avg(dt * dt), 0) + avg(dy * dy) + avg(dx * dx), 6) AS l2 FROM d GROUP BY scene""")
def grad_loss_3d(spark, sf_dir):
    """Gradient loss along time, height and width; the time term is 0 for one frame."""
    p = raster.differences(pairs(spark, sf_dir), "pred").withColumnsRenamed({a: f"p_{a}" for a in ("dt", "dy", "dx")})
    d = {a: F.col(f"p_{a}") - F.col(a) for a in ("dt", "dy", "dx")}
    q = raster.differences(p, "gt")
    mean = lambda f: F.coalesce(F.avg(f(d["dt"])), F.lit(0.0)) + F.avg(f(d["dy"])) + F.avg(f(d["dx"]))
    return rounded(q.groupBy("scene").agg(mean(F.abs).alias("l1"), mean(lambda x: x * x).alias("l2")))


@query(f"""{with_views("pixels")}, m AS (SELECT scene, frame, y, x, v, v = max(v) OVER (PARTITION BY scene, frame, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS peak_x, v = max(v) OVER (PARTITION BY scene, frame, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS peak_y FROM pixels)
SELECT scene, frame, y, x FROM m WHERE peak_x AND peak_y""")
def local_max_nms(spark, sf_dir):
    """Pixels that are maxima along both axes."""
    p = pixels(spark, sf_dir).withColumns({"px": raster.local_maximum("v", raster.rows()), "py": raster.local_maximum("v", raster.columns())})
    return p.where("px AND py").select(*_P)


@query(f"""{with_views("pixels")}, a AS (SELECT *, max(v) OVER (PARTITION BY scene, frame, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM pixels)
SELECT scene, frame, y, x, max(m) OVER (PARTITION BY scene, frame, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS dilated FROM a""")
def dilate_3x3(spark, sf_dir):
    """3 x 3 maximum."""
    return raster.box_max(pixels(spark, sf_dir), "v", 1, "dilated").select(*_P, "dilated")


@query(f"""{with_views("pixels")}, o AS (SELECT dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)),
g AS (SELECT a.scene, a.frame, a.y, a.x, sum(b.v * dx * (CASE WHEN dy = 0 THEN 2 ELSE 1 END)) AS gx, sum(b.v * dy * (CASE WHEN dx = 0 THEN 2 ELSE 1 END)) AS gy FROM pixels a, o JOIN pixels b ON b.scene = a.scene AND b.frame = a.frame AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL)
SELECT scene, frame, y, x, round(sqrt(gx * gx + gy * gy), 6) AS magnitude FROM g""")
def sobel_magnitude(spark, sf_dir):
    """Sobel gradient magnitude."""
    p = raster.sobel(pixels(spark, sf_dir), "v")
    return rounded(p.select(*_P, F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("magnitude")))


@query(f"""{with_views("pixels")}, g AS (SELECT scene, frame, y, x, -7.0 * (coalesce(lead(v) OVER r, 0) - coalesce(lag(v) OVER r, 0)) / 2 AS gx, -7.0 * (coalesce(lead(v) OVER c, 0) - coalesce(lag(v) OVER c, 0)) / 2 AS gy FROM pixels WINDOW r AS (PARTITION BY scene, frame, y ORDER BY x), c AS (PARTITION BY scene, frame, x ORDER BY y))
SELECT scene, frame, y, x, round(gx / sqrt(gx * gx + gy * gy + 1), 6) AS nx, round(gy / sqrt(gx * gx + gy * gy + 1), 6) AS ny, round(1 / sqrt(gx * gx + gy * gy + 1), 6) AS nz FROM g""")
def normals_cross(spark, sf_dir):
    """Unit normals from depth."""
    return rounded(raster.normals(pixels(spark, sf_dir), "v", 7.0).select(*_P, "nx", "ny", "nz"))


@query(f"""{with_views("pixels")} SELECT scene, frame, y // 2 AS by, x // 2 AS bx, round(avg(v), 6) AS mean FROM pixels GROUP BY scene, frame, y // 2, x // 2""")
def block_lowpass(spark, sf_dir):
    """2 x 2 block means."""
    return rounded(raster.block_means(pixels(spark, sf_dir), "v", 2))


@query(f"""{with_views("pixels")}, g AS (SELECT ny, nx, ny * 8 // 12 AS y, nx * 8 // 5 AS x FROM (SELECT unnest(range(12)) AS ny), (SELECT unnest(range(5)) AS nx))
SELECT scene, frame, ny AS y, nx AS x, v FROM pixels JOIN g USING (y, x)""")
def nearest_resize(spark, sf_dir):
    """Nearest-neighbour resize from 8 x 8 to 12 x 5."""
    return raster.nearest_resize(pixels(spark, sf_dir), "v", 8, 8, 12, 5)


@query(f"""{with_views("pixels")} SELECT scene, frame, y, 7 - x AS x, v FROM pixels""")
def horizontal_flip(spark, sf_dir):
    """Mirrored rasters."""
    return raster.flip(pixels(spark, sf_dir), 8)


_FIT = f"""{with_views("pairs")}, f AS (SELECT scene, coalesce(CASE WHEN isfinite(regr_slope(gt, pred) FILTER (valid)) THEN regr_slope(gt, pred) FILTER (valid) END, 1.0) AS scale, coalesce(CASE WHEN isfinite(regr_intercept(gt, pred) FILTER (valid)) THEN regr_intercept(gt, pred) FILTER (valid) END, 0.0) AS shift FROM pairs GROUP BY scene)"""


@query(f"{_FIT} SELECT scene, round(scale, 6) AS scale, round(shift, 6) AS shift FROM f")
def lsq_scale_shift(spark, sf_dir):
    """Least-squares scale and shift per clip over valid pixels."""
    return rounded(align.fit(pairs(spark, sf_dir), ["scene"]))


@query(f"""{with_views("pairs")} SELECT scene, round(sum(CASE WHEN valid THEN pred * gt ELSE 0 END) / (sum(CASE WHEN valid THEN pred * pred ELSE 0 END) + 1e-6), 6) AS scale FROM pairs GROUP BY scene""")
def scale_only_fit(spark, sf_dir):
    """Scale without shift."""
    return rounded(align.scale_only(pairs(spark, sf_dir), ["scene"]))


@query(f"""{with_views("pairs")}, s AS (SELECT scene, sum(pred * pred) AS a00, sum(pred) AS a01, count(*) AS a11, sum(pred * gt) AS b0, sum(gt) AS b1 FROM pairs WHERE valid GROUP BY scene)
SELECT scene, round(greatest(0.7, least(1.5, (a11 * b0 - a01 * b1) / (a00 * a11 - a01 * a01))), 6) AS scale, round((a00 * b1 - a01 * b0) / (a00 * a11 - a01 * a01), 6) AS shift FROM s""")
def guarded_affine_fit(spark, sf_dir):
    """Fit by normal equations with a guard against flat overlaps and a clipped scale."""
    return rounded(align.guarded_fit(pairs(spark, sf_dir), ["scene"]))


@query(f"""{_FIT} SELECT scene, frame, y, x, round(greatest(1e-6, greatest(0.5, least(8.0, 1.0 / greatest(1e-3, pred * scale + shift)))), 6) AS depth FROM pairs JOIN f USING (scene)""")
def aligned_depth(spark, sf_dir):
    """Predictions aligned in disparity and inverted to depth within limits."""
    p = pairs(spark, sf_dir)
    return rounded(p.join(align.fit(p, ["scene"]), "scene").select(*_P, align.to_depth(F.col("pred") * F.col("scale") + F.col("shift"), 0.5, 8.0).alias("depth")))


_TILES = """tiles AS (SELECT unnest([0, 3]) AS s), t AS (SELECT scene, frame, y, x, v * (1 + s * 0.01) AS v, s, s + 5 AS e FROM pixels, tiles WHERE x >= s AND x < s + 5)"""


@query(f"""{with_views("pixels")}, {_TILES}, w AS (SELECT *, least(1.0, CASE WHEN s > 0 THEN (x - s + 1) / 2.0 ELSE 1.0 END, CASE WHEN e < 8 THEN (e - x) / 2.0 ELSE 1.0 END) AS w FROM t)
SELECT scene, frame, y, x, round(sum(v * w) / sum(w), 6) AS v, count(*) AS n_tiles FROM w GROUP BY scene, frame, y, x""")
def feather_blend(spark, sf_dir):
    """Overlapping tiles blended with linear ramps."""
    t = _tiles(spark, sf_dir).withColumn("w", fn.ramp(F.col("x"), F.col("start"), F.col("end"), F.lit(8), 2))
    return rounded(align.blend(t, _P, "v", "w"))


def _tiles(spark, sf_dir):
    t = pixels(spark, sf_dir).select("*", F.inline(windows.windows(F.lit(8).cast("long"), 5, 2)))
    return t.where("x >= start AND x < end").withColumn("v", F.col("v") * (1 + F.col("start") * 0.01))


@query(f"""{with_views("pixels")}, {_TILES}, w AS (SELECT *, greatest(0.05, 1 - abs(x - s - 2.0) / 3.0) AS w FROM t)
SELECT scene, frame, y, x, round(sum(v * w) / sum(w), 6) AS v, count(*) AS n_tiles FROM w GROUP BY scene, frame, y, x""")
def tent_blend(spark, sf_dir):
    """Overlapping tiles blended with tents."""
    t = _tiles(spark, sf_dir).withColumn("w", fn.tent(F.col("x") - F.col("start"), 5))
    return rounded(align.blend(t, _P, "v", "w"))


@query(f"""{with_views("frames")}, l AS (SELECT scene, count(*) AS n FROM frames GROUP BY scene), m AS (SELECT *, CAST(ceil(greatest(n - 21, 0) / 16.0) AS BIGINT) AS m FROM l), i AS (SELECT *, unnest(range(m + 1)) AS i FROM m),
w AS (SELECT scene, n, i, CASE WHEN i < m THEN i * 16 ELSE greatest(0, n - 21) END AS s, CASE WHEN i < m THEN i * 16 + 21 ELSE n END AS e FROM i),
t AS (SELECT f.scene, f.frame_idx, f.depth + w.i AS v, least(1.0, CASE WHEN s > 0 THEN (frame_idx - s + 1) / 5.0 ELSE 1.0 END, CASE WHEN e < n THEN (e - frame_idx) / 5.0 ELSE 1.0 END) AS g FROM frames f JOIN w ON f.scene = w.scene AND frame_idx >= s AND frame_idx < e)
SELECT scene, frame_idx, round(sum(v * g) / sum(g), 6) AS v, count(*) AS n_tiles FROM t GROUP BY scene, frame_idx""")
def temporal_blend(spark, sf_dir):
    """Overlapping windows in time blended with ramps: frames generate the one or two windows that hold them."""
    f = frames(spark, sf_dir).select("scene", "frame_idx", "depth").withColumn("n", F.count("*").over(Window.partitionBy("scene")))
    t = f.select("*", F.inline(windows.windows_at(F.col("frame_idx"), F.col("n"), 21, 5)))
    t = t.select("scene", "frame_idx", (F.col("depth") + F.col("i")).alias("v"), fn.ramp(F.col("frame_idx"), F.col("start"), F.col("end"), F.col("n"), 5).alias("g"))
    return rounded(align.blend(t, ["scene", "frame_idx"], "v", "g"))


_STITCH = f"""{with_views("frames").replace("WITH ", "WITH RECURSIVE ", 1)}, l AS (SELECT scene, count(*) AS n FROM frames GROUP BY scene), m AS (SELECT *, CAST(ceil(greatest(n - 21, 0) / 16.0) AS BIGINT) AS m FROM l), i AS (SELECT *, unnest(range(m + 1)) AS i FROM m),
w AS (SELECT scene, n, i, CASE WHEN i < m THEN i * 16 ELSE greatest(0, n - 21) END AS s, CASE WHEN i < m THEN i * 16 + 21 ELSE n END AS e FROM i),
v AS (SELECT w.scene, w.i, any_value(s) AS s, any_value(e) AS e, list(f.depth * (1 + w.i * 0.05::DOUBLE) + w.i ORDER BY frame_idx) AS vs FROM frames f JOIN w ON f.scene = w.scene AND frame_idx >= s AND frame_idx < e GROUP BY w.scene, w.i),
c(scene, i, s, e, al) AS (SELECT scene, i, s, e, vs FROM v WHERE i = 0 UNION ALL
SELECT scene, i, s, e, list_concat(list_transform(range(o), lambda k: (1 - k / greatest(o - 1, 1)::DOUBLE) * ref[k + 1] + k / greatest(o - 1, 1)::DOUBLE * al[k + 1]), al[o + 1:]) FROM (
SELECT scene, i, s, e, o, ref, list_transform(vs, lambda x: greatest(x * scale + shift, 0)) AS al FROM (
SELECT *, greatest(0.7, least(1.5, CASE WHEN det <> 0 THEN (o * sxy - sx * sy) / det ELSE 1.0 END)) AS scale, CASE WHEN det <> 0 THEN (sxx * sy - sx * sxy) / det ELSE 0.0 END AS shift FROM (
SELECT *, sxx * o - sx * sx AS det FROM (
SELECT *, list_sum(cur) AS sx, list_sum(ref) AS sy, list_sum(list_transform(cur, lambda x: x * x)) AS sxx, list_sum(list_transform(range(o), lambda k: cur[k + 1] * ref[k + 1])) AS sxy FROM (
SELECT v.scene, v.i, v.s, v.e, v.vs, c.e - v.s AS o, c.al[len(c.al) - (c.e - v.s) + 1:] AS ref, v.vs[1:c.e - v.s] AS cur FROM c JOIN v ON v.scene = c.scene AND v.i = c.i + 1))))))
SELECT scene, s + k AS pos, round(al[k + 1], 4) AS value FROM (SELECT *, unnest(range(coalesce(nxt, e) - s)) AS k FROM (SELECT *, lead(s) OVER (PARTITION BY scene ORDER BY i) AS nxt FROM c))"""


@query(_STITCH)
def window_stitch(spark, sf_dir):
    """Windows aligned to the canvas stitched so far and cross-faded: a scene streams, and its values are final once no later window covers them."""
    f = frames(spark, sf_dir).select("scene", "frame_idx", "depth").withColumn("n", F.count("*").over(Window.partitionBy("scene")))
    w = f.select("*", F.inline(windows.windows_at(F.col("frame_idx"), F.col("n"), 21, 5)))
    values = w.select("scene", "start", "end", F.col("frame_idx").alias("pos"), (F.col("depth") * (1 + F.col("i") * 0.05) + F.col("i")).alias("value"))
    return rounded(align.stitch(values, "scene"), 4)


@query(f"""{_FIT} SELECT scene, round(avg(abs(pred * scale + shift - gt)), 6) AS mae, count(*) AS n FROM pairs JOIN f USING (scene) WHERE valid GROUP BY scene""")
def overlap_mae(spark, sf_dir):
    """Mean absolute difference behind the alignment."""
    p = pairs(spark, sf_dir)
    a = p.join(align.fit(p, ["scene"]), "scene").where("valid")
    return rounded(a.groupBy("scene").agg(F.avg(F.abs(F.col("pred") * F.col("scale") + F.col("shift") - F.col("gt"))).alias("mae"), F.count("*").alias("n")))


@query("""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda e: abs(CAST(e AS DOUBLE)) + 0.1) AS vs FROM embeddings)
SELECT vec_id, round(list_sum(vs), 6) AS total, round(list_max(vs), 6) AS top, round(vs[10], 6) AS picked FROM v""")
def array_gather(spark, sf_dir):
    """Array-level reductions and a gather by position, without exploding pixels."""
    r = rasters(spark, sf_dir)
    return rounded(r.select("vec_id", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_max("values").alias("top"), F.element_at("values", 10).alias("picked")))
