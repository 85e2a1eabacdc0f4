"""Queries over rasters in tiles: the frames of a scene stacked to one tall raster, cut into tiles that exchange borders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import poisson, tiles
from ..sources.views import pixels, with_views
from .registry import query, rounded

#: Tiles are smaller than a frame, so seams run through frames.
_SIZE = 5
_MOSAIC = f"""{with_views("pixels")}, m AS (SELECT scene, frame * 8 + y AS y, x, v FROM pixels)"""


def _mosaic(spark, sf_dir):
    return pixels(spark, sf_dir).select("scene", (F.col("frame") * 8 + F.col("y")).alias("y"), "x", "v")


def _mapped(spark, sf_dir, f):
    cut = tiles.cut(_mosaic(spark, sf_dir), ["scene"], ["v"], _SIZE)
    out = tiles.uncut(tiles.map_tiles(cut, ["scene"], f, _SIZE), ["scene"], list(f.outputs), _SIZE)
    return rounded(out)


@query(f"""{_MOSAIC}, o AS (SELECT dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)),
g AS (SELECT a.scene, a.y, a.x, sum(b.v * dx * (CASE WHEN dy = 0 THEN 2 ELSE 1 END)) AS gx, sum(b.v * dy * (CASE WHEN dx = 0 THEN 2 ELSE 1 END)) AS gy FROM m a, o JOIN m b ON b.scene = a.scene AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL)
SELECT scene, y, x, round(sqrt(gx * gx + gy * gy), 6) AS magnitude FROM g""")
def tiled_sobel(spark, sf_dir):
    """Sobel gradients of rasters larger than a row, zeros outside."""

    def run(a):
        at = lambda dy, dx: tiles.shifted(a["v"], 1, dy, dx)
        gx = sum(w * (at(dy, 1) - at(dy, -1)) for dy, w in ((-1, 1), (0, 2), (1, 1)))
        gy = sum(w * (at(1, dx) - at(-1, dx)) for dx, w in ((-1, 1), (0, 2), (1, 1)))
        return {"magnitude": np.sqrt(gx * gx + gy * gy)}

    return _mapped(spark, sf_dir, tiles.TileFunction(("v",), ("magnitude",), run, 1, 0.0))


@query(f"""{_MOSAIC}, e AS (SELECT scene, max(y) AS top FROM m GROUP BY scene), o AS (SELECT dy, dx FROM range(-2, 3) AS a(dy), range(-2, 3) AS b(dx)),
n AS (SELECT m.scene, m.y, m.x, m.v, greatest(0, least(top, m.y + dy)) AS yy, greatest(0, least(7, m.x + dx)) AS xx FROM m JOIN e USING (scene), o),
l AS (SELECT n.scene, n.y, n.x, any_value(n.v) AS v, avg(b.v) AS low FROM n JOIN m b ON b.scene = n.scene AND b.y = yy AND b.x = xx GROUP BY n.scene, n.y, n.x)
SELECT scene, y, x, round(low, 6) AS low, round(v - low, 6) AS detail FROM l""")
def tile_function(spark, sf_dir):
    """A function of batches of tiles with two declared outputs: 5 x 5 means with repeated edges, and what they leave."""

    def run(a):
        low = sum(tiles.shifted(a["v"], 2, dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)) / 25
        return {"low": low, "detail": tiles.shifted(a["v"], 2, 0, 0) - low}

    return _mapped(spark, sf_dir, tiles.TileFunction(("v",), ("low", "detail"), run, 2))


@query(f"""{_MOSAIC}, e AS (SELECT scene, max(y) AS top FROM m GROUP BY scene), b AS (SELECT a.scene, a.y, a.x, a.v AS t, b.v AS s FROM m a JOIN m b ON b.scene = a.scene AND b.y = a.y AND b.x = 7 - a.x),
n AS (SELECT scene, y, x, t, 4 * s - lag(s) OVER r - lead(s) OVER r - lag(s) OVER c - lead(s) OVER c AS lap, t > 0.15 AND y > 0 AND y < top AND x > 0 AND x < 7 AS inside FROM b JOIN e USING (scene) WINDOW r AS (PARTITION BY scene, y ORDER BY x), c AS (PARTITION BY scene, x ORDER BY y))
SELECT scene, y, x, inside, round(CASE WHEN inside THEN lap ELSE t END, 3) + 0.0 AS value FROM n""")
def poisson_blend(spark, sf_dir):
    """A mirrored raster blended in by gradients, over tiles: at each pixel inside the Laplacian of the result, outside its value."""
    m = _mosaic(spark, sf_dir)
    mirror = m.select("scene", "y", (7 - F.col("x")).alias("x"), F.col("v").alias("source"))
    both = m.join(mirror, ["scene", "y", "x"]).select("scene", "y", "x", "source", F.col("v").alias("target"), (F.col("v") > 0.15).cast("double").alias("mask"))
    cut = tiles.cut(both, ["scene"], ["source", "target", "mask"], 16)
    blended, _ = poisson.blend(cut, ["scene"], 16, tolerance=1e-10)
    p = tiles.uncut(blended, ["scene"], ["inside", "blended"], 16)
    v, r, c = F.col("blended"), Window.partitionBy("scene", "y").orderBy("x"), Window.partitionBy("scene", "x").orderBy("y")
    applied = 4 * v - F.lag(v).over(r) - F.lead(v).over(r) - F.lag(v).over(c) - F.lead(v).over(c)
    return p.select("scene", "y", "x", (F.col("inside") > 0).alias("inside"), (F.round(F.when(F.col("inside") > 0, applied).otherwise(v), 3) + 0.0).alias("value"))
