"""Queries of occlusion, stroke masks, colour jitter and resizing of mixed sizes."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from ..functions import colour
from ..operators import occlusion, resample, shapes, tensors
from ..sources.views import pixels, rasters, table, with_views
from .registry import h, query, rounded

_P = ["scene", "frame", "y", "x"]
_SPLAT = f"""{{recursive}}, s AS (SELECT scene, frame, y, x AS from_x, CAST(floor(x - v * 6 + 0.5) AS BIGINT) AS x, v, row_number() OVER (PARTITION BY scene, frame, y, CAST(floor(x - v * 6 + 0.5) AS BIGINT) ORDER BY v * 6 DESC, x) AS r FROM pixels),
shown AS (SELECT p.scene, p.frame, p.y, p.x, s.from_x, s.v, s.from_x IS NULL AS hole FROM pixels p LEFT JOIN s ON s.scene = p.scene AND s.frame = p.frame AND s.y = p.y AND s.x = p.x AND s.r = 1)"""
_VIEW = with_views("pixels")


def _splatted(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumn("d", F.col("v") * 6)
    return occlusion.splat(p, ["scene", "frame"], "d", "v")


@query(_SPLAT.format(recursive=_VIEW) + " SELECT scene, frame, y, x, from_x, round(v, 6) AS v, hole FROM shown")
def occlusion_splat(spark, sf_dir):
    """The other view of each raster by its disparities: the nearest pixel wins, and what none reaches is a hole."""
    return rounded(_splatted(spark, sf_dir).select(*_P, "from_x", "v", "hole"))


def _cleaned_sql(first: int, area: int, rounds: int) -> str:
    """The clean-up as sets of pixels: grown, without small components, and shrunk to the pixels whose six neighbours are set."""
    steps = ["h AS (SELECT scene, frame, y, x FROM shown WHERE hole)"]
    grow = lambda a, b: f"{b} AS (SELECT DISTINCT scene, frame, y + dy AS y, x + dx AS x FROM {a}, range(-1, 2) AS i(dy), range(-1, 2) AS j(dx) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7)"
    shrink = lambda a, b: f"{b} AS (SELECT scene, frame, y - dy AS y, x - dx AS x FROM {a}, range(-1, 2) AS i(dy), range(0, 2) AS j(dx) WHERE y - dy BETWEEN 0 AND 7 AND x - dx BETWEEN 0 AND 7 GROUP BY ALL HAVING count(*) = 6)"

    def keep(a: str, b: str, least: int) -> str:
        return f"""{b}r(scene, frame, y, x, py, qx) AS (SELECT scene, frame, y, x, y, x FROM {a} UNION SELECT r.scene, r.frame, r.y, r.x, m.y, m.x FROM {b}r r JOIN {a} m ON m.scene = r.scene AND m.frame = r.frame AND abs(m.y - r.py) <= 1 AND abs(m.x - r.qx) <= 1),
{b} AS (SELECT scene, frame, y, x FROM {b}r GROUP BY ALL HAVING count(*) >= {least})"""

    steps += [grow("h", "g1"), grow("g1", "g2"), keep("g2", "k0", first)]
    for i in range(rounds):
        steps += [shrink(f"k{i}", f"d{i}"), keep(f"d{i}", f"e{i}", area), grow(f"e{i}", f"k{i + 1}")]
    return ",\n".join(steps)


@query(_SPLAT.format(recursive=_VIEW.replace("WITH ", "WITH RECURSIVE ", 1)) + f""", {_cleaned_sql(7, 5, 2)},
o AS (SELECT scene, frame, count(*) AS n, CAST(sum(y * 8 + x) AS BIGINT) AS places FROM k2 GROUP BY ALL) SELECT a.scene, a.frame, count(*) FILTER (hole) AS n_holes, coalesce(any_value(o.n), 0) AS n_occluded, coalesce(any_value(o.places), 0) AS places FROM shown a LEFT JOIN o USING (scene, frame) GROUP BY a.scene, a.frame""")
def occlusion_mask(spark, sf_dir):
    """The splat's holes cleaned up: grown, shrunk by the directional kernel, and without small components, in rounds."""
    row = F.array_sort(F.collect_list(F.struct("y", "x", "hole")))  # a raster's pixels
    masks = _splatted(spark, sf_dir).groupBy("scene", "frame").agg(row.alias("p")).select("scene", "frame", F.transform("p", lambda p: p["hole"].cast("double")).alias("holes"))
    cleaned = tensors.map_rasters(masks.withColumn("mask", F.col("holes")), lambda a: occlusion.clean(a, 7, 5, 2), 8, 8, "mask")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x).cast("long")
    places = F.transform("mask", lambda x, i: x * i)
    return cleaned.select("scene", "frame", total("holes").alias("n_holes"), total("mask").alias("n_occluded"), total(places).alias("places"))


_H, _W = 24, 32
_CENTRE = "8.137 + p_partkey % 16 AS cx, 4.291 + (p_partkey * 7) % 12 AS cy, (p_partkey % 10) / 10.0::DOUBLE AS turn, (1.2137 + (p_size % 4) * 0.3719) / 2 AS r"
_POINTS = f"""WITH p AS (SELECT p_partkey, p_size, {_CENTRE} FROM part),
pts AS (SELECT p_partkey, r, 0 AS part, i, (3.1 + p_size % 4 + (0.5 + (p_size % 3) * 0.2) * sin((3 + p_partkey % 4) * a)) * cos(a + turn * pi()) * (0.8 + (p_size % 5) * 0.1) + cx AS x, (3.1 + p_size % 4 + (0.5 + (p_size % 3) * 0.2) * sin((3 + p_partkey % 4) * a)) * sin(a + turn * pi()) * (1.0 + (p_size % 3) * 0.2) + cy AS y
  FROM (SELECT *, i * (2 * pi() / 23) AS a FROM p, range(24) AS g(i) WHERE p_size % 2 = 0)
UNION ALL SELECT p_partkey, r, 0, i, 2.3 * sin(a) + cx, 2.7 * cos(a) + cy FROM (SELECT *, i * (2 * pi() / 11) AS a FROM p, range(12) AS g(i) WHERE p_size % 2 = 1)
UNION ALL SELECT p_partkey, r, k + 1, 12 + k * 4 + i, x0 + (x1 - x0) * s + sin(a + turn * pi()) * 0.3, y0 + (y1 - y0) * s + cos(a + turn * pi()) * 0.3 FROM (
  SELECT p_partkey, r, turn, k, i, i * (2 * pi() / 3) AS a, i * (2 * pi() / 3) / (2 * pi()) AS s, cx + 2.3 * [-0.8, 0.8, 1.2, -1.2][k + 1] AS x0, cx + 2.3 * [0.8, 1.2, -1.2, -0.8][k + 1] AS x1, cy + 2.7 * CASE WHEN k < 2 THEN 1 ELSE b END AS y0, cy + 2.7 * CASE WHEN k IN (0, 3) THEN 1 ELSE b END AS y1
  FROM (SELECT *, 3.5 + (p_size % 4) * 0.5 AS b FROM p WHERE p_size % 2 = 1), range(4) AS u(k), range(4) AS g(i))),
seg AS (SELECT p_partkey, r, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM pts WINDOW w AS (PARTITION BY p_partkey ORDER BY i)),
near AS (SELECT *, greatest(0.0, least(1.0, ((gx + 0.5 - x0) * (x1 - x0) + (gy + 0.5 - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS s FROM seg, range({_H}) AS i(gy), range({_W}) AS j(gx) WHERE x1 IS NOT NULL AND gy + 0.5 BETWEEN least(y0, y1) - r AND greatest(y0, y1) + r AND gx + 0.5 BETWEEN least(x0, x1) - r AND greatest(x0, x1) + r),
hit AS (SELECT DISTINCT p_partkey, gy, gx FROM near WHERE (gx + 0.5 - x0 - s * (x1 - x0)) * (gx + 0.5 - x0 - s * (x1 - x0)) + (gy + 0.5 - y0 - s * (y1 - y0)) * (gy + 0.5 - y0 - s * (y1 - y0)) <= r * r)"""


@query(f"{_POINTS} SELECT p_partkey, count(*) AS n, CAST(sum(gy * {_W} + gx) AS BIGINT) AS places FROM hit GROUP BY p_partkey")
def stroke_masks(spark, sf_dir):
    """Wavy circles and figures stroked with a line, a shape for each part, as the pixels that the line covers."""
    k, n, d = F.col("p_partkey"), F.col("p_size"), lambda x: F.lit(float(x))
    cx, cy, turn = 8.137 + k % 16, 4.291 + (k * 7) % 12, (k % 10) / d(10)
    circle = shapes.wavy_circle(cx, cy, 3.1 + n % 4, 0.5 + (n % 3) * 0.2, 3 + k % 4, 0.8 + (n % 5) * 0.1, 1.0 + (n % 3) * 0.2, turn, 24)
    figure = shapes.humanoid(cx, cy, d(2.3), d(2.7), 3.5 + (n % 4) * 0.5, d(0.3), turn, 12, 4)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # a few bytes a row, and much work
    drawn = parts.select("p_partkey", F.when(n % 2 == 0, circle).otherwise(figure).alias("points"), (1.2137 + (n % 4) * 0.3719).alias("width"))
    hit = shapes.rasterise(drawn, ["p_partkey"], "points", "width", (_H, _W))
    return hit.groupBy("p_partkey").agg(F.count("*").alias("n"), F.sum(F.col("y") * _W + F.col("x")).cast("long").alias("places"))


_SEED, _KEEP, _STRENGTH = 5, 3, {"brightness": 0.3, "contrast": 0.4, "saturation": 0.5, "hue": 0.2}


def _jitter_sql() -> str:
    """Each step of the jitter over a row per pixel; hues and greys as plain arithmetic."""
    key = ("scene", f"CAST(floor(frame / {_KEEP}) AS BIGINT)", f"{_SEED}")
    unit = lambda kind, low, high: f"{low} + ({high} - {low}) * ({h(*key, repr(kind))} / 4294967296.0::DOUBLE)"
    spans = {k: (1 - s, 1 + s) if k != "hue" else (-s, s) for k, s in _STRENGTH.items()}
    factors = ", ".join(f"{unit(k, *spans[k])} AS {k}" for k in colour.KINDS)
    orders = str([[*o] for o in permutations(range(4))])
    ctes = [f"f AS (SELECT DISTINCT scene, frame, {factors}, {unit('kelvin', 3000.0, 15000.0)} AS kelvin, {orders}[{h(*key, repr('order'))} % 24 + 1] AS steps FROM pixels)",
            "s0 AS (SELECT scene, frame, y, x, least(v, 1.0) AS r, least(v * v, 1.0) AS g, 1 - least(v, 1.0) AS b FROM pixels)"]
    clamp = lambda e: f"greatest(0.0, least(1.0, {e}))"
    for i in range(4):
        grey = "0.299 * r + 0.587 * g + 0.114 * b"
        ctes.append(f"""a{i} AS (SELECT *, {grey} AS grey, avg({grey}) OVER (PARTITION BY scene, frame) AS mean, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS span, steps[{i + 1}] AS kind FROM s{i} JOIN f USING (scene, frame)),
t{i} AS (SELECT *, CASE WHEN span = 0 THEN 0.0 WHEN top = r THEN (g - b) / span WHEN top = g THEN (b - r) / span + 2 ELSE (r - g) / span + 4 END / 6 AS hue0, CASE WHEN top = 0 THEN 0.0 ELSE span / top END AS sat FROM a{i}),
u{i} AS (SELECT *, hue0 - floor(hue0) + hue AS turned FROM t{i}), v{i} AS (SELECT *, (turned - floor(turned)) * 6 AS six FROM u{i})""")
        out = []
        for c, n in (("r", 5), ("g", 3), ("b", 1)):
            k = f"(({n} + six) % 6)"
            out.append(f"""CASE kind WHEN 0 THEN {clamp(f"brightness * {c}")} WHEN 1 THEN {clamp(f"contrast * {c} + (1 - contrast) * mean")} WHEN 2 THEN {clamp(f"saturation * {c} + (1 - saturation) * grey")} ELSE top - top * sat * greatest(0.0, least({k}, 4 - {k}, 1.0)) END AS {c}""")
        ctes.append(f"s{i + 1} AS (SELECT scene, frame, y, x, {', '.join(out)} FROM v{i})")
    wave = lambda w, t: f"(1.0 / (exp({colour.RADIATION / w!r} / {t}) - 1.0))"
    gain = lambda w: f"{wave(w, 'kelvin')} / {wave(colour.WAVES[1], 'kelvin')} / ({wave(w, colour.WHITE)} / {wave(colour.WAVES[1], colour.WHITE)})"
    return f"{_VIEW}, {', '.join(ctes)} SELECT scene, frame, round(sum(least(1.0, r * {gain(colour.WAVES[0])})), 6) AS red, round(sum(g), 6) AS green, round(sum(least(1.0, b * {gain(colour.WAVES[2])})), 6) AS blue FROM s4 JOIN f USING (scene, frame) GROUP BY scene, frame"


@query(_jitter_sql())
def colour_jitter(spark, sf_dir):
    """Images changed in brightness, contrast, saturation, hue and white, by parameters that hold for three frames of a clip."""
    unit = F.transform("values", lambda v: colour.pixel(F.least(v, F.lit(1.0)), F.least(v * v, F.lit(1.0)), 1 - F.least(v, F.lit(1.0))))
    keyed = rasters(spark, sf_dir).select("scene", "frame", unit.alias("image"), colour.jitter_parameters(F.col("scene"), F.col("frame"), _KEEP, _SEED, **_STRENGTH).alias("p"))
    out = keyed.select("scene", "frame", colour.jitter(F.col("image"), F.col("p")).alias("image"), colour.black_body_gains(F.col("p.kelvin")).alias("gains"))
    total = lambda f: F.aggregate("image", F.lit(0.0), lambda a, p: a + f(p))
    lit = lambda c: lambda p: F.least(p[c] * F.col("gains")[c], F.lit(1.0))
    return rounded(out.select("scene", "frame", total(lit("r")).alias("red"), total(lambda p: p["g"]).alias("green"), total(lit("b")).alias("blue")))


_SHAPES, _TO = ((8, 8), (4, 16), (16, 4), (2, 32)), (6, 10)


def _resized_sql(method: str) -> str:
    """Every output pixel as a sum over all input pixels by their weights."""
    scale, centre = "n / CAST(m AS DOUBLE)", "((o + 0.5) * (n / CAST(m AS DOUBLE)) - 0.5)"
    if method == "nearest":
        each = f"SELECT n, m, o, o * n // m AS k, 1.0 AS w FROM g"
    elif method == "area":
        each = f"SELECT n, m, o, k, greatest(0.0, least(k + 1.0, (o + 1) * {scale}) - greatest(CAST(k AS DOUBLE), o * {scale})) / ({scale}) AS w FROM g, range(32) AS r(k) WHERE k < n"
    else:
        reach = 1 if method == "linear" else 2
        d, a = f"abs({centre} - k)", resample.CUBIC
        weight = f"1 - {d}" if method == "linear" else f"CASE WHEN {d} <= 1 THEN (({a} + 2) * {d} - ({a} + 3)) * {d} * {d} + 1 ELSE (({a} * {d} - 5 * {a}) * {d} + 8 * {a}) * {d} - 4 * {a} END"
        each = f"SELECT n, m, o, k, {weight} AS w FROM (SELECT *, CAST(floor({centre}) AS BIGINT) + j AS k FROM g, range({1 - reach}, {reach + 1}) AS r(j))"
    sizes = " UNION ALL ".join(f"SELECT {n} AS n, {m} AS m" for k, m in enumerate(_TO) for n in sorted({s[k] for s in _SHAPES}))
    size = lambda k: f"[{', '.join(str(s[k]) for s in _SHAPES)}][vec_id % 4 + 1]"
    return f"""WITH g AS (SELECT n, m, o FROM ({sizes}), range(10) AS r(o) WHERE o < m), t AS (SELECT n, m, o, greatest(0, least(n - 1, k)) AS k, sum(w) AS w FROM ({each}) GROUP BY ALL),
q AS (SELECT vec_id, h, w, (pos - 1) // w AS y, (pos - 1) % w AS x, v FROM (SELECT vec_id, {size(0)} AS h, {size(1)} AS w, unnest(list_transform(embedding, lambda e: abs(CAST(e AS DOUBLE)) + 0.1)) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings))
SELECT vec_id, a.o AS y, b.o AS x, round(sum(v * a.w * b.w), 5) AS v FROM q JOIN t a ON a.n = h AND a.m = {_TO[0]} AND a.k = y JOIN t b ON b.n = q.w AND b.m = {_TO[1]} AND b.k = x GROUP BY ALL"""


def _resized(spark, sf_dir, method):
    flat = rasters(spark, sf_dir).select("vec_id", F.posexplode("values").alias("pos", "v"))
    size = lambda k: F.element_at(F.array(*[F.lit(s[k]).cast("long") for s in _SHAPES]), (F.col("vec_id") % 4 + 1).cast("int"))
    p = flat.select("vec_id", size(0).alias("h"), size(1).alias("w"), "pos", "v").select("vec_id", "h", "w", F.floor(F.col("pos") / F.col("w")).alias("y"), (F.col("pos") % F.col("w")).alias("x"), "v")
    return rounded(resample.resize(p, ["vec_id"], "h", "w", ["v"], _TO, method), 5)


@query(_resized_sql("area"))
def mixed_resize_area(spark, sf_dir):
    """Rasters of four sizes resized to one, by the area that each pixel covers."""
    return _resized(spark, sf_dir, "area")


@query(_resized_sql("cubic"))
def mixed_resize_cubic(spark, sf_dir):
    """Rasters of four sizes resized to one with cubic weights."""
    return _resized(spark, sf_dir, "cubic")


@query(_resized_sql("linear"))
def mixed_resize_linear(spark, sf_dir):
    """Rasters of four sizes resized to one with linear weights."""
    return _resized(spark, sf_dir, "linear")


@query(_resized_sql("nearest"))
def mixed_resize_nearest(spark, sf_dir):
    """Rasters of four sizes resized to one by their nearest pixels."""
    return _resized(spark, sf_dir, "nearest")
