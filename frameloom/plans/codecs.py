"""Codec and whole-raster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tensors
from ..sources import codecs
from ..sources.views import rasters, table
from .registry import query, rounded

_VALUES = "SELECT vec_id, list_transform(embedding, lambda e: abs(CAST(e AS DOUBLE)) + 0.1) AS vs FROM embeddings"


def _through(spark, sf_dir, codec):
    r = rasters(spark, sf_dir).select("vec_id", "values")
    back = codecs.decoded(codecs.encoded(r, codec, 8, 8), codec)
    return back.select("vec_id", "h", "w", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.element_at("values", 9), 5).alias("second_row"))


def _sql():
    return f"SELECT vec_id, CAST(8 AS BIGINT) AS h, CAST(8 AS BIGINT) AS w, round(list_sum(list_transform(vs, lambda v: CAST(CAST(v AS FLOAT) AS DOUBLE))), 4) AS total, round(CAST(CAST(vs[9] AS FLOAT) AS DOUBLE), 5) AS second_row FROM ({_VALUES})"


@query(_sql())
def codec_depth_roundtrip(spark, sf_dir):
    """Rasters through the tagged depth format and back."""
    return _through(spark, sf_dir, "dpt")


@query(_sql())
def codec_pfm_roundtrip(spark, sf_dir):
    """Rasters through PFM and back, with its flipped rows."""
    return _through(spark, sf_dir, "pfm")


@query("SELECT p_partkey, r * 4.0 + g / 64.0 + b / 16384.0 AS disparity, CAST((r * 256 + g) * 256 + b AS BIGINT) AS segment FROM (SELECT p_partkey, p_partkey % 256 AS r, (p_partkey * 7) % 256 AS g, p_size % 256 AS b FROM part)")
def packed_images(spark, sf_dir):
    """Disparities and segment numbers packed into three bytes."""
    r, g, b = F.col("p_partkey") % 256, (F.col("p_partkey") * 7) % 256, F.col("p_size") % 256
    return table(spark, sf_dir, "part").select("p_partkey", codecs.unpack_disparity(r, g, b).cast("double").alias("disparity"), codecs.unpack_segment(r, g, b).cast("long").alias("segment"))


def _mapped(spark, sf_dir, f, n=1):
    r = tensors.map_rasters(rasters(spark, sf_dir).select("vec_id", "values"), f, 8, 8)
    return rounded(r.select("vec_id", F.size("values").cast("long").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")))


def _taps(n: int, m: int, name: str) -> str:
    """How much each of n values counts in all m values of a bilinear resize along an axis."""
    at = f"greatest(0.0, least({n - 1}.0, (i + 0.5) * {n} / {m}.0 - 0.5))::DOUBLE"
    return f"""{name} AS (SELECT CAST(p AS BIGINT) AS p, sum(w) AS w FROM (SELECT floor({at}) AS p, 1 - ({at} - floor({at})) AS w FROM range({m}) AS r(i) UNION ALL SELECT least(floor({at}) + 1, {n - 1}), {at} - floor({at}) FROM range({m}) AS r(i)) GROUP BY p)"""


_PIXELS = f"px AS (SELECT vec_id, CAST((pos - 1) // 8 AS BIGINT) AS y, CAST((pos - 1) % 8 AS BIGINT) AS x, v FROM (SELECT vec_id, unnest(vs) AS v, generate_subscripts(vs, 1) AS pos FROM ({_VALUES})))"


@query(f"WITH {_PIXELS}, {_taps(8, 13, 'ty')}, {_taps(8, 5, 'tx')} SELECT vec_id, CAST(65 AS BIGINT) AS n, round(sum(v * ty.w * tx.w), 6) AS total FROM px JOIN ty ON ty.p = y JOIN tx ON tx.p = x GROUP BY vec_id")
def bilinear_resize(spark, sf_dir):
    """Rasters resized to 13 x 5."""
    return _mapped(spark, sf_dir, lambda a: tensors.bilinear(a, 13, 5))


@query(f"""WITH {_PIXELS}, {_taps(4, 8, 't')}, b AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM px GROUP BY ALL), low AS (SELECT vec_id, sum(v * ty.w * tx.w) AS low FROM b JOIN t ty ON ty.p = y JOIN t tx ON tx.p = x GROUP BY vec_id)
SELECT vec_id, CAST(64 AS BIGINT) AS n, round(2 * sum(v) - any_value(low), 6) AS total FROM px JOIN low USING (vec_id) GROUP BY vec_id""")
def band_merge(spark, sf_dir):
    """A raster's detail on its mirror image's low band."""
    return _mapped(spark, sf_dir, lambda a: tensors.band_merge(a[:, ::-1], a, 2))


@query(f"""WITH RECURSIVE {_PIXELS}, m AS (SELECT vec_id, y, x FROM px WHERE v > 0.2), r(vec_id, y, x, py, qx) AS (SELECT vec_id, y, x, y, x FROM m UNION SELECT r.vec_id, r.y, r.x, m.y, m.x FROM r JOIN m ON m.vec_id = r.vec_id AND abs(m.y - r.py) <= 1 AND abs(m.x - r.qx) <= 1),
a AS (SELECT vec_id, y, x, count(*) AS area FROM r GROUP BY ALL) SELECT e.vec_id, CAST(64 AS BIGINT) AS n, CAST(count(*) FILTER (area >= 4) AS DOUBLE) AS total FROM embeddings e LEFT JOIN a USING (vec_id) GROUP BY e.vec_id""")
def component_filter(spark, sf_dir):
    """Connected components of at least four pixels."""
    return _mapped(spark, sf_dir, lambda a: tensors.keep_large_components(a > 0.2, 4))


@query(f"""WITH {_PIXELS}, o AS (SELECT dy, dx FROM range(-2, 3) AS a(dy), range(-2, 3) AS b(dx)), c AS (SELECT vec_id, y, x, greatest(0, least(7, y + dy)) AS yy, greatest(0, least(7, x + dx)) AS xx FROM px, o),
m AS (SELECT c.vec_id, c.y, c.x, quantile_cont(px.v, 0.5) AS v FROM c JOIN px ON px.vec_id = c.vec_id AND px.y = yy AND px.x = xx GROUP BY ALL) SELECT vec_id, CAST(64 AS BIGINT) AS n, round(sum(v), 6) AS total FROM m GROUP BY vec_id""")
def median_filter(spark, sf_dir):
    """5 x 5 medians."""
    return _mapped(spark, sf_dir, tensors.median_filter)


@query()
def plane_normals(spark, sf_dir):
    """Normals from local planes."""
    return _mapped(spark, sf_dir, lambda a: tensors.plane_normals(a, 7.0))
