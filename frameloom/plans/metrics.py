"""Error metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import metrics, raster
from ..sources.views import pairs, pixels, with_views
from .registry import query, rounded

_FRAMES = f"""{with_views("pairs")}, f AS (SELECT scene, frame, avg(abs(pred - gt) / gt) AS abs_rel, avg((pred - gt) * (pred - gt) / gt) AS sq_rel, sqrt(avg((pred - gt) * (pred - gt))) AS rmse,
  sqrt(avg((ln(pred) - ln(gt)) * (ln(pred) - ln(gt)))) AS rmse_log, {", ".join(f"avg(CASE WHEN greatest(pred / gt, gt / pred) < {1.25**k!r} THEN 1.0 ELSE 0.0 END) AS delta{k}" for k in (1, 2, 3))},
  sqrt(avg((1 / pred - 1 / gt) * (1 / pred - 1 / gt))) AS i_rmse, avg((ln(pred) - ln(gt)) * (ln(pred) - ln(gt))) - avg(ln(pred) - ln(gt)) * avg(ln(pred) - ln(gt)) AS lv FROM pairs WHERE valid GROUP BY scene, frame)"""


def _metric(name: str, columns: list[str]):
    @query(f"{_FRAMES} SELECT scene, {', '.join(f'round(avg({c}), 6) AS {c}' for c in columns)} FROM f GROUP BY scene")
    def run(spark, sf_dir):
        return rounded(metrics.summary(pairs(spark, sf_dir)).select("scene", *columns))

    from .registry import ORACLES, QUERIES

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")
    run.__doc__ = f"Frame means of {', '.join(columns)}."


for _name, _columns in {"metric_abs_rel": ["abs_rel"], "metric_sq_rel": ["sq_rel"], "metric_rmse": ["rmse"], "metric_rmse_log": ["rmse_log"], "metric_delta": ["delta1", "delta2", "delta3"], "metric_irmse": ["i_rmse"]}.items():
    _metric(_name, _columns)


@query(f"""{with_views("pairs")} SELECT scene, round(avg(abs(ln(pred) - ln(gt))) / ln(10.0), 6) AS log10 FROM pairs WHERE valid GROUP BY scene""")
def metric_log10(spark, sf_dir):
    """Mean absolute difference of decimal logarithms, pooled over valid pixels."""
    return rounded(metrics.summary(pairs(spark, sf_dir)).select("scene", "log10"))


@query(f"{_FRAMES} SELECT scene, round(sqrt(avg(greatest(0.0, lv))) * 100, 6) AS silog FROM f GROUP BY scene")
def metric_silog(spark, sf_dir):
    """Scale-invariant log error; the root stands outside the frame mean."""
    return rounded(metrics.summary(pairs(spark, sf_dir)).select("scene", "silog"))


@query(f"""{with_views("pairs")}, d AS (SELECT scene, frame, (pred - lag(pred) OVER t) / (lag(pred) OVER t + 1e-6) - (gt - lag(gt) OVER t) / (lag(gt) OVER t + 1e-6) AS d, valid AND lag(valid) OVER t AS ok FROM pairs WINDOW t AS (PARTITION BY scene, y, x ORDER BY frame)),
f AS (SELECT scene, frame, sqrt(avg(d * d)) AS r FROM d WHERE ok GROUP BY scene, frame) SELECT scene, round(avg(r), 6) AS temporal FROM f GROUP BY scene""")
def metric_temporal(spark, sf_dir):
    """RMSE of relative temporal change."""
    return rounded(metrics.temporal(pairs(spark, sf_dir)))


@query(f"""{with_views("pairs")} SELECT scene, round(abs(avg(pred) FILTER (valid) - avg(gt) FILTER (valid)), 6) AS mean_diff, round(abs(var_pop(pred) FILTER (valid) - var_pop(gt) FILTER (valid)), 6) AS var_diff, round(abs(var_samp(pred) - var_samp(gt)), 6) AS var_diff_all FROM pairs GROUP BY scene""")
def metric_pixel_mean_var(spark, sf_dir):
    """Differences of means and variances."""
    return rounded(metrics.moments(pairs(spark, sf_dir)))


@query(f"""{with_views("pairs")}, o AS (SELECT dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)),
g AS (SELECT a.scene, a.frame, a.y, a.x, any_value(a.pred) AS d, any_value(a.valid) AS valid, sum(b.gt * dx * (CASE WHEN dy = 0 THEN 2 ELSE 1 END)) AS gx, sum(b.gt * dy * (CASE WHEN dx = 0 THEN 2 ELSE 1 END)) AS gy FROM pairs a, o JOIN pairs b ON b.scene = a.scene AND b.frame = a.frame AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.scene, a.frame, a.y, a.x),
m AS (SELECT *, sqrt(gx * gx + gy * gy + 1e-6) AS mag FROM g),
r AS (SELECT *, ((mag - min(mag) OVER f) / (max(mag) OVER f - min(mag) OVER f + 1e-6) > 0.15) AND valid AS e, coalesce(lead(d) OVER r, d) / d AS r0, coalesce(lag(d) OVER r, d) / d AS r1, coalesce(lead(d) OVER c, d) / d AS r2, coalesce(lag(d) OVER c, d) / d AS r3 FROM m
  WINDOW f AS (PARTITION BY scene, frame), r AS (PARTITION BY scene, frame, y ORDER BY x), c AS (PARTITION BY scene, frame, x ORDER BY y)),
p AS (SELECT scene, frame, y, x, e::INT AS g, (((r0 > 1.05 AND r0 = max(r0) OVER r) OR (r1 > 1.05 AND r1 = max(r1) OVER r) OR (r2 > 1.05 AND r2 = max(r2) OVER c) OR (r3 > 1.05 AND r3 = max(r3) OVER c)) AND valid)::INT AS p FROM r
  WINDOW r AS (PARTITION BY scene, frame, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), c AS (PARTITION BY scene, frame, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
n AS (SELECT a.scene, a.frame, a.y, a.x, any_value(a.g) AS g, any_value(a.p) AS p, max(b.g) AS gn, max(b.p) AS pn FROM p a, o JOIN p b ON b.scene = a.scene AND b.frame = a.frame AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.scene, a.frame, a.y, a.x),
s AS (SELECT scene, sum(p * gn) / (sum(p) + 1e-6) AS precision, sum(g * pn) / (sum(g) + 1e-6) AS recall FROM n GROUP BY scene)
SELECT scene, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall + 1e-6), 6) AS f1 FROM s""")
def metric_boundary_f1(spark, sf_dir):
    """Depth edges against image edges."""
    return rounded(metrics.boundaries(pairs(spark, sf_dir), "gt", "pred"))


_NORMALS = f"""{with_views("pairs")}, g AS (SELECT scene, {", ".join(f"-7.0 * (coalesce(lead({v}) OVER {w}, 0) - coalesce(lag({v}) OVER {w}, 0)) / 2 AS {v}_{w}" for v in ("pred", "gt") for w in ("r", "c"))} FROM pairs WINDOW r AS (PARTITION BY scene, frame, y ORDER BY x), c AS (PARTITION BY scene, frame, x ORDER BY y)),
e AS (SELECT scene, degrees(acos(greatest(-1.0, least(1.0, (pred_r * gt_r + pred_c * gt_c + 1) / (sqrt(pred_r * pred_r + pred_c * pred_c + 1) * sqrt(gt_r * gt_r + gt_c * gt_c + 1)))))) AS a FROM g)"""


@query(f"""{_NORMALS} SELECT scene, round(avg(a), 4) AS mean, round(quantile_cont(a, 0.5), 4) AS median, round(sqrt(avg(a * a)), 4) AS rmse, {", ".join(f"round(avg(CASE WHEN a < {t} THEN 1.0 ELSE 0.0 END), 4) AS below_{str(t).replace('.', '_')}" for t in (5, 7.5, 11.25, 22.5, 30))} FROM e GROUP BY scene""")
def metric_normals(spark, sf_dir):
    """Angular errors of normals."""
    p = raster.normals(pairs(spark, sf_dir), "pred", 7.0).withColumnsRenamed({a: f"p_{a}" for a in ("nx", "ny", "nz")})
    q = raster.normals(p, "gt", 7.0)
    e = q.select("scene", fn.angular_error([F.col(f"p_{a}") for a in ("nx", "ny", "nz")], [F.col(a) for a in ("nx", "ny", "nz")]).alias("a"))
    return rounded(metrics.normal_errors(e, "scene", "a"), 4)


@query(f"""{_FRAMES}, s AS (SELECT scene, scene % 3 AS dataset, avg(abs_rel) AS abs_rel, avg(rmse) AS rmse, avg(delta1) AS delta1 FROM f GROUP BY scene),
l AS (SELECT dataset, unnest(['abs_rel', 'rmse', 'delta1']) AS metric, unnest([abs_rel, rmse, delta1]) AS value FROM s)
SELECT metric, dataset, round(avg(value), 6) AS mean, count(*) AS n FROM l GROUP BY GROUPING SETS ((metric, dataset), (metric))""")
def metric_rollup(spark, sf_dir):
    """Per-sample metrics rolled up to datasets and overall (null dataset)."""
    s = metrics.summary(pairs(spark, sf_dir)).withColumn("dataset", F.col("scene") % 3)
    return rounded(metrics.roll_up(s.select("dataset", "scene", "abs_rel", "rmse", "delta1"), "dataset", "scene", ["abs_rel", "rmse", "delta1"]).select("metric", "dataset", "mean", "n"))


@query(f"""{with_views("pairs")}, b AS (SELECT scene, bool_or(c = 0) AS bad FROM (SELECT scene, frame, count(*) FILTER (gt > 0.2 AND gt < 0.21) AS c FROM pairs GROUP BY scene, frame) GROUP BY scene) SELECT scene, bad FROM b""")
def outlier_samples(spark, sf_dir):
    """Samples with any frame that has no valid pixel."""
    counted = pairs(spark, sf_dir).groupBy("scene", "frame").agg(F.count_if(fn.in_range(F.col("gt"), 0.2, 0.21)).alias("c"))
    return counted.groupBy("scene").agg(F.bool_or(F.col("c") == 0).alias("bad"))


@query(f"""{with_views("pixels")}, m AS (SELECT scene, frame, avg(v) AS m FROM pixels GROUP BY scene, frame) SELECT scene, frame, round(sqrt(avg((v - m) * (v - m))), 6) AS detail FROM pixels JOIN m USING (scene, frame) GROUP BY scene, frame""")
def detail_rms(spark, sf_dir):
    """Detail energy of a raster around its low-pass, here its mean."""
    p = pixels(spark, sf_dir)
    low = p.groupBy("scene", "frame").agg(F.avg("v").alias("m"))
    d = F.col("v") - F.col("m")
    return rounded(p.join(low, ["scene", "frame"]).groupBy("scene", "frame").agg(F.sqrt(F.avg(d * d)).alias("detail")))
