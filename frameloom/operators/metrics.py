"""Error metrics of a prediction against ground truth over valid pixels.

Frames count equally: a metric is computed per frame and averaged, unless its form pools all pixels. A
frame without valid pixels has no value and is left out of the mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import box_max, columns, local_maximum, rows, sobel


def _valid(x: Column) -> Column:
    return F.when(F.col("valid"), x)


def _errors() -> dict[str, Column]:
    """Per-pixel terms, null where not valid, so that divisions by 0 outside the mask never happen."""
    p, g = _valid(F.col("pred")), _valid(F.col("gt"))
    log, inverse = F.ln(p) - F.ln(g), 1 / p - 1 / g
    ratio = F.greatest(p / g, g / p)
    return {"abs_rel": F.abs(p - g) / g, "sq_rel": (p - g) * (p - g) / g, "square": (p - g) * (p - g), "log": log, "log_square": log * log, "inverse_square": inverse * inverse, "ratio": ratio}


def per_frame(pairs: DataFrame, by: list[str] = ["scene"]) -> DataFrame:  # noqa: B006
    """One row per frame with every per-frame metric and the number of valid pixels."""
    e = _errors()
    share = lambda k: F.avg(_valid((e["ratio"] < 1.25**k).cast("double")))
    return pairs.groupBy(*by, "frame").agg(
        F.avg(e["abs_rel"]).alias("abs_rel"), F.avg(e["sq_rel"]).alias("sq_rel"), F.sqrt(F.avg(e["square"])).alias("rmse"), F.sqrt(F.avg(e["log_square"])).alias("rmse_log"),
        share(1).alias("delta1"), share(2).alias("delta2"), share(3).alias("delta3"), F.sqrt(F.avg(e["inverse_square"])).alias("i_rmse"),
        (F.avg(e["log_square"]) - F.avg(e["log"]) * F.avg(e["log"])).alias("log_variance"), F.count_if("valid").alias("n_valid"),
    )


def summary(pairs: DataFrame, by: list[str] = ["scene"]) -> DataFrame:  # noqa: B006
    """Frame means of all metrics; silog takes its root outside the mean, log10 pools all valid pixels."""
    e = _errors()
    frames = per_frame(pairs, by)
    names = ["abs_rel", "sq_rel", "rmse", "rmse_log", "delta1", "delta2", "delta3", "i_rmse"]
    means = frames.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names], (F.sqrt(F.avg(F.greatest(F.lit(0.0), F.col("log_variance")))) * 100).alias("silog"), F.count_if(F.col("n_valid") == 0).alias("n_empty_frames"))
    pooled = pairs.groupBy(*by).agg((F.avg(F.abs(e["log"])) / F.ln(F.lit(10.0))).alias("log10"))
    return means.join(pooled, by)


def temporal(pairs: DataFrame, eps: float = 1e-6) -> DataFrame:
    """RMSE of relative changes between frames, over pixels valid in both, averaged over frame pairs."""
    over = Window.partitionBy("scene", "y", "x").orderBy("frame")
    relative = lambda c: (F.col(c) - F.lag(c).over(over)) / (F.lag(c).over(over) + eps)
    moved = pairs.withColumns({"d": relative("pred") - relative("gt"), "both": F.col("valid") & F.lag("valid").over(over)}).where("both")
    return moved.groupBy("scene", "frame").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("r")).groupBy("scene").agg(F.avg("r").alias("temporal"))


def moments(pairs: DataFrame) -> DataFrame:
    """Differences of means and of variances (population over valid pixels, sample over all)."""
    p, g = F.col("pred"), F.col("gt")
    return pairs.groupBy("scene").agg(F.abs(F.avg(_valid(p)) - F.avg(_valid(g))).alias("mean_diff"), F.abs(F.var_pop(_valid(p)) - F.var_pop(_valid(g))).alias("var_diff"), F.abs(F.var_samp(p) - F.var_samp(g)).alias("var_diff_all"))


def boundaries(pixels: DataFrame, image: str, depth: str, th_ratio: float = 1.05, th_grad: float = 0.15, tolerance: int = 1, eps: float = 1e-6) -> DataFrame:
    """Per scene: precision, recall and F1 of depth edges (ratio peaks) against image edges (Sobel), within a tolerance, over valid pixels."""
    frame = Window.partitionBy("scene", "frame")
    steep = sobel(pixels, image).withColumn("mag", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + eps))
    low, high = F.min("mag").over(frame), F.max("mag").over(frame)
    edged = steep.withColumn("gt_edge", ((F.col("mag") - low) / (high - low + eps) > th_grad) & F.col("valid")).withColumn("d", F.greatest(F.col(depth), F.lit(eps)))
    beside = lambda fn, over: F.coalesce(fn("d").over(over), F.col("d")) / F.col("d")
    edged = edged.withColumns({"r0": beside(F.lead, rows()), "r1": beside(F.lag, rows()), "r2": beside(F.lead, columns()), "r3": beside(F.lag, columns())})
    peak = [(F.col(r) > th_ratio) & local_maximum(r, over) for r, over in (("r0", rows()), ("r1", rows()), ("r2", columns()), ("r3", columns()))]
    edged = edged.withColumn("pred_edge", (peak[0] | peak[1] | peak[2] | peak[3]) & F.col("valid"))
    edged = edged.select("scene", "frame", "y", "x", F.col("gt_edge").cast("int").alias("g"), F.col("pred_edge").cast("int").alias("p"))
    near = box_max(box_max(edged, "g", tolerance, "g_near"), "p", tolerance, "p_near")
    sums = near.groupBy("scene").agg((F.sum(F.col("p") * F.col("g_near")) / (F.sum("p") + eps)).alias("precision"), (F.sum(F.col("g") * F.col("p_near")) / (F.sum("g") + eps)).alias("recall"))
    return sums.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps))


def normal_errors(errors: DataFrame, by: str, degrees: str) -> DataFrame:
    """Mean, median, RMSE and shares below the usual angles."""
    x = F.col(degrees)
    below = [F.avg((x < a).cast("double")).alias("below_" + str(a).replace(".", "_")) for a in (5, 7.5, 11.25, 22.5, 30)]
    return errors.groupBy(by).agg(F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.sqrt(F.avg(x * x)).alias("rmse"), *below)


def roll_up(per_sample: DataFrame, by: str, sample: str, names: list[str]) -> DataFrame:
    """Long (by or overall, metric, mean): the mean over samples in each group, and over all (null group)."""
    long = per_sample.unpivot([by, sample], names, "metric", "value")
    return long.rollup("metric", by).agg(F.avg("value").alias("mean"), F.count("value").alias("n")).where("metric IS NOT NULL")
