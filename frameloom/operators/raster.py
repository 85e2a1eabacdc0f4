"""Raster operators over a row per pixel (scene, frame, y, x, v), with window functions along the axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ["scene", "frame"]


def rows(*more: str) -> WindowSpec:
    """Along x, within a row of a raster."""
    return Window.partitionBy(*KEY, "y").orderBy("x")


def columns() -> WindowSpec:
    """Along y, within a column of a raster."""
    return Window.partitionBy(*KEY, "x").orderBy("y")


def time() -> WindowSpec:
    return Window.partitionBy("scene", "y", "x").orderBy("frame")


def box_max(pixels: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """Dilation: the maximum of the (2 radius + 1)² neighbourhood, one axis after the other."""
    along = pixels.withColumn("_m", F.max(value).over(rows().rowsBetween(-radius, radius)))
    return along.withColumn(out, F.max("_m").over(columns().rowsBetween(-radius, radius))).drop("_m")


def local_maximum(value: str, over: WindowSpec) -> Column:
    """Whether a value is the largest of itself and its two neighbours."""
    return F.col(value) == F.max(value).over(over.rowsBetween(-1, 1))


def sobel(pixels: DataFrame, value: str) -> DataFrame:
    """Adds gx, gy: Sobel gradients with zeros outside."""
    near = lambda c, over: (F.coalesce(F.lag(c).over(over), F.lit(0.0)), F.coalesce(F.lead(c).over(over), F.lit(0.0)))
    left, right = near(value, rows())
    mixed = pixels.withColumn("_d", right - left).withColumn("_s", left + 2 * F.col(value) + right)
    (d0, d2), (s0, s2) = near("_d", columns()), near("_s", columns())
    return mixed.withColumns({"gx": d0 + 2 * F.col("_d") + d2, "gy": s2 - s0}).drop("_d", "_s")


def differences(pixels: DataFrame, value: str) -> DataFrame:
    """Adds dt, dy, dx: differences to the pixel before along each axis, null at the start."""
    back = lambda over: F.col(value) - F.lag(value).over(over)
    return pixels.withColumns({"dt": back(time()), "dy": back(columns()), "dx": back(rows())})


def normals(pixels: DataFrame, value: str, f: float) -> DataFrame:
    """Adds nx, ny, nz: unit normals from central differences, zeros outside."""
    at = lambda fn, over: F.coalesce(fn(value).over(over), F.lit(0.0))
    gx, gy = (at(F.lead, rows()) - at(F.lag, rows())) / 2, (at(F.lead, columns()) - at(F.lag, columns())) / 2
    steep = pixels.withColumns({"_gx": -gx * f, "_gy": -gy * f})
    size = F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy") + 1.0)
    return steep.withColumns({"nx": F.col("_gx") / size, "ny": F.col("_gy") / size, "nz": 1.0 / size}).drop("_gx", "_gy")


def block_means(pixels: DataFrame, value: str, k: int) -> DataFrame:
    """Area down-sampling: the mean of each k x k block."""
    return pixels.groupBy(*KEY, F.floor(F.col("y") / k).alias("by"), F.floor(F.col("x") / k).alias("bx")).agg(F.avg(value).alias("mean"))


def nearest_resize(pixels: DataFrame, value: str, h: int, w: int, new_h: int, new_w: int) -> DataFrame:
    """Nearest-neighbour resize by index arithmetic: target pixels pick their source."""
    spark = pixels.sparkSession
    grid = spark.range(new_h * new_w).select(F.floor(F.col("id") / new_w).alias("ny"), (F.col("id") % new_w).alias("nx"))
    grid = grid.withColumns({"y": F.floor(F.col("ny") * h / new_h), "x": F.floor(F.col("nx") * w / new_w)})
    return pixels.join(F.broadcast(grid), ["y", "x"]).select(*KEY, F.col("ny").alias("y"), F.col("nx").alias("x"), value)  # the grid has new_h * new_w rows


def flip(pixels: DataFrame, w: int) -> DataFrame:
    """Mirrors a raster left to right."""
    return pixels.withColumn("x", w - 1 - F.col("x"))
