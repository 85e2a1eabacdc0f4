"""Statistics: six-stat bundles, two-level statistics, motion, quantile modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import six_stats
from .ordering import numbered

QUANTILE_MODES = ("linear", "lower", "higher", "nearest", "midpoint")


def motion_stats(frames: DataFrame, by: str, order: str, position: str) -> DataFrame:
    """Per scene: statistics of a position, and of its absolute change between consecutive frames, and their total."""
    steps = Window.partitionBy(by).orderBy(order)
    moved = frames.withColumn("step", F.abs(F.col(position) - F.lag(position).over(steps)))
    return moved.groupBy(by).agg(F.count("*").alias("n_frames"), *six_stats("pos", F.col(position)), *six_stats("delta", F.col("step")), F.sum("step").alias("delta_total"))


def camera_stats(cameras: DataFrame, by: str, order: str, positions: list[str], rotations: list[str]) -> DataFrame:
    """Per scene: the six statistics of each coordinate, of the length of steps between frames and of the size of each rotation's change, and the path's length; a single camera has no steps."""
    steps = Window.partitionBy(by).orderBy(order)
    moved = cameras.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(steps) for c in (*positions, *rotations)})
    length = F.sqrt(sum((F.col(f"d_{c}") * F.col(f"d_{c}") for c in positions), F.lit(0.0)))
    out = [F.count("*").alias("num_valid_cameras"), *[s for c in (*positions, *rotations) for s in six_stats(c, F.col(c))]]
    out += [*six_stats("delta_pos", length), F.sum(length).alias("delta_pos_total")]
    return moved.groupBy(by).agg(*out, *[s for c in rotations for s in six_stats(f"delta_{c}", F.abs(F.col(f"d_{c}")))])


def two_level_stats(values: DataFrame, scene: str, frame: str, value: str, prefix: str) -> DataFrame:
    """Statistics of each frame, then the six statistics of those over a scene's frames."""
    x = F.col(value)
    per_frame = values.groupBy(scene, frame).agg(F.min(x).alias("f_min"), F.max(x).alias("f_max"), F.avg(x).alias("f_mean"), F.percentile(x, 0.5).alias("f_median"), F.stddev_pop(x).alias("f_std"))
    return per_frame.groupBy(scene).agg(*[s for name in ("min", "max", "mean", "median", "std") for s in six_stats(f"{prefix}_{name}", F.col(f"f_{name}"))])


def index_quartiles(values: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles picked by index, sorted[n // 4], [n // 2] and [3n // 4], without interpolation."""
    ranked = values.select(by, value, (F.row_number().over(Window.partitionBy(by).orderBy(value)) - 1).alias("i"), F.count("*").over(Window.partitionBy(by)).alias("n"))
    pick = lambda k: F.max(F.when(F.col("i") == F.floor(F.col("n") * k / 4), F.col(value)))
    return ranked.groupBy(by).agg(pick(1).alias("p25"), pick(2).alias("median"), pick(3).alias("p75"))


def index_cuts(values: DataFrame, value: str, tie: str) -> DataFrame:
    """One row (p25, median, p75) of all values, picked by index without interpolation and without a global window; ``tie`` tells rows of equal values apart."""
    n = values.agg(F.count("*").alias("n"))  # one row
    ranked = numbered(values.select(value, tie), [value, tie], "place").crossJoin(F.broadcast(n))
    pick = lambda k: F.max(F.when(F.col("place") - 1 == F.floor(F.col("n") * k / 4), F.col(value)))
    return ranked.agg(pick(1).alias("p25"), pick(2).alias("median"), pick(3).alias("p75"))


def quantile_in_modes(values: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """The q-quantile in the five interpolation modes."""
    every = Window.partitionBy(by)
    ranked = values.select(by, value, (F.row_number().over(every.orderBy(value)) - 1).alias("i"), ((F.count("*").over(every) - 1) * q).alias("at"))
    at = lambda pos: F.max(F.when(F.col("i") == pos, F.col(value)))
    found = ranked.groupBy(by).agg(at(F.floor("at")).alias("lower"), at(F.ceil("at")).alias("higher"), at(F.bround("at")).alias("nearest"), (F.max("at") - F.floor(F.max("at"))).alias("part"))
    return found.select(by, (F.col("lower") + (F.col("higher") - F.col("lower")) * F.col("part")).alias("linear"), "lower", "higher", "nearest", ((F.col("lower") + F.col("higher")) / 2).alias("midpoint"))


def strided_quantile(values: DataFrame, by: str, order: str, value: str, q: float, stride: int, offset: int = 0) -> DataFrame:
    """The exact quantile of every stride-th value, the cheap form for very large groups."""
    placed = values.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
    return placed.where((F.col("pos") >= offset) & ((F.col("pos") - offset) % stride == 0)).groupBy(by).agg(F.percentile(F.col(value), q).alias("q"), F.count("*").alias("n_used"))


def running_mean(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Weighted mean by key, as an accumulator of (value, n) updates gives it."""
    return rows.groupBy(key).agg(F.sum(F.col(value) * F.col(weight)).alias("total"), F.sum(weight).alias("counts"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("average"))
