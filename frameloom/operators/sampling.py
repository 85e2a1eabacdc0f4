"""Clip sampling, splits, mixtures and shard packing, all keyed by hashes, so they repeat in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keyed_hash, keyed_int
from .ordering import numbered
from .packing import pack

__all__ = ["clamped_clips", "pack", "strided_clips", "stride_limit", "train_val_split", "weighted_choice"]


def strided_clips(scenes: DataFrame, scene: str, n: str, length: int, low: int, high: int, seed: int = 0) -> DataFrame:
    """(scene, clip) for scenes long enough: a hashed start and strides in [low, high), frame positions as running sums."""
    room = F.col(n) - 1 - (length - 1) * (high if high > low else low)
    fits = scenes.where(room >= 0)
    start = keyed_int(0, room + 1, scene, F.lit(seed), F.lit("start"))
    stride = lambda i: keyed_int(low, high, F.col(scene), F.lit(seed), i) if high > low else F.lit(low).cast("long")
    clip = F.aggregate(F.sequence(F.lit(1), F.lit(length - 1)), F.array(start), lambda a, i: F.concat(a, F.array(F.element_at(a, -1) + stride(i))))
    return fits.select(scene, n, clip.alias("clip"))


def clamped_clips(scenes: DataFrame, scene: str, n: str, length: int, low: int, high: int, seed: int = 0) -> DataFrame:
    """As strided_clips with strides in [low, high], but each position is held back so that the frames after it still fit."""
    fits = scenes.where(F.col(n) >= low * length)
    start = keyed_int(0, F.col(n) - low * length + 1, scene, F.lit(seed), F.lit("start"))
    step = lambda a, f: F.least(F.element_at(a, -1) + keyed_int(low, high + 1, F.col(scene), F.lit(seed), f), F.col(n) - low * (length - f))
    clip = F.aggregate(F.sequence(F.lit(0), F.lit(length - 2)), F.array(start), lambda a, f: F.concat(a, F.array(step(a, f))))
    return fits.select(scene, n, clip.alias("clip"))


def train_val_split(shots: DataFrame, shot: str, ratio: float) -> DataFrame:
    """Adds ``split``: int(n * ratio) shots of the smallest hash are ``val``."""
    if not 0 < ratio < 1:
        raise ValueError("the ratio must lie between 0 and 1")
    ranked = numbered(shots.withColumn("__hash", keyed_hash(shot)), ["__hash", shot], "__place")
    n = shots.agg(F.floor(F.count("*") * ratio).alias("__n"))  # one row
    split = F.when(F.col("__place") <= F.col("__n"), "val").otherwise("train")
    return ranked.crossJoin(F.broadcast(n)).select(*shots.columns, split.alias("split"))


def weighted_choice(weights: list[float], *key: Column | str) -> Column:
    """The index of a choice with these weights, by hash."""
    total, at, out = float(sum(weights)), 0.0, F.lit(len(weights) - 1).cast("long")
    unit = keyed_hash(*key) / F.lit(4294967296.0) * total
    bounds = []
    for w in weights:
        at += w
        bounds.append(at)
    for i in range(len(weights) - 2, -1, -1):
        out = F.when(unit < bounds[i], F.lit(i).cast("long")).otherwise(out)
    return out


def stride_limit(shortest: Column, length: int, high: int) -> Column:
    """The largest stride that still fits a clip into the shortest scene."""
    return F.least(F.lit(high).cast("long"), F.floor((shortest - 1) / (length - 1)))
