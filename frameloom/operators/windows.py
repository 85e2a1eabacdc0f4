"""Overlapping windows, tiles and clips as generators: a row per window from a row per sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(length: Column, size: int, overlap: int, tail: str = "snapped") -> Column:
    """array<struct<start,end>> covering [0, length): ``short`` keeps the last window's start, ``snapped`` its size."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    stride = size - overlap
    n = F.ceil(F.greatest(length - size, F.lit(0)) / stride).cast("long")
    start = (lambda i: F.greatest(F.lit(0).cast("long"), length - size)) if tail == "snapped" else (lambda i: i * stride)
    each = F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.struct(F.when(i < n, i * stride).otherwise(start(i)).cast("long").alias("start"), F.when(i < n, i * stride + size).otherwise(length).cast("long").alias("end")))
    return F.when(length > 0, each).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def windows_at(place: Column, length: Column, size: int, overlap: int) -> Column:
    """array<struct<i,start,end>> of the snapped windows that hold a place, found by arithmetic."""
    stride, zero = size - overlap, F.lit(0).cast("long")
    n = F.ceil(F.greatest(length - size, F.lit(0)) / stride).cast("long")
    low, high = F.greatest(zero, F.floor((place - size) / stride).cast("long") + 1), F.least(n - 1, F.floor(place / stride).cast("long"))
    none = F.array().cast("array<struct<i:bigint,start:bigint,end:bigint>>")
    whole = F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda i: F.struct(i.alias("i"), (i * stride).alias("start"), (i * stride + size).alias("end")))).otherwise(none)
    start = F.greatest(zero, length - size)
    return F.concat(whole, F.when(place >= start, F.array(F.struct(n.alias("i"), start.alias("start"), length.cast("long").alias("end")))).otherwise(none))


def padded_windows(length: Column, size: int, stride: int) -> Column:
    """array<struct<start,first,last>>: windows over the padded sequence, and the range of each that is kept.

    A whole stride is padded behind even when the length is a multiple of it; that window keeps nothing.
    """
    if size < stride:
        raise ValueError("the window must not be smaller than the stride")
    rest, front = length % stride, (size - stride) // 2
    total = length + (stride - rest) + size - stride
    n = F.floor((total - size) / stride)
    return F.transform(
        F.sequence(F.lit(0).cast("long"), n),
        lambda i: F.struct((i * stride).alias("start"), F.lit(front).cast("long").alias("first"), F.least(F.lit(size).cast("long"), F.when(i == n, front + rest).otherwise(front + stride)).cast("long").alias("last")),
    )


def tile_tasks(height: Column, width: Column, size: tuple[int, int], stride: tuple[int, int]) -> Column:
    """array<struct<y,x>> of tile corners; a tile that the one before already reaches past is skipped."""
    def corners(length: Column, k: int, step: int) -> Column:
        every = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((length - 1) / step)), lambda i: i * step)
        return F.filter(every, lambda at: (at - step < 0) | (at - step + k < length))

    return F.flatten(F.transform(corners(height, size[0], stride[0]), lambda y: F.transform(corners(width, size[1], stride[1]), lambda x: F.struct(y.alias("y"), x.alias("x")))))


def contiguous_clips(frames: DataFrame, by: list[str], order: str, length: int) -> DataFrame:
    """Every run of ``length`` consecutive frames: (by, start, frames array)."""
    ahead = Window.partitionBy(*by).orderBy(order).rowsBetween(0, length - 1)
    return frames.select(*by, F.col(order).alias("start"), F.collect_list(order).over(ahead).alias("clip")).where(F.size("clip") == length)
