"""Least-squares alignment, blending and stitching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import affine_fit, clamp


def fit(pairs: DataFrame, by: list[str], pred: str = "pred", gt: str = "gt", valid: str = "valid") -> DataFrame:
    """(by, scale, shift) of the fit gt = scale * pred + shift over valid rows; (1, 0) if degenerate."""
    scale, shift = affine_fit(F.col(pred), F.col(gt), F.col(valid))
    return pairs.groupBy(*by).agg(scale.alias("scale"), shift.alias("shift"))


def scale_only(pairs: DataFrame, by: list[str], pred: str = "pred", gt: str = "gt", valid: str = "valid") -> DataFrame:
    w = F.when(F.col(valid), 1.0).otherwise(0.0)
    x, y = F.col(pred), F.col(gt)
    return pairs.groupBy(*by).agg((F.sum(w * x * y) / (F.sum(w * x * x) + 1e-6)).alias("scale"))


def guarded_fit(pairs: DataFrame, by: list[str], pred: str = "pred", gt: str = "gt", valid: str = "valid", low: float = 0.7, high: float = 1.5) -> DataFrame:
    """Fit by normal equations; a relatively small determinant gives (1, 0); the scale is clipped behind the shift."""
    w = F.when(F.col(valid), 1.0).otherwise(0.0)
    x, y = F.col(pred), F.col(gt)
    sums = pairs.groupBy(*by).agg(F.sum(w * x * x).alias("a00"), F.sum(w * x).alias("a01"), F.sum(w).alias("a11"), F.sum(w * x * y).alias("b0"), F.sum(w * y).alias("b1"))
    sums = sums.withColumn("det", F.col("a00") * F.col("a11") - F.col("a01") * F.col("a01"))
    good = F.col("det") > 1e-10 * (F.col("a00") * F.col("a11"))
    scale = F.when(good, (F.col("a11") * F.col("b0") - F.col("a01") * F.col("b1")) / F.col("det")).otherwise(1.0)
    shift = F.when(good, (F.col("a00") * F.col("b1") - F.col("a01") * F.col("b0")) / F.col("det")).otherwise(0.0)
    return sums.select(*by, clamp(scale, low, high).alias("scale"), shift.alias("shift"))


def to_depth(disparity: Column, low: float, high: float) -> Column:
    """Depth from an aligned disparity: floored at 1e-3, inverted, kept within the limits and above 1e-6."""
    return F.greatest(clamp(1.0 / clamp(disparity, 1e-3), low, high), F.lit(1e-6))


def blend(tiles: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean of overlapping tiles at each place."""
    return tiles.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value), F.count("*").alias("n_tiles"))


class Stitcher:
    """Folds windows in order onto a canvas of which it keeps what the last window covers; what lies before is final.

    Each window is fitted to the canvas as aligned so far, its scale is clipped behind the shift, negative values become 0,
    and it is cross-faded over the overlap. A window that does not overlap is put behind the canvas as it is.
    """

    def __init__(self, scale_only: bool = False, low: float = 0.7, high: float = 1.5):
        self.scale_only, self.low, self.high = scale_only, low, high
        self.tail, self.reached, self.done, self.seam = np.empty(0), None, 0, None

    def add(self, start: int, end: int, values: np.ndarray) -> tuple[int, np.ndarray]:
        """(position of the first, values) of what becomes final; ``seam`` gets (scale, shift, mean abs difference) of an overlap, else None."""
        overlap = 0 if self.reached is None else self.reached - start
        self.seam = None
        if overlap > min(len(values), len(self.tail)):
            raise ValueError("windows have to begin and end in order")
        if overlap > 0:
            ref, cur = self.tail[-overlap:], values[:overlap]
            if self.scale_only:
                scale, shift = float((cur * ref).sum() / ((cur * cur).sum() + 1e-6)), 0.0
            else:
                det = (cur * cur).sum() * overlap - cur.sum() ** 2
                scale = (overlap * (cur * ref).sum() - cur.sum() * ref.sum()) / det if det else 1.0
                shift = ((cur * cur).sum() * ref.sum() - cur.sum() * (cur * ref).sum()) / det if det else 0.0
            scale = float(np.clip(scale, self.low, self.high))
            aligned = np.maximum(values * scale + shift, 0)
            self.seam = scale, float(shift), float(np.abs(aligned[:overlap] - ref).mean())
            alpha = np.linspace(0, 1, overlap)
            final, self.tail = self.tail[:-overlap], np.concatenate([(1 - alpha) * ref + alpha * aligned[:overlap], aligned[overlap:]])
        else:
            final, self.tail = self.tail, values
        self.reached = end
        return self._passed(final)

    def rest(self) -> tuple[int, np.ndarray]:
        final, self.tail, self.reached = self.tail, np.empty(0), None
        return self._passed(final)

    def _passed(self, final: np.ndarray) -> tuple[int, np.ndarray]:
        first, self.done = self.done, self.done + len(final)
        return first, final


def stitch(values: DataFrame, by: str, scale_only: bool = False) -> DataFrame:
    """(by, pos, value) from a row per value (by, start, end, pos, value) of each window, which hold all positions from start to end.

    A sequence streams through one task, as each window is fitted to the one before; the task holds two windows of it.
    """
    kind = values.schema[by].dataType
    out_schema = f"`{by}` {kind.simpleString()}, pos long, value double"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, window, held, stitcher = None, None, [], None
        arrow = pa.null()

        def rows(first: int, final: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(final):
                yield pa.RecordBatch.from_arrays([pa.array([sequence[0]] * len(final), arrow), pa.array(np.arange(first, first + len(final))), pa.array(final)], [by, "pos", "value"])

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                yield from rows(*stitcher.add(*window, np.concatenate(held)))

        for batch in batches:
            arrow = batch.schema.field(0).type
            names, start, end, value = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((start[1:] != start[:-1]) | (end[1:] != end[:-1]) | np.array([a != b for a, b in zip(names[1:], names, strict=False)], bool)) + 1
            for first, stop in zip([0, *change.tolist()], [*change.tolist(), len(names)], strict=True):
                if first == stop:
                    continue
                if (names[first],) != sequence or (int(start[first]), int(end[first])) != window:
                    yield from close()
                    if (names[first],) != sequence:
                        if stitcher:
                            yield from rows(*stitcher.rest())
                        sequence, stitcher = (names[first],), Stitcher(scale_only)
                    window, held = (int(start[first]), int(end[first])), []
                held.append(value[first:stop])
        yield from close()
        if stitcher:
            yield from rows(*stitcher.rest())

    ordered = values.select(by, "start", "end", "value", "pos").repartition(by).sortWithinPartitions(by, "start", "end", "pos").select(by, F.col("start").cast("long"), F.col("end").cast("long"), F.col("value").cast("double"))
    return ordered.mapInArrow(fold, out_schema)
