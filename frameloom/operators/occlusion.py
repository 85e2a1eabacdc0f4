"""Occlusion from depth: a forward splat with a z-buffer, and the clean-up of its holes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tensors import keep_large_components

#: The directional kernel of the clean-up, and what its sums and grown masks have to exceed.
KERNEL = ((0, 0.15, 0.15), (0, 0.25, 0.15), (0, 0.15, 0.15))
ENOUGH = 0.9


def splat(pixels: DataFrame, by: list[str], disparity: str, value: str, to_left: bool = True) -> DataFrame:
    """(by..., y, x, value, from_x, hole): what each pixel of the other view shows.

    A pixel moves by its disparity, to the left or right, to the nearest column (halves go right). Where several meet, the
    greatest disparity, which is nearest to the camera, wins, then the smallest x. A pixel of the raster that none reaches is a
    hole, without value; what leaves the raster is lost. A null, NaN or infinite disparity moves nowhere, so it shows nothing.
    One exchange: pixels and what is moved to them are grouped together.
    """
    d = F.col(disparity).cast("double")
    moved = F.floor(F.col("x") + (-d if to_left else d) + 0.5).cast("long")
    shown = F.struct(d.alias("d"), (-F.col("x")).alias("back"), F.col(value).alias("value"))
    sent = F.struct(moved.alias("x"), F.lit(False).alias("own"), shown.alias("shown"))
    own = F.struct(F.col("x").cast("long").alias("x"), F.lit(True).alias("own"), F.lit(None).alias("shown").cast(pixels.select(shown.alias("s")).schema["s"].dataType).alias("shown"))
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < 2.0**31)
    rows = pixels.select(*by, "y", F.explode(F.when(finite, F.array(own, sent)).otherwise(F.array(own))).alias("p"))
    met = rows.groupBy(*by, "y", F.col("p.x").alias("x")).agg(F.max("p.shown").alias("s"), F.max("p.own").alias("own"))
    return met.where("own").select(*by, "y", "x", F.col("s.value").alias(value), (-F.col("s.back")).cast("long").alias("from_x"), F.col("s").isNull().alias("hole"))


def dilate(mask: np.ndarray, times: int = 1) -> np.ndarray:
    """3 x 3 maximum, so many times; nothing is set beyond the border."""
    for _ in range(times):
        padded = np.pad(mask, 1)
        mask = np.max([padded[dy : dy + mask.shape[0], dx : dx + mask.shape[1]] for dy in range(3) for dx in range(3)], axis=0)
    return mask


def directed(mask: np.ndarray) -> np.ndarray:
    """Where the kernel's sum over the neighbourhood is enough; beyond the border is 0."""
    padded = np.pad(mask.astype(float), 1)
    return sum(KERNEL[dy][dx] * padded[dy : dy + mask.shape[0], dx : dx + mask.shape[1]] for dy in range(3) for dx in range(3)) > ENOUGH


def clean(holes: np.ndarray, first_area: int = 75, area: int = 100, rounds: int = 4) -> np.ndarray:
    """Holes grown twice without small components, then in rounds shrunk from the right, without small components, and grown."""
    mask = keep_large_components(dilate(holes > 0, 2), first_area)
    for _ in range(rounds):
        mask = dilate(keep_large_components(directed(mask), area))
    return mask
