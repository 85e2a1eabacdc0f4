"""Poisson blending of rasters in tiles: sweeps of overlapping local solves, with one exchange of borders a sweep.

Inside the mask the blended raster has the source's Laplacian, elsewhere it is the target. In a sweep each tile gets a border
of its neighbours, solves for all pixels inside that it sees, between those that it sees fixed, and keeps its own part
(restricted additive Schwarz, which converges for this equation whatever the mask). A sweep is one pass over the tiles, which
are written, so a lost executor repeats a pass and not the run. The wider the overlap, the fewer the sweeps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import release, written
from . import tiles as T


def laplacian(padded: np.ndarray) -> np.ndarray:
    """4 p minus the four neighbours, of tiles padded by one pixel."""
    return 4 * T.shifted(padded, 1, 0, 0) - T.shifted(padded, 1, -1, 0) - T.shifted(padded, 1, 1, 0) - T.shifted(padded, 1, 0, -1) - T.shifted(padded, 1, 0, 1)


def solve_inside(x: np.ndarray, free: np.ndarray, right: np.ndarray, tolerance: float) -> np.ndarray:
    """x (n, h, w) with the free pixels, none of them on a border, such that their Laplacian is ``right``: conjugate gradients, all rasters at once."""
    within = (slice(None), slice(1, -1), slice(1, -1))

    def applied(a: np.ndarray) -> np.ndarray:
        out = np.zeros_like(a)
        out[within] = np.where(free[within], laplacian(a), 0.0)
        return out

    r = np.where(free, right, 0.0) - applied(x)
    r = np.where(free, r, 0.0)
    p, added, size = r, np.zeros_like(r), (r * r).sum(axis=(1, 2))
    for _ in range(10 * int(free.sum(axis=(1, 2)).max(initial=0)) + 10):
        if np.abs(r).max(initial=0) <= tolerance:
            break
        q = applied(p)
        step = np.divide(size, (p * q).sum(axis=(1, 2)), out=np.zeros_like(size), where=size > 0)[:, None, None]
        added, r = added + step * p, r - step * q
        new = (r * r).sum(axis=(1, 2))
        p = r + np.divide(new, size, out=np.zeros_like(size), where=size > 0)[:, None, None] * p
        size = new
    return np.where(free, x + added, x)


def _start(a: T.Arrays) -> T.Arrays:
    target = a["target"]
    beside = sum(T.shifted(target, 1, dy, dx) for dy, dx in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))) + laplacian(a["source"])
    inside = (T.shifted(a["mask"], 1, 0, 0) > 0) & ~np.isnan(beside)
    return {"inside": inside.astype(float), "right": np.where(inside, laplacian(a["source"]), 0.0)}


def blend(tiles: DataFrame, by: list[str], size: int, overlap: int = 0, tolerance: float = 1e-8, max_sweeps: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """((by..., ty, tx, h, w, inside, blended), (by..., sweep, residual)) of tiles with source, target and mask.

    A pixel is inside if its mask is above 0, it is not on the raster's border, and it and its neighbours have values; the
    largest residual of every raster ends below the tolerance. Pixels outside keep the target, NaN included. A raster that
    has nothing inside needs no sweep; no tiles give no rows. ``overlap`` is the border's width, up to the tile's size, which
    it is if 0. Not getting there in max_sweeps is an error.
    """
    keys, radius = [*by, "ty", "tx"], overlap or size
    state = T.map_tiles(tiles, by, T.TileFunction(("source", "target", "mask"), ("inside", "right"), _start, 1, float("nan"), keep=("target",)), size)
    state = state.select(*keys, "h", "w", F.col("target").alias("x"), "inside", "right")

    def sweep(a: T.Arrays) -> T.Arrays:
        x, own = a["x"], lambda v: T.shifted(v, radius, 0, 0)
        free = a["inside"] > 0
        free[:, [0, -1]] = free[:, :, [0, -1]] = False
        here = own(a["inside"]) > 0
        centre = slice(radius - 1, None if radius == 1 else 1 - radius)
        left = np.where(here, own(a["right"]) - laplacian(x[:, centre, centre]), 0.0)
        return {"x": own(solve_inside(x, free, a["right"], tolerance / 4)), "left": left}

    old, logs, k = None, [], 0
    while True:
        # ``left`` is what the tiles before this sweep lack, ``x`` what they become
        step = T.map_tiles(state.withColumn("was", F.col("x")), by, T.TileFunction(("x", "inside", "right"), ("x", "left"), sweep, radius, 0.0, keep=("was", "inside", "right")), size)
        state = written(step.select(*keys, "h", "w", "was", "inside", "right", "x", F.aggregate("left", F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v))).alias("left")), "sweep")
        log = written(state.groupBy(*by).agg(F.lit(k).alias("sweep"), F.max("left").alias("residual")), "residuals")
        logs.append(log)
        if old is not None:
            release(old)
        if log.where(F.col("residual") > tolerance).isEmpty():
            break
        if k == max_sweeps:
            raise ArithmeticError(f"residuals above {tolerance} after {k} sweeps")
        old, k = state, k + 1
        state = state.select(*keys, "h", "w", "x", "inside", "right")
    log = logs[0]
    for more in logs[1:]:
        log = log.unionByName(more)
    return state.select(*keys, "h", "w", "inside", F.col("was").alias("blended")), log
