"""Raster operators that built-in functions cannot express: numpy on whole rasters, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_rasters(rasters: DataFrame, f: Callable[[np.ndarray], np.ndarray], h: int, w: int, values: str = "values") -> DataFrame:
    """Replaces each raster's values by f(raster); nulls stay null."""
    names = rasters.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if v.as_py() is None else np.asarray(f(np.array(v.as_py(), float).reshape(h, w)), float).reshape(-1) for v in batch.column(names.index(values))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())) if c == values else batch.column(i) for i, c in enumerate(names)], names)

    schema = ", ".join(f"`{x.name}` {'array<double>' if x.name == values else x.dataType.simpleString()}" for x in rasters.schema.fields)
    return rasters.mapInArrow(run, schema)


def bilinear(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Resize with half-pixel centres, edges repeated."""
    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = axis(a.shape[0], h), axis(a.shape[1], w)
    rows = a[y0] * (1 - fy)[:, None] + a[y1] * fy[:, None]
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def low_pass(a: np.ndarray, k: int) -> np.ndarray:
    """Block means, resized back."""
    h, w = a.shape
    return bilinear(a[: h // k * k, : w // k * k].reshape(h // k, k, w // k, k).mean(axis=(1, 3)), h, w)


def band_merge(anchor: np.ndarray, tile: np.ndarray, k: int) -> np.ndarray:
    """The anchor's low band with the tile's detail; a tile's constant offset cancels."""
    return anchor + tile - low_pass(tile, k)


def component_areas(mask: np.ndarray) -> np.ndarray:
    """The area of each pixel's 8-connected component, 0 outside the mask."""
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape) + 1, 0)
    while True:
        grown = np.pad(label, 1)
        best = np.max([grown[1 + dy : 1 + dy + mask.shape[0], 1 + dx : 1 + dx + mask.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        best = np.where(mask, best, 0)
        if (best == label).all():
            return np.where(mask, np.bincount(label.reshape(-1))[label], 0)
        label = best


def keep_large_components(mask: np.ndarray, least: int) -> np.ndarray:
    return component_areas(mask) >= max(1, least)


def median_filter(a: np.ndarray, k: int = 5) -> np.ndarray:
    """k x k median, edges repeated."""
    p = np.pad(a, k // 2, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (k, k)), axis=(2, 3))


def plane_normals(depth: np.ndarray, f: float, k: int = 3, gamma: float = 0.05) -> np.ndarray:
    """(h, w, 3) unit normals: the least-variance direction of each k x k neighbourhood of similar depth, towards the camera."""
    h, w = depth.shape
    y, x = np.indices((h, w))
    points = np.stack([(x + 0.5 - w / 2) / f * depth, (y + 0.5 - h / 2) / f * depth, depth], -1)
    r = k // 2
    near = np.lib.stride_tricks.sliding_window_view(np.pad(points, ((r, r), (r, r), (0, 0)), mode="edge"), (k, k), axis=(0, 1)).reshape(h, w, 3, k * k).swapaxes(2, 3)
    close = np.abs(near[..., 2] - depth[..., None]) <= gamma * depth[..., None]
    n = close.sum(-1)[..., None]
    centred = (near - (near * close[..., None]).sum(2, keepdims=True) / n[..., None]) * close[..., None]
    _, vectors = np.linalg.eigh(np.einsum("hwki,hwkj->hwij", centred, centred))
    normal = vectors[..., 0]
    return normal * np.where((normal * points).sum(-1) > 0, -1.0, 1.0)[..., None]
