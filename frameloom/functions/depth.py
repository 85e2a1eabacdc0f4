"""Depth normalisers, disparity, masks and tone curves."""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clamp, safe_div

__all__ = ["CURVES", "bezier", "canonical_scale", "crop_mask", "curve_points", "decode_depth", "denormalise", "depth_to_disparity", "disparity_to_depth", "in_range", "log_normalise", "lut", "min_max", "normalise_percentile", "quantile_normalise", "rgb_normalise", "sky_mask"]

# Raw units per metre of each dataset's depth images.
DEPTH_UNITS = {"kitti": 256.0, "nyu": 1000.0, "scannet": 1000.0, "bonn": 5000.0, "vkitti": 100.0, "scenenet": 1000.0}

# Control points (x, y) behind (0, 0) and before (1, 1) of the tone curves.
CURVES = {
    "high": ((0.664884135472371, 0.0518518518518519), (0.923351158645276, 0.355555555555556)),
    "medium": ((0.643831503893424, 0.128774928774929), (0.867210807768083, 0.365170940170941)),
    "low": ((0.577164837226757, 0.152813390313391), (0.839140632329486, 0.437286324786326)),
}


def decode_depth(dataset: Column, raw: Column) -> Column:
    """Metres from raw units; KITTI's 0 means missing and becomes -1."""
    out = F.lit(None).cast("double")
    for name, unit in DEPTH_UNITS.items():
        metres = raw / unit
        out = F.when(dataset == name, F.when(raw == 0, F.lit(-1.0)).otherwise(metres) if name == "kitti" else metres).otherwise(out)
    return out


def in_range(d: Column, low: float, high: float) -> Column:
    """Valid depth: strictly between the limits."""
    return (d > low) & (d < high)


def sky_mask(d: Column, low: float, high: float) -> Column:
    return (d > low) & (d >= high)


# Fractions (top, bottom, left, right) of the evaluation crops.
CROPS = {"garg": (0.40810811, 0.99189189, 0.03594771, 0.96405229), "eigen": (0.3324324, 0.91351351, 0.0359477, 0.96405229)}


def crop_mask(kind: str, y: Column, x: Column, h: int, w: int) -> Column:
    top, bottom, left, right = CROPS[kind]
    return (y >= int(top * h)) & (y < int(bottom * h)) & (x >= int(left * w)) & (x < int(right * w))


def rgb_normalise(x: Column) -> Column:
    return clamp(x / 127.5 - 1.0, -1.0, 1.0)


def min_max(x: Column, low: Column, high: Column, eps: float = 1e-8) -> Column:
    return (x - low) / (high - low + eps)


def power_curve(d: Column, k: float) -> Column:
    """d ** (1 / ln k) for k above 1, else d."""
    return d.cast("double") if k <= 1 else F.pow(F.greatest(d, F.lit(0.0)), F.lit(1.0 / math.log(k)))


def normalise_percentile(d: Column, lo: Column, hi: Column, near: float, far: float, k: float = 1.0, near_value: float = -1.0, far_value: float = 1.0, flip: bool = False, eps: float = 1e-6) -> Column:
    """Maps [lo, hi] to [-1, 1] without clamping; at or beyond the planes the given values; lo and hi are of the curved, valid depths."""
    curved = power_curve(d, k)
    scaled = F.when(F.abs(hi - lo) < eps, F.when(curved > lo + eps, 1.0).otherwise(-1.0)).otherwise((safe_div(curved - lo, hi - lo) - 0.5) * 2.0)
    out = F.when(d >= far - eps, F.lit(far_value)).when(d <= near + eps, F.lit(near_value)).when(lo.isNull(), 0.0).otherwise(scaled)
    return -out if flip else out


def denormalise(n: Column, lo: Column, hi: Column) -> Column:
    return (n / 2.0 + 0.5) * (hi - lo) + lo


def log_normalise(d: Column, k: float, far: float) -> Column:
    return (F.log1p(k * F.greatest(d, F.lit(0.0))) / math.log1p(k * far) - 0.5) * 2.0


def quantile_normalise(d: Column, lo: Column, hi: Column, clip: bool = True, low: float = -1.0, high: float = 1.0) -> Column:
    out = safe_div(d - lo, hi - lo) * (high - low) + low
    return clamp(out, low, high) if clip else out


def depth_to_disparity(d: Column) -> Column:
    return F.when(d > 0, 1.0 / d).otherwise(0.0)


def disparity_to_depth(disparity: Column, fx: Column, baseline: float, far: float) -> Column:
    return F.when(disparity > 0, clamp(fx * baseline / disparity, 0.0, far)).otherwise(F.lit(far))


def canonical_scale(focal: float, width: Column, fx: Column, target: float) -> Column:
    return focal * width / (fx * target + 1e-8)


def curve_points(name: str, samples: int = 1024) -> tuple[list[float], list[float]]:
    """The curve's look-up table: a cubic Bézier sampled at even parameters."""
    (ax, ay), (bx, by) = CURVES[name]
    ts = [i / (samples - 1) for i in range(samples)]
    at = lambda p, q: [3 * (1 - t) ** 2 * t * p + 3 * (1 - t) * t * t * q + t**3 for t in ts]
    return at(ax, bx), at(ay, by)


def bezier(t: Column, *points: tuple[float, float]) -> tuple[Column, Column]:
    """The point of a cubic Bezier curve at parameter t."""
    u = 1 - t
    weights = (u * u * u, 3 * u * u * t, 3 * u * t * t, t * t * t)
    return tuple(sum((w * p[k] for w, p in zip(weights, points, strict=True)), F.lit(0.0)) for k in (0, 1))


def lut(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise-linear interpolation, constant outside: a two-level search over literal arrays, whose cost grows with the root of their length."""
    if len(xs) < 2:
        return F.lit(ys[0])
    step = int(len(xs) ** 0.5)
    every, heads, values = (F.lit(list(map(float, v))) for v in (xs, xs[::step], ys))
    not_above = lambda a: F.size(F.filter(a, lambda k: k <= x))
    # one lambda argument holds the place, as higher-order functions do not share subexpressions
    coarse = (not_above(heads) - 1) * step
    place = F.transform(F.array(F.greatest(coarse, F.lit(0))), lambda c: c + F.greatest(not_above(F.slice(every, c + 1, F.lit(step))), F.lit(1)) - 1)

    def between(i: Column) -> Column:
        x0, x1, y0, y1 = F.get(every, i), F.get(every, i + 1), F.get(values, i), F.get(values, i + 1)
        return y0 + F.when(x1 > x0, (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(0.0)

    return F.when(x < xs[0], ys[0]).when(x >= xs[-1], ys[-1]).otherwise(F.transform(place, between)[0])


def lut_value(x: float, xs: list[float], ys: list[float]) -> float:
    i = min(max(bisect_right(xs, x) - 1, 0), len(xs) - 2)
    return ys[i] + (x - xs[i]) / ((xs[i + 1] - xs[i]) or 1.0) * (ys[i + 1] - ys[i])
