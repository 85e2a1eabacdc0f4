"""Intrinsics, projection, normals and blending weights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["angular_error", "border_weight", "distance_to_depth", "focal_to_fov", "fov_to_focal", "ramp", "sensor_focal", "tent", "unproject", "z_to_radial"]


def fov_to_focal(fov_degrees: Column, size: float) -> Column:
    return size / (2.0 * F.tan(F.radians(fov_degrees) / 2.0))


def focal_to_fov(focal: Column, size: float) -> Column:
    return F.degrees(2.0 * F.atan(size / (2.0 * focal)))


def sensor_focal(focal_mm: Column, sensor_mm: Column, width: Column) -> Column:
    """Focal length in pixels, the image width if the metadata lacks it."""
    return F.coalesce(F.when((sensor_mm > 0) & (focal_mm > 0), focal_mm / sensor_mm * width), width.cast("double"))


def unproject(y: Column, x: Column, depth: Column, f: float, cy: float, cx: float) -> tuple[Column, Column, Column]:
    """Camera coordinates of a pixel's centre."""
    return (x + 0.5 - cx) / f * depth, (y + 0.5 - cy) / f * depth, depth


def z_to_radial(y: Column, x: Column, z: Column, f: float, cy: float, cx: float) -> Column:
    u, v = (x + 0.5 - cx) / f, (y + 0.5 - cy) / f
    return z * F.sqrt(u * u + v * v + 1.0)


def distance_to_depth(y: Column, x: Column, distance: Column, f: float, h: int, w: int) -> Column:
    """Planar depth from the distance to the camera's centre, image plane at f."""
    u, v = x - 0.5 * w + 0.5, y - 0.5 * h + 0.5
    return distance / F.sqrt(u * u + v * v + f * f) * f


def angular_error(a: list[Column], b: list[Column]) -> Column:
    """Angle between vectors in degrees."""
    dot = sum((p * q for p, q in zip(a, b, strict=True)), F.lit(0.0))
    norm = lambda v: F.sqrt(sum((p * p for p in v), F.lit(0.0)))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.greatest(norm(a) * norm(b), F.lit(1e-12))))))


def ramp(pos: Column, start: Column, end: Column, length: Column, overlap: int) -> Column:
    """Feather weight: 1 inside, rising and falling linearly where a neighbour overlaps, not at the frame's border."""
    up = F.when(start > 0, (pos - start + 1) / overlap).otherwise(1.0)
    down = F.when(end < length, (end - pos) / overlap).otherwise(1.0)
    return F.least(F.lit(1.0), up, down)


def tent(pos: Column, size: int) -> Column:
    """Triangle weight with a floor of 0.05."""
    half = (size - 1) / 2
    return F.greatest(F.lit(0.05), 1.0 - F.abs(pos - half) / (half + 1))


def border_weight(y: Column, x: Column, h: int, w: int, border: int) -> Column:
    """Distance to the nearest border over the border's width, at most 1."""
    return F.least(F.lit(1.0), F.least(x + 1, w - x, y + 1, h - y) / border)


def vector_length(v: list[Column]) -> Column:
    return F.sqrt(sum((p * p for p in v), F.lit(0.0)))


FULL_CIRCLE = 2 * math.pi
