"""Colour as column expressions: hue round trips, adjustments of whole images, and persistent jitter."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clamp, keyed_hash

__all__ = ["adjust", "black_body_gains", "from_hsv", "jitter", "jitter_parameters", "pixel", "to_hsv"]

#: Weights of red, green and blue in grey.
GREY = (0.299, 0.587, 0.114)
#: Wavelengths in metres of the three channels, h c / k in metre kelvins, and the white that needs no gain.
WAVES, RADIATION, WHITE = (610e-9, 550e-9, 465e-9), 1.438776877e-2, 6500.0


def pixel(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("double").alias("r"), g.cast("double").alias("g"), b.cast("double").alias("b"))


def _each(p: Column, f) -> Column:
    return pixel(*[f(p[c]) for c in "rgb"])


def _grey(p: Column) -> Column:
    return GREY[0] * p["r"] + GREY[1] * p["g"] + GREY[2] * p["b"]


def to_hsv(p: Column) -> Column:
    """struct<h,s,v> of a pixel in [0, 1]; a grey one has hue 0, black saturation 0."""
    r, g, b = p["r"], p["g"], p["b"]
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    span = v - low
    part = lambda a, c: F.coalesce(F.try_divide(a - c, span), F.lit(0.0))
    sixth = F.when(span == 0, 0.0).when(v == r, part(g, b)).when(v == g, part(b, r) + 2).otherwise(part(r, g) + 4)
    return F.struct(_unit(sixth / 6).alias("h"), F.coalesce(F.try_divide(span, v), F.lit(0.0)).alias("s"), v.alias("v"))


def _unit(x: Column) -> Column:
    """The part of x behind the point, in [0, 1)."""
    return x - F.floor(x)


def from_hsv(p: Column) -> Column:
    """The pixel of a struct<h,s,v>: each channel falls off with the distance of the hue from its own."""
    def channel(n: int) -> Column:
        k = (n + p["h"] * 6) % 6
        return p["v"] - p["v"] * p["s"] * F.greatest(F.least(k, 4 - k, F.lit(1.0)), F.lit(0.0))

    return pixel(channel(5), channel(3), channel(1))


def adjust(image: Column, kind: str, factor: Column) -> Column:
    """An image (an array of pixels in [0, 1]) with its brightness, contrast, saturation or hue changed.

    The first three blend with black, with the image's mean grey and with each pixel's grey; a factor of 1 changes nothing.
    The hue turns by the factor, 1 being a whole turn; 0 changes nothing.
    """
    blend = lambda p, other: _each(p, lambda c: clamp(factor * c + (1 - factor) * other, 0.0, 1.0))
    if kind == "brightness":
        return F.transform(image, lambda p: blend(p, F.lit(0.0)))
    if kind == "contrast":
        mean = F.aggregate(image, F.lit(0.0), lambda t, p: t + _grey(p)) / F.greatest(F.size(image), F.lit(1))
        # a lambda's argument holds the mean, as it is needed for each pixel
        return F.flatten(F.transform(F.array(mean), lambda m: F.transform(image, lambda p: blend(p, m))))
    if kind == "saturation":
        return F.transform(image, lambda p: blend(p, _grey(p)))
    if kind != "hue":
        raise ValueError(f"{kind} is none of brightness, contrast, saturation and hue")

    def turned(p: Column) -> Column:
        hsv = to_hsv(p)
        return from_hsv(F.struct(_unit(hsv["h"] + factor).alias("h"), hsv["s"].alias("s"), hsv["v"].alias("v")))

    return F.transform(image, turned)


KINDS = ("brightness", "contrast", "saturation", "hue")


def _uniform(low: float, high: float, *key: Column | str) -> Column:
    return low + (high - low) * (keyed_hash(*key) / F.lit(4294967296.0))


def jitter_parameters(clip: Column, call: Column, persistent_for: int, seed: int, brightness: float = 0.0, contrast: float = 0.0, saturation: float = 0.0, hue: float = 0.0) -> Column:
    """struct of a factor for each kind, ``kelvin`` and the ``order`` of the kinds, the same for ``persistent_for`` calls in a row.

    Keyed by clip and number of the call (from 0), so any partitioning and any repetition gives the same.
    """
    if persistent_for < 1 or min(brightness, contrast, saturation, hue) < 0 or hue > 0.5:
        raise ValueError("parameters persist for one call at least; strengths are not negative, that of hue is 0.5 at most")
    key = [clip.cast("string"), F.floor(call / persistent_for).cast("string"), F.lit(str(seed))]
    spans = [(max(0.0, 1 - x), 1 + x) for x in (brightness, contrast, saturation)] + [(-hue, hue)]
    factors = [_uniform(low, high, *key, F.lit(kind)).alias(kind) for kind, (low, high) in zip(KINDS, spans, strict=True)]
    return F.struct(*factors, _uniform(3000.0, 15000.0, *key, F.lit("kelvin")).alias("kelvin"), (keyed_hash(*key, F.lit("order")) % math.factorial(len(KINDS))).cast("int").alias("order"))


def jitter(image: Column, parameters: Column) -> Column:
    """The image changed by all four kinds in the order of the parameters."""
    orders = F.array(*[F.array(*map(F.lit, o)) for o in permutations(range(len(KINDS)))])

    def step(before: Column, kind: Column) -> Column:
        out = adjust(before, KINDS[-1], parameters[KINDS[-1]])
        for k, name in enumerate(KINDS[:-1]):
            out = F.when(kind == k, adjust(before, name, parameters[name])).otherwise(out)
        return out

    return F.aggregate(F.element_at(orders, parameters["order"] + 1), image, step)


def black_body_gains(kelvin: Column) -> Column:
    """struct<r,b>: gains of red and blue against green for light of a black body, 1 at the temperature of white."""
    def radiance(wave: float, t: Column | float) -> Column:
        return 1.0 / (F.exp(F.lit(RADIATION / wave) / t) - 1.0)

    def gain(wave: float) -> Column:
        ratio = lambda t: radiance(wave, t) / radiance(WAVES[1], t)
        return ratio(kelvin) / ratio(F.lit(WHITE))

    return F.struct(gain(WAVES[0]).alias("r"), gain(WAVES[2]).alias("b"))
