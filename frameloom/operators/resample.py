"""Resizing of rasters of mixed sizes by tables of weights: a row per output position, input position and weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the sharpness of cubic weights.
CUBIC = -0.75
METHODS = ("nearest", "linear", "cubic", "area")


def _cubic(d: Column) -> Column:
    """The weight at distance d of the cubic kernel."""
    near = ((CUBIC + 2) * d - (CUBIC + 3)) * d * d + 1
    far = ((CUBIC * d - 5 * CUBIC) * d + 8 * CUBIC) * d - 4 * CUBIC
    return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)


def taps(sizes: DataFrame, n: str, size: int, method: str) -> DataFrame:
    """(n, out, at, weight): how much the input position ``at`` of n counts in each of ``size`` outputs; a row for each that counts.

    Positions beyond an end are the end's. ``linear`` and ``cubic`` read 2 and 4 positions around the output's centre,
    ``nearest`` the one at its start, ``area`` all that it covers, by their share. Weights of an output sum to 1.
    """
    if method not in METHODS:
        raise ValueError(f"{method} is none of {METHODS}")
    if size < 1:
        raise ValueError("an output has a position at least")
    rows = sizes.select(F.col(n).cast("long").alias("n")).where("n > 0").distinct().select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias("out"))
    scale, out = F.col("n") / F.lit(float(size)), F.col("out")
    centre = (out + 0.5) * scale - 0.5
    if method == "nearest":
        each = F.array(F.struct(F.floor(out * F.col("n") / F.lit(size)).cast("long").alias("at"), F.lit(1.0).alias("w")))
    elif method == "area":
        low, high = out * scale, (out + 1) * scale
        covered = F.sequence(F.floor(low).cast("long"), F.greatest(F.floor(low).cast("long"), F.ceil(high).cast("long") - 1))
        each = F.transform(covered, lambda k: F.struct(k.alias("at"), ((F.least(k + 1.0, high) - F.greatest(k.cast("double"), low)) / scale).alias("w")))
    else:
        reach = 1 if method == "linear" else 2
        base = F.floor(centre).cast("long")
        weight = (lambda d: 1 - d) if method == "linear" else _cubic
        each = F.transform(F.sequence(base - reach + 1, base + reach), lambda k: F.struct(k.alias("at"), weight(F.abs(centre - k)).alias("w")))
    held = rows.select("n", "out", F.explode(each).alias("t")).select("n", "out", F.greatest(F.least(F.col("t.at"), F.col("n") - 1), F.lit(0).cast("long")).alias("at"), F.col("t.w").alias("w"))
    return held.groupBy("n", "out", "at").agg(F.sum("w").alias("weight")).where("weight <> 0")


def resize(pixels: DataFrame, by: list[str], h: str, w: str, values: list[str], size: tuple[int, int], method: str = "linear") -> DataFrame:
    """(by..., y, x, values...) of rasters resized to ``size`` from a row per pixel (by..., h, w, y, x, values...), whose sizes differ.

    First along x, then along y, so a pixel meets as many weights as its column has and then as its row has. A null value makes
    null what it counts in; rasters are full rectangles, and those of no rows or columns give nothing.
    """
    def along(rows: DataFrame, axis: str, length: str, target: int, others: list[str]) -> DataFrame:
        # a row for each size, output and input position that counts; Spark broadcasts it where it is small
        weights = taps(rows.select(length), length, target, method)
        met = rows.join(weights, (F.col(length) == F.col("n")) & (F.col(axis) == F.col("at")))
        whole = lambda v: F.when(F.count(v) == F.count("*"), F.sum(F.col(v) * F.col("weight"))).alias(v)
        return met.groupBy(*others, F.col("out").alias(axis)).agg(*[whole(v) for v in values])

    wide = along(pixels.select(*by, F.col(h).alias("h"), F.col(w).alias("w"), "y", "x", *[F.col(v).cast("double").alias(v) for v in values]), "x", "w", size[1], [*by, "h", "y"])
    return along(wide, "y", "h", size[0], [*by, "x"]).select(*by, "y", "x", *values)
