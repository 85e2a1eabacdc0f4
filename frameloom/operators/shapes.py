"""Rasterised strokes: intervals of each pixel row from the crossings of stroked segments, combined as bits before pixels are made."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _angles(n: int, f) -> Column:
    """f of n angles from 0 to two pi, both included."""
    step = 2 * math.pi / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: f(i * F.lit(step)))


def wavy_circle(cx: Column, cy: Column, radius: Column, amplitude: Column, frequency: Column, sx: Column, sy: Column, turn: Column, n: int = 500) -> Column:
    """array<struct<x,y>>: a closed curve whose radius waves with the angle, turned by ``turn`` half turns and stretched."""

    def point(a: Column) -> Column:
        r, at = radius + amplitude * F.sin(frequency * a), a + turn * math.pi
        return F.struct((r * F.cos(at) * sx + cx).alias("x"), (r * F.sin(at) * sy + cy).alias("y"))

    return _angles(n, point)


def humanoid(cx: Column, cy: Column, rx: Column, ry: Column, body: Column, wave: Column, turn: Column, n: int = 500, side: int = 100) -> Column:
    """array<struct<x,y>>: a head (an ellipse) and a body (a waving quadrangle below it, ``body`` times as high)."""
    head = _angles(n, lambda a: F.struct((rx * F.sin(a) + cx).alias("x"), (ry * F.cos(a) + cy).alias("y")))
    top, low, part = cy + ry, cy + body * ry, []
    corners = [(cx - 0.8 * rx, top), (cx + 0.8 * rx, top), (cx + 1.2 * rx, low), (cx - 1.2 * rx, low)]  # shoulders, then feet
    for (x0, y0), (x1, y1) in zip(corners, [*corners[1:], corners[0]], strict=True):
        def point(a: Column, x0=x0, y0=y0, x1=x1, y1=y1) -> Column:
            s = a / (2 * math.pi)
            return F.struct((x0 + (x1 - x0) * s + F.sin(a + turn * math.pi) * wave).alias("x"), (y0 + (y1 - y0) * s + F.cos(a + turn * math.pi) * wave).alias("y"))

        part.append(_angles(side, point))
    return F.concat(head, *part)


def segments(shapes: DataFrame, by: list[str], points: str, width: str) -> DataFrame:
    """(by..., x0, y0, x1, y1, r): the pieces of each polyline; one point alone is a piece of no length."""
    n = F.size(points)
    begins, ends = (F.when(n > 1, F.slice(points, at, n - 1)).otherwise(F.col(points)) for at in (1, 2))
    rows = shapes.select(*by, F.explode(F.arrays_zip(begins.alias("a"), ends.alias("b"))).alias("p"), (F.col(width) / 2.0).alias("r"))
    rows = rows.select(*by, F.col("p.a").alias("a"), F.coalesce("p.b", "p.a").alias("b"), "r")
    return rows.select(*by, F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), "r")


def row_intervals(pieces: DataFrame, by: list[str], height: int) -> DataFrame:
    """(by..., y, low, high): in each pixel row, taken through the centres, what a piece with round ends covers; null if nothing.

    A piece is convex, so its crossings with a row are the ends of one interval: those of the two discs and of the four
    edges of the rectangle between them. Each step is a projection of its own, so that it is computed once, and there is no
    filter, which Spark would move before the steps and compute them for.
    """
    x0, y0, x1, y1, r, at, nx, ny = (F.col(c) for c in ("x0", "y0", "x1", "y1", "r", "at", "nx", "ny"))
    first, last = F.ceil(F.least(y0, y1) - r - 0.5), F.floor(F.greatest(y0, y1) + r - 0.5)
    first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(height - 1))
    length = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    across = pieces.where(r >= 0).select("*", F.try_divide((y1 - y0) * r, length).alias("nx"), F.try_divide((x0 - x1) * r, length).alias("ny"))
    rows = across.select("*", F.explode(F.when(first <= last, F.sequence(first, F.greatest(first, last)))).alias("y"))
    rows = rows.withColumn("at", F.col("y") + 0.5)

    def half(y: Column) -> Column:
        left = r * r - (at - y) * (at - y)
        return F.when(left >= 0, F.sqrt(F.greatest(left, F.lit(0.0))))

    corners = [(x0 + nx, y0 + ny), (x1 + nx, y1 + ny), (x1 - nx, y1 - ny), (x0 - nx, y0 - ny)]
    edges = list(zip(corners, [*corners[1:], corners[0]], strict=True))
    shares = rows.select("*", half(y0).alias("half0"), half(y1).alias("half1"), *[F.try_divide(at - a[1], b[1] - a[1]).alias(f"share{i}") for i, (a, b) in enumerate(edges)])
    met = [x0 - F.col("half0"), x0 + F.col("half0"), x1 - F.col("half1"), x1 + F.col("half1")]
    met += [F.when((F.col(f"share{i}") >= 0) & (F.col(f"share{i}") <= 1), a[0] + (b[0] - a[0]) * F.col(f"share{i}")) for i, (a, b) in enumerate(edges)]
    found = shares.select(*by, F.col("y").cast("long").alias("y"), *[m.alias(f"met{i}") for i, m in enumerate(met)])
    names = [f"met{i}" for i in range(len(met))]
    return found.select(*by, "y", F.least(*names).alias("low"), F.greatest(*names).alias("high"))


def merged(intervals: DataFrame, by: list[str]) -> DataFrame:
    """(by..., y, low, high): overlapping intervals of a row as one."""
    order = Window.partitionBy(*by, "y").orderBy("low", "high")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = intervals.where("low IS NOT NULL").withColumn("new", (F.col("low") > reached) | reached.isNull())
    numbered = begins.withColumn("run", F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*by, "y", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def words(intervals: DataFrame, by: list[str], width: int) -> DataFrame:
    """(by..., y, word, bits, first, last): the pixels whose centres lie in an interval, as bits of words of 64 pixels, and the ends of what is set.

    Overlapping intervals are combined by a hash aggregate, which begins before rows move, instead of a sort.
    """
    low, high = F.col("low"), F.col("high")
    cut = intervals.select(*by, "y", "low", F.greatest(F.ceil(low - 0.5), F.lit(0)).alias("first"), F.least(F.floor(high - 0.5), F.lit(width - 1)).cast("long").alias("last"))
    first, last, word = F.col("first"), F.col("last"), F.col("word")
    held = F.when(low.isNotNull() & (first <= last), F.sequence(F.shiftright(first, 6), F.greatest(F.shiftright(first, 6), F.shiftright(last, 6))))
    parts = cut.select(*by, "y", "first", "last", F.explode(held).alias("word"))
    parts = parts.select(*by, "y", "word", F.greatest(first, word * 64).alias("first"), F.least(last, word * 64 + 63).alias("last"))
    ones = F.lit(-1).cast("long")
    bits = F.call_function("shiftleft", ones, (first % 64).cast("int")).bitwiseAND(F.call_function("shiftrightunsigned", ones, (63 - last % 64).cast("int")))
    return parts.groupBy(*by, "y", "word").agg(F.bit_or(bits).alias("bits"), F.min("first").alias("first"), F.max("last").alias("last"))


def pixels(covered: DataFrame, by: list[str]) -> DataFrame:
    """(by..., y, x): the pixels that are set in the words of a row, each once."""
    each = covered.select(*by, "y", "bits", F.explode(F.sequence("first", "last")).alias("x"))
    return each.where(F.call_function("getbit", F.col("bits"), (F.col("x") % 64).cast("int")) == 1).select(*by, "y", "x")


def rasterise(shapes: DataFrame, by: list[str], points: str, width: str, size: tuple[int, int]) -> DataFrame:
    """(by..., y, x) of the pixels of a (height, width) raster within half the line's width of the polyline.

    Rows of one key are drawn over each other. An empty polyline and a null or negative width give no pixels; what lies
    beyond the raster is cut off. Shapes that are dealt by their key, or a part of it, stay where they are.
    """
    return pixels(words(row_intervals(segments(shapes, by, points, width), by, size[0]), by, size[1]), by)
