"""Global orders without a global window: rows are dealt to ranges of the order, and each range starts from the total before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range; the bounds stand in the plan, so there are at most MAX_RANGES of them.
RANGE_ROWS, MAX_RANGES = 250_000, 4_096


def _bounds(keyed: DataFrame, n: int, ranges: int) -> list:
    """The keys that part a sorted sample of about 32 rows a range."""
    sample = keyed.sample(fraction=min(1.0, 32 * ranges / n), seed=7).orderBy("k").collect()
    step = max(1, len(sample) // ranges)
    return [r["k"] for r in sample[step::step]][: ranges - 1]


def dealt(rows: DataFrame, order: list[str], range_rows: int = 0, name: str = "__range") -> DataFrame:
    """Adds ``name``: the number of the range of the ascending order (nulls first) that a row falls in.

    Rows are compared with the bounds of their range, which are literals, so recomputed tasks agree; rows of equal
    order share a range, so the order should tell rows apart.
    """
    n = rows.count()
    ranges = max(1, min(MAX_RANGES, -(-n // (range_rows or RANGE_ROWS))))
    key = F.struct(*[F.col(c) for c in order])
    bounds = _bounds(rows.select(key.alias("k")), n, ranges) if ranges > 1 else []
    if not bounds:
        return rows.withColumn(name, F.lit(0))
    types = rows.select(key.alias("k")).schema["k"].dataType.simpleString()
    literal = lambda ks: F.array(*[F.struct(*[F.lit(v) for v in k]).cast(types) for k in ks])
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda a: F.size(F.filter(a, lambda b: b <= key))
    coarse = below(literal(bounds[step - 1 :: step])) * step
    return rows.withColumn(name, coarse + below(F.slice(literal(bounds), coarse + 1, step)))


def running_total(rows: DataFrame, order: list[str], value: Column, name: str, range_rows: int = 0) -> DataFrame:
    """Adds ``name``: the sum of value over the rows up to this one, in ascending order (nulls first).

    Rows are dealt to ranges of the order. Each range is a window of its own, and the totals of the ranges before are a
    row per range. Sums are of longs; ties are numbered in any order.
    """
    columns = rows.columns
    ranged = dealt(rows, order, range_rows).withColumn("__value", value.cast("long"))
    totals = ranged.groupBy("__range").agg(F.sum("__value").alias("__total"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per range
    totals = totals.select(F.col("__range").alias("__r"), (F.sum("__total").over(before) - F.col("__total")).alias("__before"))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("__within", F.sum("__value").over(within))
    joined = summed.join(F.broadcast(totals), F.col("__range") == F.col("__r"))  # MAX_RANGES rows at most
    return joined.select(*columns, (F.col("__before") + F.col("__within")).cast("long").alias(name))


def numbered(rows: DataFrame, order: list[str], name: str, range_rows: int = 0) -> DataFrame:
    """Adds ``name``: the place of each row in ascending order, from 1."""
    return running_total(rows, order, F.lit(1), name, range_rows)
