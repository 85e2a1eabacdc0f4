"""Joins: positional, nearest in time with a tolerance, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_within(left: DataFrame, right: DataFrame, by: list[str], t: str, tolerance: float) -> DataFrame:
    """Left rows with ``match_t``, the nearest right time less than the tolerance away; of two equally near the earlier.

    Both sides are unioned and sorted once per key; range frames make equal times visible from both sides.
    """
    sided = left.withColumn("right_t", F.lit(None).cast("double")).unionByName(right.select(*by, F.col(t), F.col(t).cast("double").alias("right_t")).distinct(), allowMissingColumns=True)
    sided = sided.withColumn("is_left", F.col("right_t").isNull())
    order = Window.partitionBy(*by).orderBy(t)
    before = F.max("right_t").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min("right_t").over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    found = sided.select("*", before.alias("p"), after.alias("n")).where("is_left")
    nearest = F.when(F.col("n").isNull() | (F.col(t) - F.col("p") <= F.col("n") - F.col(t)), F.col("p")).otherwise(F.col("n"))
    return found.withColumn("match_t", nearest).where(F.abs(F.col("match_t") - F.col(t)) < tolerance).drop("p", "n", "right_t", "is_left")


def zip_by_position(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Pairs the rows of two sorted sides by position, to the shorter one's end; columns must differ but for ``by``."""
    number = lambda df, order: df.withColumn("pos", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    return number(left, left_order).join(number(right, right_order), [*by, "pos"])


def covered(required: DataFrame, available: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """Per group: how many required keys there are and are missing, and whether all are available."""
    marked = required.join(available.select(*key).distinct().withColumn("there", F.lit(True)), key, "left")
    missing = F.count_if(F.col("there").isNull())
    return marked.groupBy(*group).agg(F.count("*").alias("n_required"), missing.alias("n_missing"), (missing == 0).alias("complete"))


def insert_absent(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with the rows whose key it lacks: an idempotent insert."""
    return table.unionByName(rows.join(table.select(*key), key, "left_anti"))


def anti(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    return left.join(right, key, "left_anti")


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason whose condition holds; null if none does."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(out)
    return out
