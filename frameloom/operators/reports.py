"""Ranked reports over a row per scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(scenes: DataFrame, key: Column, tie: str, n: int = 3, descending: bool = True) -> DataFrame:
    """The n best rows with ``rank``; ties keep the order of ``tie``."""
    keyed = scenes.withColumn("value", key)
    order = Window.orderBy(F.col("value").desc() if descending else F.col("value").asc(), F.col(tie).asc())
    best = keyed.orderBy(F.col("value").desc() if descending else F.col("value").asc(), F.col(tie).asc()).limit(n)  # a top-n report
    return best.withColumn("rank", F.row_number().over(order).cast("long"))


def ranked(scenes: DataFrame, scene: str, specs: list[tuple[str, Column, bool, Column]], n: int, digits: int = 6) -> DataFrame:
    """(category, rank, scene, value) of many top-n reports in one pass; a spec: (category, value, descending, condition).

    Values are compared as rounded, so that engines agree; ties go by scene.
    """
    entries = [F.struct(F.lit(name).alias("category"), F.round(value.cast("double"), digits).alias("value"), F.lit(down).alias("down"), F.coalesce(keep, F.lit(False)).alias("keep")) for name, value, down, keep in specs]
    long = scenes.select(scene, F.inline(F.array(*entries))).where("keep")
    best = Window.partitionBy("category").orderBy(F.when(F.col("down"), -F.col("value")).otherwise(F.col("value")), scene)
    return long.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= n).select("category", "rank", scene, "value")


def purity(scenes: DataFrame, axes: list[str], eps: float = 1e-6) -> DataFrame:
    """Adds purity_<axis>: an axis over the sum of the others, each over its maximum (1 if that is 0)."""
    tops = scenes.agg(*[F.max(F.coalesce(F.col(a), F.lit(0.0))).alias(f"top_{a}") for a in axes])
    normal = {a: F.coalesce(F.col(a), F.lit(0.0)) / F.when(F.coalesce(F.col(f"top_{a}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"top_{a}")) for a in axes}
    scored = scenes.crossJoin(F.broadcast(tops))  # one row
    return scored.select(*scenes.columns, *[(normal[a] / (sum((normal[b] for b in axes if b != a), F.lit(0.0)) + eps)).alias(f"purity_{a}") for a in axes])


def standing(scenes: DataFrame, metrics: list[str], scene: str) -> DataFrame:
    """(metric, scene, rank, n): 1 + the number of scenes that are strictly better in the metric."""
    long = scenes.unpivot([scene], metrics, "metric", "value")
    by = Window.partitionBy("metric")
    return long.select("metric", scene, F.rank().over(by.orderBy(F.col("value").desc())).cast("long").alias("rank"), F.count("*").over(by).alias("n"))
