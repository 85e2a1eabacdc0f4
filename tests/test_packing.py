"""Greedy packing against the plain fold."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import packing, sampling


def _fold(rows, limit):
    """{(group, order): shard}."""
    out, groups = {}, defaultdict(list)
    for g, i, n in rows:
        groups[g].append((i, max(n or 0, 0)))
    for g, items in groups.items():
        shard = held = 0
        for i, n in sorted(items):
            if held > 0 and held + n > limit:
                shard, held = shard + 1, 0
            held += n
            out[g, i] = shard
    return out


def _random(seed, n, groups, top):
    rng = np.random.default_rng(seed)
    names = [None if g == 0 else f"g{g}" for g in groups]
    sizes = rng.integers(0, top, n) * (rng.random(n) > 0.2)
    big = rng.random(n) < 0.03
    return [(names[k], i, None if x % 13 == 5 else int(x * 40 if b else x)) for i, (k, x, b) in enumerate(zip(rng.integers(0, len(names), n) * (rng.random(n) > 0.5), sizes, big, strict=True))]


@pytest.mark.parametrize("seed,groups,top,limit,block", [(1, [0, 1, 2], 10, 30, 40), (2, [3], 10, 25, 17), (3, [1], 3, 400, 25), (4, [1, 2], 50, 10, 30), (5, [4], 2, 0, 30), (6, range(40), 10, 30, 50), (7, [5], 10, 10**9, 20)])
def test_packing_equals_the_fold(spark, seed, groups, top, limit, block):
    rows = _random(seed, 700, list(groups), top)
    df = spark.createDataFrame([(*r, "old") for r in rows], "g string, i long, n int, shard string").repartition(3)
    got = sampling.pack(df, "g", ["i"], "n", limit, block).collect()
    assert {(r["g"], r["i"]): r["shard"] for r in got} == _fold(rows, limit) and len(got) == len(rows)
    assert set(got[0].asDict()) == {"g", "i", "n", "shard"}


def test_all_zeros_one_block_and_nothing(spark):
    df = spark.createDataFrame([("a", i, 0) for i in range(100)], "g string, i long, n long")
    assert {r["shard"] for r in packing.pack(df, "g", ["i"], "n", 5, 10).collect()} == {0}
    assert packing.pack(df.where("false"), "g", ["i"], "n", 5).count() == 0
    assert {r["shard"] for r in packing.pack(df.withColumn("n", F.lit(None).cast("long")), "g", ["i"], "n", 5).collect()} == {0}
    with pytest.raises(ValueError):
        packing.pack(df, "g", ["i"], "n", -1)


def test_one_group_stands_in_many_blocks_and_tasks(spark):
    df = spark.range(3_000).select(F.lit("hot").alias("g"), F.col("id").alias("i"), (F.col("id") % 7 + 1).alias("n"))
    out = packing.pack(df, "g", ["i"], "n", 50, 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small tasks are put together
    try:
        got = out.select("i", "shard", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {("hot", r["i"]): r["shard"] for r in got} == _fold([("hot", i, i % 7 + 1) for i in range(3_000)], 50)
    assert len({r["task"] for r in got}) > 1


def test_following_pointers():
    following = np.array([2, 3, 5, 4, 9, 9, 9, 9, 9])
    last, steps = packing._followed(following)
    assert last.tolist() == [5, 4, 5, 4, 4, 5, 6, 7, 8] and steps.tolist() == [2, 2, 1, 1, 0, 0, 0, 0, 0]
