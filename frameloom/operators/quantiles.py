"""Exact quantiles of groups of any size, by refining histograms.

A group's wanted ranks begin in the interval from its least to its greatest value. A pass counts the values of each
interval that is too large in bins, and a rank moves to the bin that holds it, whose least and greatest values become its
interval. The first pass takes powers of two as bins, the others equal widths, so an interval is down to one value in
1 + 52 / log2(bins) passes whatever the values. Intervals of at most ``held`` values are sorted at the end. A task holds
bins, or ``held`` values of a group, never a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import release, written

#: Octaves of infinities and NaN, beyond those of all numbers.
_INFINITE, _NAN = 5_000, 6_000


def _octave(v: Column) -> Column:
    """A number that does not fall as v rises, equal for values of one sign and power of two."""
    size = F.when(F.abs(v) == float("inf"), _INFINITE).otherwise(F.floor(F.log2(F.abs(v))) + 1_100)
    return F.when(F.isnan(v), _NAN).when(v == 0, 0).otherwise(F.when(v > 0, size).otherwise(-size)).cast("long")


def _slot(v: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin of equal width between low and high; halves keep the width finite."""
    share = F.coalesce(F.try_divide(v / 2 - low / 2, high / 2 - low / 2), F.lit(0.0))
    inner = F.greatest(F.least(F.floor(share * bins), F.lit(bins - 2)), F.lit(0))
    return F.when(v >= high, bins - 1).when(v <= low, 0).otherwise(inner).cast("long")


def exact_quantiles(rows: DataFrame, by: list[str], value: Column, quantiles: list[float], held: int = 100_000, bins: int = 1_024, out: str = "q") -> DataFrame:
    """(by..., n, q): for each group the number of values and an array of quantiles, linear between neighbouring values.

    Null values do not count; a group without values has n 0 and null quantiles. NaN is greater than all others, -0.0 equals
    0.0, and a null key is a group. Interpolation is low + (high - low) * fraction, as in SQL's quantile_cont.
    """
    if not quantiles or any(not 0 <= q <= 1 for q in quantiles) or held < 1 or bins < 4:
        raise ValueError("quantiles lie between 0 and 1, held is 1 at least and bins 4")
    keys = [f"__k{i}" for i in range(len(by))]
    values = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], (value.cast("double") + 0.0).alias("__v"))
    groups = written(values.groupBy(*keys).agg(F.count("__v").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")), "groups")
    place = lambda q: (F.col("n") - 1) * F.lit(q)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in quantiles])))
    # a wanted rank: its interval, its place in the interval, and how many values the interval has
    state = written(groups.where("n > 0").select(*keys, F.explode(ranks).alias("rank"), "low", "high", "n").withColumn("at", F.col("rank")), "ranks")
    old = [state]
    mine = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    both = lambda a, b, *more: _all([*mine(a, b), *more])

    def within(wanted: DataFrame) -> DataFrame:
        """The values that lie in a wanted interval; intervals of a group are the same or apart."""
        spans = wanted.groupBy(*keys).agg(F.collect_set(F.struct("low", "high")).alias("spans"))  # at most twice as many as quantiles
        hit = F.filter("spans", lambda s: (F.col("__v") >= s["low"]) & (F.col("__v") <= s["high"]))
        joined = values.where("__v IS NOT NULL").join(spans, both(values, spans)) if keys else values.where("__v IS NOT NULL").crossJoin(F.broadcast(spans))  # one row
        return joined.select(*[values[k] for k in keys], "__v", F.get(hit, F.lit(0)).alias("s")).where("s IS NOT NULL").select(*keys, "__v", "s.low", "s.high")

    first = True
    while not (large := state.where((F.col("low") != F.col("high")) & (F.col("n") > held))).isEmpty():
        slot = _octave(F.col("__v")) if first else _slot(F.col("__v"), F.col("low"), F.col("high"), bins)
        counts = within(large).groupBy(*keys, "low", "high", slot.alias("slot")).agg(F.count("*").alias("m"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        order = Window.partitionBy(*keys, "low", "high").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per bin
        counts = counts.withColumn("upto", F.sum("m").over(order))
        moved = large.alias("a").join(counts.alias("b"), _all([*[F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "low", "high")], F.col("a.at") < F.col("b.upto"), F.col("a.at") >= F.col("b.upto") - F.col("b.m")]))
        moved = moved.select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.rank", F.col("b.lo").alias("low"), F.col("b.hi").alias("high"), F.col("b.m").alias("n"), (F.col("a.at") - F.col("b.upto") + F.col("b.m")).alias("at"))
        rest = state.where(~((F.col("low") != F.col("high")) & (F.col("n") > held)))
        state, first = written(rest.unionByName(moved), "ranks"), False
        old.append(state)
    apart = state.where(F.col("low") != F.col("high"))
    sorted_values = within(apart).groupBy(*keys, "low", "high").agg(F.sort_array(F.collect_list("__v")).alias("sorted"))  # held values at most
    found = apart.alias("a").join(sorted_values.alias("b"), _all([F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "low", "high")]))
    found = found.select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.rank", F.get("b.sorted", F.col("a.at").cast("int")).alias("v"))
    known = written(found.unionByName(state.where(F.col("low") == F.col("high")).select(*keys, "rank", F.col("low").alias("v"))), "values")
    release(*old)
    by_rank = known.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("ranked"))
    joined = groups.join(by_rank, both(groups, by_rank), "left") if keys else groups.crossJoin(F.broadcast(by_rank))  # one row
    ends = lambda q: (F.element_at("ranked", F.floor(place(q))), F.element_at("ranked", F.ceil(place(q))))
    between = lambda low, high, part: F.when(low == high, low).otherwise(low + (high - low) * part)
    array = F.array(*[between(*ends(q), place(q) - F.floor(place(q))) for q in quantiles])
    return joined.select(*[groups[k].alias(c) for c, k in zip(by, keys, strict=True)], groups["n"], F.when(groups["n"] > 0, array).alias(out))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
