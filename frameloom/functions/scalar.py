"""Hashing, text and arithmetic helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["affine_fit", "clamp", "fmod_key", "keyed_hash", "keyed_int", "lerp", "missing_as_zero", "natural_key", "next_4n_plus_1", "pad_to_multiple", "ratio_or_inf", "safe_div", "six_stats"]


def keyed_hash(*parts: Column | str) -> Column:
    """A 32-bit hash of the parts, the same in any engine with md5: the seedable source of randomness."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def keyed_int(low: Column | int, high: Column | int, *parts: Column | str) -> Column:
    """A hash-keyed integer in [low, high)."""
    low, high = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (low, high))
    return low + F.pmod(keyed_hash(*parts), high - low)


def fmod_key(name: Column, choices: int) -> Column:
    """A stable choice among ``choices`` by name."""
    return F.pmod(keyed_hash(name), F.lit(choices).cast("long"))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(b != 0, a / b)


def ratio_or_inf(a: Column, b: Column, sentinel: float = float("inf")) -> Column:
    """a / b; where b is not positive, the sentinel for positive a and 0 otherwise."""
    return F.when(b > 0, a / b).otherwise(F.when(a > 0, F.lit(sentinel)).otherwise(F.lit(0.0)))


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    x = x if low is None else F.greatest(x, F.lit(float(low)))
    return x if high is None else F.least(x, F.lit(float(high)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def missing_as_zero(text: Column) -> Column:
    """A numeric cell; empty, null or malformed ones count as 0."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def six_stats(prefix: str, x: Column) -> list[Column]:
    """min, max, median, mean, population std and range of a group, as prefix_min and so on."""
    return [
        F.min(x).alias(f"{prefix}_min"), F.max(x).alias(f"{prefix}_max"), F.percentile(x, 0.5).alias(f"{prefix}_median"),
        F.avg(x).alias(f"{prefix}_mean"), F.stddev_pop(x).alias(f"{prefix}_std"), (F.max(x) - F.min(x)).alias(f"{prefix}_range"),
    ]


def affine_fit(x: Column, y: Column, w: Column | None = None) -> tuple[Column, Column]:
    """Aggregates (scale, shift) of the least-squares fit y = scale * x + shift; (1, 0) if it is degenerate."""
    inside = w if w is not None else F.lit(True)
    x, y = F.when(inside, x), F.when(inside, y)
    return F.coalesce(F.regr_slope(y, x), F.lit(1.0)), F.coalesce(F.regr_intercept(y, x), F.lit(0.0))


def natural_key(text: Column, width: int = 20) -> Column:
    """A key that sorts digit runs as numbers: tokens are digit runs padded with zeros, or single other characters."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+|\D)"), F.lit(1)), lambda t: F.when(t.rlike(r"^\d"), F.lpad(t, width, "0")).otherwise(t)), "")


def next_4n_plus_1(t: Column) -> Column:
    """The least length of the form 4n + 1 that is not below t."""
    return t + F.pmod(1 - t, F.lit(4))


def pad_to_multiple(n: Column, k: int) -> tuple[Column, Column]:
    """Padding before and behind that centres n in the next multiple of k."""
    pad = F.pmod(-n, F.lit(k))
    before = F.floor(pad / 2)
    return before, pad - before


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


# Wordings of allocators that have run dry.
OUT_OF_MEMORY = ("out of memory", "can't allocate memory", "cannot allocate memory", "not enough memory")
PREFETCH_SAMPLES = 256  # fixed value: samples that all workers together may hold


def is_out_of_memory(message: Column) -> Column:
    text = F.lower(message)
    return F.coalesce(reduce(lambda a, b: a | b, [text.contains(m) for m in OUT_OF_MEMORY]), F.lit(False))


def prefetch_for(batch: Column, workers: Column, requested: int) -> Column:
    """Batches to prefetch per worker: as requested, but within the budget of samples, and one at least."""
    share = F.floor(F.lit(PREFETCH_SAMPLES) / (F.greatest(workers, F.lit(1)) * F.greatest(batch, F.lit(1))))
    return F.when(workers <= 0, F.lit(requested)).otherwise(F.greatest(F.lit(1), F.least(F.lit(requested), share)))


def crop_box(height: Column, width: Column, to_height: int, to_width: int) -> Column:
    """struct<top,left,height,width>: the largest centred box of the target's shape."""
    wide = height * to_width < width * to_height
    w = F.floor(height / F.lit(float(to_height)) * to_width).cast("long")
    h = F.floor(width / F.lit(float(to_width)) * to_height).cast("long")
    half = lambda n: F.floor(n / 2).cast("long")
    zero = F.lit(0).cast("long")
    return F.struct(F.when(wide, zero).otherwise(half(height - h)).alias("top"), F.when(wide, half(width - w)).otherwise(zero).alias("left"), F.when(wide, height).otherwise(h).alias("height"), F.when(wide, w).otherwise(width).alias("width"))
