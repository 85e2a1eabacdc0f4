"""Shards by a keyed permutation of global row numbers.

Rows are numbered in a total order. A Feistel network on a grid of a * b >= n places, near the root of n each, permutes
the grid: its rounds add a hash of one coordinate to the other, in turn, so every round can be undone. A place beyond the
last row is permuted again until it is within (cycle walking), which leaves a permutation of the n row numbers. A row's
place p gives its shard, p modulo the number of shards, and its slot, p divided by it: sizes in rows differ by one at most,
slots have no gaps, and ``row_of`` computes which row stands in a slot without looking at any data.

Defined results: null ids come first; rows that are equal in all columns of the order are interchangeable; an empty table
gives an empty table; fewer rows than shards leave shards empty; of columns named as the added ones the added ones stay.
Everything is DataFrame functions. Nothing depends on how rows are partitioned, so a recomputed task deals as before.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from ._shared import fresh_path, materialize

ROUNDS = 6
#: Rows numbered by one task.
RANGE_ROWS = 10_000
#: Steps of a walk in the plan; where a walk may take more, that is less likely than 1e-100 for a row, and an error.
WALKS = 64
ADDED = ("row", "place", "shard", "slot")


def grid(n: int) -> tuple[int, int]:
    """(a, b), both near the root of n, whose a * b >= n exceeds n by as little as 256 widths allow."""
    root = isqrt(max(1, n))
    return min(((a, -(-n // a)) for a in range(root, max(root // 2, root - 256, 0), -1)), key=lambda ab: ab[0] * ab[1] - n)


def _rounds(x: Column, a: int, b: int, seed: int, back: bool) -> Column:
    """A permutation of 0 .. a * b - 1, or its inverse."""
    sign = -1 if back else 1

    def step(s: Column, k: Column) -> Column:
        left, right = s["l"], s["r"]
        moved = lambda own, other, m: F.pmod(own + sign * F.pmod(F.xxhash64(F.lit(seed).cast("long"), k, other), F.lit(m)), F.lit(m)).cast("long")
        return F.struct(F.when(k % 2 == 0, moved(left, right, a)).otherwise(left).alias("l"), F.when(k % 2 == 1, moved(right, left, b)).otherwise(right).alias("r"))

    order = F.array(*[F.lit(k).cast("long") for k in (reversed(range(ROUNDS)) if back else range(ROUNDS))])
    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    return F.aggregate(order, start, step, lambda s: s["l"] * b + s["r"])


def _walked(x: Column, n: int, seed: int, back: bool) -> Column:
    if n >= 1 << 52:
        raise ValueError("row numbers are to be below 2^52")
    a, b = grid(n)
    spare = a * b - n
    first = _rounds(x.cast("long"), a, b, seed, back)
    if not spare:
        return first
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(spare, WALKS))), first, lambda v, _: F.when(v < n, v).otherwise(_rounds(v, a, b, seed, back)))
    if spare <= WALKS:  # a walk meets each spare place once at most
        return walked
    return F.transform(F.array(walked), lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("a walk took too many steps; take another seed")).cast("long")))[0]


def permuted(row: Column, n: int, seed: int = 0) -> Column:
    """The place of row number ``row`` (from 0) in a shuffle of n rows."""
    return _walked(row, n, seed, False)


def row_of(shard: Column, slot: Column, n: int, shards: int, seed: int = 0) -> Column:
    """The number of the row that stands in a shard's slot; null where the slot is empty."""
    place = (slot.cast("long") * shards + shard).cast("long")
    return F.when((place >= 0) & (place < n), _walked(place, n, seed, True))


def shard_rows(rows: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Adds row, place, shard and slot; ``order`` is to tell rows apart. Rows are read several times, so they are best a written table."""
    if shards < 1:
        raise ValueError("there has to be a shard")
    n = rows.count()
    if clash := [c for c in ADDED if c in rows.columns]:
        kept = {c: f"__in_{c}" for c in clash}
        rows, order = rows.withColumnsRenamed(kept), [kept.get(c, c) for c in order]
    out = numbered(rows, order, "__row", RANGE_ROWS)
    row = (F.col("__row") - 1).cast("long")
    out = out.withColumn("row", row).withColumn("place", permuted(F.col("row"), n, seed) if n else F.lit(0).cast("long"))
    return out.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.floor(F.col("place") / shards).cast("long")}).drop("__row", *[f"__in_{c}" for c in ADDED])


def shard_documents(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, row, place, shard, slot) of every document: rows are numbered by id, ties by checksum and size.

    Only these narrow columns are sorted; size is the text's UTF-8 bytes plus 16, a null text has none.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_col).alias("__id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    dealt = shard_rows(materialize(narrow, "sharding"), ["__id", "text_crc32", "size"], shards, seed)
    return dealt.select(F.col("__id").alias(id_col), "size", "text_crc32", *ADDED)


def write_shards(sharded: DataFrame, path: str | None = None, files: int | None = None) -> str:
    """Writes rows with shard and slot as a folder per shard, in slot order, in one exchange by range; returns the path."""
    out = path or fresh_path(sharded.sparkSession, "shards")
    dealt = sharded.repartitionByRange(*([files] if files else []), "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(out)
    return out
