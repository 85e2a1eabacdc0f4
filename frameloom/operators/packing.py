"""Greedy packing of ordered items into shards of bounded size, in parallel.

A shard that begins at a row ends where the running sum passes the limit, so the row that begins the next shard is a function
of the row that begins this one. Rows are dealt to blocks of the global order. A block follows this function as far as it
stays inside, for all of its rows at once, by doubling pointers; what leaves it are *exits*, the last beginnings before the
block's end. Exits ask the block that holds the next beginning, which answers with its own exit, and doubling this function
of exits marks those that the first row of a group reaches, in as many rounds as the logarithm of a group's blocks. Each
block then knows what is open at its start and streams through its rows. A group may be larger than any task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import release, written
from .ordering import dealt

#: Numbers of a block's rows in the id of an exit.
_ROWS = 1 << 40


def _beginnings(sizes: np.ndarray, base: int, limit: int) -> np.ndarray:
    """For each row, the row that begins the next shard if this one begins a shard; the number of rows if none here."""
    upto = base + np.cumsum(sizes)
    before = upto - sizes
    return np.maximum(np.searchsorted(upto, before + limit, "right"), np.searchsorted(before, before, "right"))


def _followed(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the last row inside that each row leads to, number of steps): pointers are doubled until all stand."""
    n = len(following)
    at, steps = np.where(following < n, following, np.arange(n)), (following < n).astype(np.int64)
    while True:
        further = at[at]
        if (further == at).all():
            return at, steps
        at, steps = further, steps + steps[at]


class _Blocks:
    """What the driver knows of each block, and tells all tasks."""

    def __init__(self, rows: list, limit: int):
        self.limit, self.number = limit, np.array([r["block"] for r in rows], np.int64)
        totals = np.array([r["total"] for r in rows], np.int64)
        self.end = np.cumsum(totals)
        self.base = self.end - totals
        self.before_last = self.end - np.array([r["last"] for r in rows], np.int64)
        low, high = [r["low"][0] for r in rows], [r["high"][0] for r in rows]
        n = len(rows)
        #: whether a block begins within the group that ends the block before, and whether its last group goes on
        self.continued = np.array([i > 0 and low[i] == high[i - 1] for i in range(n)], bool)
        self.goes_on = np.append(self.continued[1:], False)
        self.one_group = np.array([a == b for a, b in zip(low, high, strict=True)], bool)
        self.stop = np.arange(n)  # the last block of the group that ends the block
        for i in range(n - 2, -1, -1):
            if self.continued[i + 1]:
                self.stop[i] = self.stop[i + 1] if self.one_group[i + 1] else i + 1
        self.longest = int((self.stop - np.arange(n)).max()) + 1 if n else 0

    def place(self, number: int) -> int:
        return int(np.searchsorted(self.number, number))

    def target(self, at: int, before: np.ndarray) -> np.ndarray:
        """The block that begins the shard after one that begins behind a sum of ``before`` in block ``at``; -1 if none does."""
        found = np.maximum(np.maximum(np.searchsorted(self.end, before + self.limit, "right"), np.searchsorted(self.before_last, before, "right")), at + 1)
        return np.where(found <= self.stop[at], self.number[np.minimum(found, len(self.number) - 1)], -1)


def _exits(narrow: DataFrame, blocks: _Blocks) -> DataFrame:
    """(exit, before, target, n) of the rows of a group that goes on: n is the shard's number where the group begins in the block, else null."""

    def of_block(number: int, sizes: np.ndarray, new: np.ndarray) -> pa.RecordBatch | None:
        at = blocks.place(number)
        if not blocks.goes_on[at]:
            return None
        first = int(np.flatnonzero(new)[-1])
        sizes, base = sizes[first:], int(blocks.base[at] + sizes[:first].sum())
        last, steps = _followed(_beginnings(sizes, base, blocks.limit))
        rooted = first > 0 or not blocks.continued[at]
        ends = last[:1] if rooted else np.unique(last)
        before = base + np.cumsum(sizes)[ends] - sizes[ends]
        n = pa.array(steps[:1]) if rooted else pa.nulls(len(ends), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(number * _ROWS + first + ends), pa.array(before), pa.array(blocks.target(at, before)), n], ["exit", "before", "target", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (sizes, new) in _by_block(batches, ("size", "new")):
            if (out := of_block(number, sizes, new)) is not None:
                yield out

    rows = narrow.select("block", "idx", "size", "new").repartition("block").sortWithinPartitions("block", "idx")
    return rows.mapInArrow(run, "exit long, before long, target long, n long")


def _by_block(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(block, its columns) of rows sorted by block."""
    held: dict[str, list[np.ndarray]] = {c: [] for c in columns}
    number = None
    for batch in batches:
        block = batch["block"].to_numpy()
        for piece in np.split(np.arange(len(block)), np.flatnonzero(block[1:] != block[:-1]) + 1):
            if not len(piece):
                continue
            if number is not None and block[piece[0]] != number:
                yield int(number), [np.concatenate(held[c]) for c in columns]
                held = {c: [] for c in columns}
            number = block[piece[0]]
            for c in columns:
                held[c].append(batch[c].to_numpy(zero_copy_only=False)[piece])
    if number is not None:
        yield int(number), [np.concatenate(held[c]) for c in columns]


def _edges(narrow: DataFrame, exits: DataFrame, blocks: _Blocks) -> DataFrame:
    """(at, to, n): the exit of the block that holds the next beginning, n shards later."""
    rows = narrow.select("block", F.lit(0).alias("asks"), "idx", "size", "new", F.lit(0).cast("long").alias("exit"))
    asks = exits.where("target >= 0").select(F.col("target").alias("block"), F.lit(1).alias("asks"), F.col("before").alias("idx"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("new"), "exit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (asks, idx, sizes, new, ids) in _by_block(batches, ("asks", "idx", "size", "new", "exit")):
            at, here = blocks.place(number), asks == 0
            if not (here.all() or not (blocks.goes_on[at] and blocks.one_group[at])):
                base, sizes, before = int(blocks.base[at]), sizes[here], idx[~here]
                last, steps = _followed(_beginnings(sizes, base, blocks.limit))
                upto = base + np.cumsum(sizes)
                entry = np.maximum(np.searchsorted(upto, before + blocks.limit, "right"), np.searchsorted(upto - sizes, before, "right"))
                yield pa.RecordBatch.from_arrays([pa.array(ids[~here]), pa.array(number * _ROWS + last[entry]), pa.array(1 + steps[entry])], ["at", "to", "n"])

    both = rows.unionByName(asks).repartition("block").sortWithinPartitions("block", "asks", "idx")
    return both.mapInArrow(run, "at long, to long, n long")


def _reached(exits: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """(exit, n) of the exits that the first row of their group leads to, by doubling; n is the shard's number in its group."""
    reached, jump, old = exits.where("n IS NOT NULL").select("exit", "n"), edges, []
    for k in range(rounds):
        more = reached.join(jump.select(F.col("at").alias("exit"), "to", F.col("n").alias("m")), "exit").select(F.col("to").alias("exit"), (F.col("n") + F.col("m")).alias("n"))
        reached = written(reached.unionByName(more), "reached")
        old.append(reached)
        if k < rounds - 1:
            jump = written(jump.join(jump.select(F.col("at").alias("to"), F.col("to").alias("far"), F.col("n").alias("m")), "to").select("at", F.col("far").alias("to"), (F.col("n") + F.col("m")).alias("n")), "jump")
            old.append(jump)
    reached.older = old
    return reached


def pack(items: DataFrame, by: str, order: list[str], size: str, limit: int, block_rows: int = 0) -> DataFrame:
    """Adds ``shard``: in order, a new shard begins when a nonempty one would pass the limit; an item above the limit stands alone.

    Shards are numbered from 0 in each group ``by``, null being a group. Null and negative sizes count as 0; items that tie
    in the order go by size. An empty table gives an empty table; an item column named ``shard`` is replaced.
    """
    if limit < 0:
        raise ValueError("the limit must not be negative")
    columns = [c for c in items.columns if c != "shard"]
    key = list(dict.fromkeys([by, *order, size]))
    if "shard" in key:
        raise ValueError("the order must not use a column named shard")
    amount = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).cast("long")
    placed = dealt(items.select(*columns), key, block_rows, "__block").withColumn("__size", amount)
    within = Window.partitionBy("__block").orderBy(*key)
    narrow = written(placed.select(
        F.col("__block").cast("long").alias("block"), (F.row_number().over(within) - 1).cast("long").alias("idx"), F.col("__size").alias("size"),
        (~F.lag(F.struct(by)).over(within).eqNullSafe(F.struct(by))).alias("new"), F.struct(F.col(by).alias("by")).alias("by"),
    ), "packing")
    summary = narrow.groupBy("block").agg(F.sum("size").alias("total"), F.max_by("size", "idx").alias("last"), F.min("by").alias("low"), F.max("by").alias("high"))
    blocks = _Blocks(sorted(summary.collect(), key=lambda r: r["block"]), limit)  # a row per block
    opened: dict[int, tuple[int, int]] = {}  # block: (number of the shard open at its start, what it holds)
    if blocks.continued.any():
        exits = written(_exits(narrow, blocks), "exits")
        edges = written(_edges(narrow, exits, blocks), "edges")
        reached = _reached(exits, edges, ceil(log2(blocks.longest)))
        found = {r["exit"] // _ROWS: (r["n"], r["before"]) for r in reached.join(exits.select("exit", "before"), "exit").collect()}  # one a block at most
        release(exits, edges, *reached.older)
        carried = None
        for at, number in enumerate(blocks.number.tolist()):
            if blocks.continued[at]:
                opened[number] = (carried[0], int(blocks.base[at]) - carried[1])
            carried = found.get(number, carried)
    release(narrow)
    names = [*columns, "__block", "__size"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, group, shard, held = None, None, 0, 0
        for batch in batches:
            out = []
            for b, g, n in zip(batch["__block"].to_pylist(), batch[by].to_pylist(), batch["__size"].to_pylist(), strict=True):
                if b != block:
                    shard, held = opened.get(b, (0, 0))
                elif g != group:
                    shard, held = 0, 0
                block, group = b, g
                if held > 0 and held + n > limit:
                    shard, held = shard + 1, 0
                held += n
                out.append(shard)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(out, pa.int64())], [*columns, "shard"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields if f.name in columns)
    rows = placed.select(*[F.col(f"`{c}`") for c in names]).repartition("__block").sortWithinPartitions("__block", *key)
    return rows.mapInArrow(fold, f"{schema}, shard long")
