"""Connected components of a link table, on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, release


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a partition's links by stars to the smallest node of each of its components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> Iterator[pa.RecordBatch]:
        rows = [(x, r) for x in parent if (r := find(x)) != x]
        for i in range(0, len(rows), 50_000):
            a, b = zip(*rows[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 1_000_000:  # bounded memory: a forest of part of the links is as good
            yield from stars()
            parent.clear()
    yield from stars()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with a link; root: the smallest node of its component.

    Each partition is first reduced to a forest; then large-star and small-star steps alternate until
    nothing changes, each written to the shared folder, so lineage stays short. The joins are sort-merge joins,
    so the adaptive plan splits the rows of a hub, and the least neighbours are combined before they move.

    Defined results: a link with a null end is no link; links to oneself and repeated ones change nothing; no
    links give an empty table; ties do not occur, as nodes are distinct numbers. Other columns are not read.
    """
    ends = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    edges = ends.mapInArrow(_forest, "u long, v long")
    edges = materialize(edges.where("u <> v").distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges, old = materialize(small.where("u <> v").distinct(), "edges"), edges
        release(old)
