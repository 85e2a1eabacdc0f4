"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents stand on a line in the order of a seeded hash; the line is cut into blocks of
equal length. A target of r times the source draws every block floor(r) times and the line's first
part once more, cut at the exact word. The source's block draws are the colours of an urn: a binary
tree over the output shards splits the urn recursively, each node's left side by a multivariate
hypergeometric draw, so quotas stay exact. Each shard then takes the next blocks of each source's
permuted draws (disjoint by construction), and rows get a hash for the local shuffle in their shard. Quotas are exact
in blocks; in words, up to the last block of the partial draw, which is cut, and the row at the cut, which is whole.

Targets: weights share 100 % of all words; a target stops at ``cap`` times its source and the excess
is shared anew by weight until none is above.

Defined results: a null text has size 0; a null source is a source of its own, last in order; null
ids and repeated rows are kept, ties in text-hash order; rows of one id and text in several sources are drawn
for each by its own target; sources without words get target 0; an empty table gives an empty table.
`plan_mix` neither reads nor returns extra columns; `deal` and `mix` carry them, whatever their names and types.
"""

from __future__ import annotations

from itertools import cycle

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a shard, and how many shards there are at most, as the driver holds a quota for each of them and source.
SHARD_WORDS, MAX_SHARDS = 1 << 21, 1 << 17


def mix_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> dict[str | None, float]:
    """Target words of each source, by water-filling: weights repeat over the sources in code-point order, null last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = dict(zip(order, cycle(weights), strict=False))
    rest, heft, capped = sum(sizes.values()), sum(weight.values()), set()
    for s in sorted(order, key=lambda s: (cap * sizes[s] / weight[s], order.index(s))):
        if not cap * sizes[s] * heft < weight[s] * rest:
            break
        capped.add(s)
        rest -= cap * sizes[s]
        heft -= weight[s]
    return {s: float(cap * sizes[s]) if s in capped else weight[s] * rest / heft for s in order}


def split_draws(draws: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """A row per shard of how many of each source's block draws it gets; columns sum to draws."""
    out = np.zeros((shards, len(draws)), np.int64)

    def split(low: int, high: int, urn: np.ndarray) -> None:
        if high - low == 1:
            out[low] = urn
            return
        mid = (low + high) // 2
        total = int(urn.sum())
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        left = rng.multivariate_hypergeometric(urn, total * (mid - low) // (high - low), method="marginals")
        split(low, mid, left)
        split(mid, high, urn - left)

    split(0, shards, np.asarray(draws, np.int64))
    return out


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(id_col: str, text_col: str, seed: int) -> Column:
    """The hash that orders a source's line."""
    identity, text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), identity, F.md5(text.cast("binary"))).cast("binary"))


def line_key(key: Column, source: Column) -> Column:
    """The key of a row among those of all sources."""
    return F.md5(F.concat_ws("|", key, source.isNull().cast("string"), source).cast("binary"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, shards: int | None = None, seed: int = 0, block_words: int = 65_536, max_blocks: int = 1 << 18) -> DataFrame:
    """(id, source, size, source_size, target, key, draws) of every row; draws: array<struct<pass,shard,place>>, one for each time it is taken.

    Only ids, sources, sizes and hashes move. The running sum over a source's line is the sum over its
    hash buckets before (a row per source and bucket) plus a window within the bucket, so a hot
    source is spread over many tasks. The driver holds a row per source and per block; blocks grow
    with the input, so that there are at most max_blocks and one for each source. Shards, where their number
    is not given, hold about SHARD_WORDS words each, more where there would be over MAX_SHARDS of them.
    """
    return _planned(docs, id_col, text_col, source_col, weights, cap, shards, seed, block_words, max_blocks)[0].drop("line")


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], cap: int, shards: int | None, seed: int, block_words: int, max_blocks: int) -> tuple[DataFrame, int]:
    """(plan_mix with the key of the row within its source, number of shards)."""
    spark = docs.sparkSession
    source = F.col(f"`{source_col}`").cast("string")
    key = row_key(id_col, text_col, seed)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), source.alias("source"), words(F.col(f"`{text_col}`")).alias("size"), key.alias("key"), line_key(key, source).alias("line"))
    rows = materialize(rows.withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")), "mix")  # sizes and hashes are needed three times; the texts are read once
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket")  # a row per bucket
    buckets = buckets.select("source", "bucket", (F.sum("words").over(before) - F.col("words")).alias("before"))
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    targets = mix_targets(sizes, weights, cap) if sizes else {}
    total = sum(sizes.values())
    shards = shards or min(MAX_SHARDS, max(1, -(-total // SHARD_WORDS)))
    length = max(block_words, -(-total // max_blocks))
    order = list(targets)
    n_blocks = {s: max(1, -(-sizes[s] // length)) for s in order}
    whole = {s: int(targets[s] // sizes[s]) if sizes[s] else 0 for s in order}
    part = {s: (targets[s] - whole[s] * sizes[s]) / sizes[s] if sizes[s] else 0.0 for s in order}
    drawn = {s: whole[s] * n_blocks[s] + int(np.ceil(part[s] * n_blocks[s])) for s in order}
    quotas = split_draws(np.array([drawn[s] for s in order], np.int64), shards, seed) if order else np.zeros((shards, 0), np.int64)
    plan = []
    for k, s in enumerate(order):
        deal = np.empty(drawn[s], np.int64)
        deal[np.random.Generator(np.random.PCG64([seed, 1, k])).permutation(drawn[s])] = np.repeat(np.arange(shards), quotas[:, k])
        for block in range(n_blocks[s]):
            plan.append((s, block, sizes[s], targets[s], n_blocks[s], part[s] * sizes[s], [(p, int(deal[p * n_blocks[s] + block])) for p in range(whole[s] + 1) if p * n_blocks[s] + block < drawn[s]], whole[s]))
    schema = "s string, block int, source_size long, target double, n_blocks int, cut double, deal array<struct<pass:int,shard:int>>, whole int"
    blocks = spark.createDataFrame(plan, schema)
    per_source = blocks.where("block = 0").select("s", "source_size", "target", "n_blocks", "cut", "whole")
    placed = rows.join(buckets.withColumnsRenamed({"source": "b_source", "bucket": "b_bucket"}), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    within = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("middle", F.col("before") + F.sum("size").over(within) - F.col("size") / 2).join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("middle") * F.col("n_blocks") / F.greatest("source_size", F.lit(1))), F.col("n_blocks") - 1)).otherwise(0).cast("int")
    dealt = placed.withColumn("at", at).join(blocks.select("s", "block", "deal"), F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("block")))
    taken = F.filter("deal", lambda d: (d["pass"] < F.col("whole")) | (F.col("middle") < F.col("cut")))
    draws = F.transform(taken, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64("key", d["pass"], d["shard"], F.lit(seed)).alias("place")))
    out = dealt.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "key", "line", draws.alias("draws"))
    return out, shards


def manifest(plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(shard, slot, place, pass, key, id, size) of what the tree deals: a row for each draw of a row of plan_mix, slots from 0 in each shard.

    Slots follow the local shuffle; only these narrow columns move. A shard holds about SHARD_WORDS words.
    """
    drawn = plan.select("key", F.col(id_col), "source", "size", "number", F.inline("draws"))
    order = Window.partitionBy("shard").orderBy("place", "key", "number", "pass")
    return drawn.withColumn("slot", (F.row_number().over(order) - 1).cast("long"))


def taken_words(plan: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """plan_mix with ``taken``: the words that shards hold of each row, added up from the manifest."""
    same = Window.partitionBy("key", source_col).orderBy(F.xxhash64("draws"))  # rows of one id, text and source
    numbered = materialize(plan.withColumn("number", F.row_number().over(same)), "plan")
    dealt = manifest(numbered.withColumnRenamed(source_col, "source"), id_col)
    held = dealt.groupBy("key", "source", "number").agg(F.sum("size").alias("taken"), F.count("*").alias("n_slots")).withColumnsRenamed({"key": "k", "source": "s", "number": "m"})
    joined = numbered.join(held, (F.col("key") == F.col("k")) & F.col(source_col).eqNullSafe(F.col("s")) & (F.col("number") == F.col("m")), "left")
    return joined.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).drop("k", "s", "m", "number")


def deal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, shards: int | None = None, seed: int = 0, block_words: int = 65_536, max_blocks: int = 1 << 18) -> tuple[DataFrame, int]:
    """((row, draw) of each draw, number of shards); row: struct of all columns of docs, draw: struct<pass,shard,place>.

    Draws are decided on narrow rows; the texts move once to meet them. Rows with one key and source are told
    apart by number, of docs in the order of the JSON of their other columns.
    """
    plan, shards = _planned(docs, id_col, text_col, source_col, weights, cap, shards, seed, block_words, max_blocks)
    draws = plan.where(F.size("draws") > 0).select(F.col("line").alias("drawn"), "draws")
    draws = draws.withColumn("number", F.row_number().over(Window.partitionBy("drawn").orderBy(F.xxhash64("draws"))))
    # rows move whole in one column, so no name of theirs can clash
    whole = docs.select(line_key(row_key(id_col, text_col, seed), F.col(f"`{source_col}`").cast("string")).alias("line"), F.struct("*").alias("row"))
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in (id_col, text_col, source_col)]
    same = Window.partitionBy("line").orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    whole = whole.withColumn("place", F.row_number().over(same))
    # a difference, not an equality, so that the join keeps the windows' partitioning
    drawn = whole.join(draws, (F.col("line") == F.col("drawn")) & (F.col("place") - F.col("number") == 0))
    return drawn.select("row", F.explode("draws").alias("draw")), shards


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, shards: int | None = None, **options) -> DataFrame:
    """The mixture itself: rows of docs, once for each draw; a partition for each shard, shuffled within it."""
    drawn, shards = deal(docs, id_col, text_col, source_col, seed=seed, shards=shards, **options)
    return drawn.repartitionById(shards, F.col("draw.shard")).sortWithinPartitions("draw.place").select("row.*")
