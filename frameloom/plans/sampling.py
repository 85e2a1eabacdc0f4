"""Sampling, splitting and packing queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fmod_key, keyed_hash
from ..operators import sampling
from ..operators.ordering import numbered
from ..sources.views import frames, table, with_views
from .registry import h, query

_LENGTHS = f"""{with_views("frames")}, lengths AS (SELECT scene, count(*) AS n FROM frames GROUP BY scene)"""


def _lengths(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("scene").agg(F.count("*").alias("n"))


def _joined(df):
    return df.select("scene", "n", F.array_join(F.transform("clip", lambda x: x.cast("string")), ",").alias("clip"))


@query(f"""{_LENGTHS}, s AS (SELECT scene, n, {h("scene", "7", "'start'")} % (n - 1 - 7 * 3 + 1) AS start FROM lengths WHERE n - 1 - 7 * 3 >= 0),
p AS (SELECT scene, n, start, unnest(range(8)) AS i FROM s), q AS (SELECT scene, n, i, start + coalesce(sum(CASE WHEN i > 0 THEN 1 + {h("scene", "7", "i")} % 2 ELSE 0 END) OVER (PARTITION BY scene ORDER BY i), 0) AS place FROM p)
SELECT scene, n, string_agg(CAST(place AS BIGINT)::VARCHAR, ',' ORDER BY i) AS clip FROM q GROUP BY scene, n""")
def strided_clips_hash(spark, sf_dir):
    """Clips of 8 frames with strides 1 or 2 (the upper bound is excluded)."""
    return _joined(sampling.strided_clips(_lengths(spark, sf_dir), "scene", "n", 8, 1, 3, seed=7))


@query(f"""{_LENGTHS.replace("WITH ", "WITH RECURSIVE ", 1)}, c AS (SELECT scene, n, 0 AS f, {h("scene", "3", "'start'")} % (n - 2 * 6 + 1) AS place FROM lengths WHERE n >= 12
UNION ALL SELECT scene, n, f + 1, least(place + 2 + {h("scene", "3", "f")} % 19, n - 2 * (6 - f)) FROM c WHERE f < 5)
SELECT scene, n, string_agg(CAST(place AS BIGINT)::VARCHAR, ',' ORDER BY f) AS clip FROM c GROUP BY scene, n""")
def clamped_clip_sampler(spark, sf_dir):
    """Clips of 6 frames with strides of 2 to 20, each position held back so that the rest fits."""
    return _joined(sampling.clamped_clips(_lengths(spark, sf_dir), "scene", "n", 6, 2, 20, seed=3))


@query(f"""WITH r AS (SELECT conv_id, row_number() OVER (ORDER BY {h("conv_id")}, conv_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, CASE WHEN r <= floor(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM r""")
def shot_train_val_split(spark, sf_dir):
    """A fifth of the shots, by hash, for validation."""
    return sampling.train_val_split(table(spark, sf_dir, "conversations").select("conv_id").distinct(), "conv_id", 0.2)


@query(f"""WITH d AS (SELECT event_id, {h("event_id", "'mix'")} / 4294967296.0 * 60 AS u FROM events) SELECT event_id, CAST(CASE WHEN u < 9 THEN 0 WHEN u < 10 THEN 1 WHEN u < 50 THEN 2 ELSE 3 END AS BIGINT) AS dataset FROM d""")
def weighted_mixture(spark, sf_dir):
    """Draws from four datasets with weights 9, 1, 40, 10."""
    return table(spark, sf_dir, "events").select("event_id", sampling.weighted_choice([9, 1, 40, 10], "event_id", F.lit("mix")).alias("dataset"))


@query("""WITH r AS (SELECT source, (row_number() OVER (ORDER BY source) - 1) % 3 AS rank FROM (SELECT DISTINCT source FROM documents)) SELECT source, rank FROM r""")
def rank_shard_split(spark, sf_dir):
    """Shards dealt to 3 ranks in turn."""
    shards = table(spark, sf_dir, "documents").select("source").distinct()
    return numbered(shards, ["source"], "place").select("source", ((F.col("place") - 1) % 3).alias("rank"))


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
p AS (SELECT source, doc_id, i, 0 AS shard, n_chars AS held FROM o WHERE i = 1
UNION ALL SELECT o.source, o.doc_id, o.i, CASE WHEN held > 0 AND held + n_chars > 20000 THEN shard + 1 ELSE shard END, CASE WHEN held > 0 AND held + n_chars > 20000 THEN n_chars ELSE held + n_chars END FROM p JOIN o ON o.source = p.source AND o.i = p.i + 1)
SELECT source, doc_id, CAST(shard AS BIGINT) AS shard FROM p""")
def greedy_shard_packing(spark, sf_dir):
    """Sequences packed in order into shards of at most 20,000 characters."""
    return sampling.pack(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 20_000).select("source", "doc_id", "shard")


@query(f"""{_LENGTHS} SELECT CAST(least(9, floor((min(n) - 1) / 15)) AS BIGINT) AS stride, min(n) AS shortest FROM lengths""")
def stride_clamp(spark, sf_dir):
    """The largest stride up to 9 at which the shortest scene still gives a clip of 16."""
    return _lengths(spark, sf_dir).agg(sampling.stride_limit(F.min("n"), 16, 9).cast("long").alias("stride"), F.min("n").alias("shortest"))


@query(f"""{_LENGTHS}, g AS (SELECT scene, n, s, k FROM lengths, (SELECT unnest(range(1, 4)) AS s), (SELECT unnest(range(5, 30, 4)) AS k)), f AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY {h("scene", "s", "k")}, s, k) AS r FROM g WHERE (k - 1) * s + 1 <= n)
SELECT scene, s AS stride, k AS n_frames FROM f WHERE r = 1""")
def feasible_sampler(spark, sf_dir):
    """A feasible (stride, number of frames of the form 4n + 1) per scene, chosen by hash."""
    grid = _lengths(spark, sf_dir).withColumn("stride", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")))).withColumn("n_frames", F.explode(F.sequence(F.lit(5).cast("long"), F.lit(29).cast("long"), F.lit(4).cast("long"))))
    fits = grid.where((F.col("n_frames") - 1) * F.col("stride") + 1 <= F.col("n"))
    order = Window.partitionBy("scene").orderBy(keyed_hash("scene", "stride", "n_frames"), "stride", "n_frames")
    return fits.withColumn("r", F.row_number().over(order)).where("r = 1").select("scene", "stride", "n_frames")


@query(f"""SELECT DISTINCT source, CASE {h("source")} % 2 WHEN 0 THEN 'left' ELSE 'right' END AS side FROM documents""")
def keyed_side(spark, sf_dir):
    """A stable left or right side per shot name."""
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", F.when(fmod_key(F.col("source"), 2) == 0, "left").otherwise("right").alias("side"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE r <= floor(n * 0.3)""")
def train_ratio_prefix(spark, sf_dir):
    """The first 30 % of the sorted list."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    keep = d.agg(F.floor(F.count("*") * 0.3).alias("keep"))
    return numbered(d, ["source", "doc_id"], "r").crossJoin(F.broadcast(keep)).where("r <= keep").select("doc_id")  # one row


@query("""SELECT item_id, epoch FROM benchmark, (SELECT unnest(range(3)) AS epoch)""")
def replicated_epochs(spark, sf_dir):
    """A list repeated for three epochs."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("epoch"))
