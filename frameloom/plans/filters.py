"""Filters, lookups, set operations over datasets, and remaining scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keyed_hash, rgb_normalise, safe_div
from ..functions.depth import denormalise, quantile_normalise
from ..operators.joins import anti
from ..operators.ordering import numbered
from ..sources.views import frames, pixels, rasters, table, with_views
from .registry import h, query, rounded


@query("SELECT vec_id FROM embeddings WHERE NOT (vec_id % 6 = 0) AND list_max(embedding) < 0.4")
def finite_samples(spark, sf_dir):
    """Samples without NaN and below a limit; every sixth one gets a NaN here."""
    spoiled = F.when(F.col("vec_id") % 6 == 0, F.concat("embedding", F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", spoiled.alias("values"))
    return rows.where(~F.exists("values", F.isnan)).where(F.array_max("values") < 0.4).select("vec_id")


@query("""SELECT source FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source HAVING count(*) FILTER (WHERE l.doc_id IS NULL OR n_chars < 50) > 0""")
def resume_worklist(spark, sf_dir):
    """Scenes with an artefact missing or invalid, to be done again; complete ones are left out."""
    done = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("ok", F.lit(True)), "doc_id", "left")
    complete = done.groupBy("source").agg(F.bool_and(F.coalesce("ok", F.lit(False)) & (F.col("n_chars") >= 50)).alias("complete")).where("complete")
    return anti(done.select("source").distinct(), complete, ["source"])


@query("""SELECT source, arg_max(name, step) AS latest FROM (SELECT source, 'step_' || n_chars || '.ckpt' AS name, CAST(n_chars AS BIGINT) * 100000 + doc_id AS step FROM documents) GROUP BY source""")
def latest_checkpoint(spark, sf_dir):
    """The checkpoint with the greatest step in natural order."""
    named = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("step_"), F.col("n_chars").cast("string"), F.lit(".ckpt")).alias("name"), (F.col("n_chars") * 100000 + F.col("doc_id")).alias("step"))
    return named.groupBy("source").agg(F.max_by("name", "step").alias("latest"))


@query("SELECT p_brand, max(p_size) FILTER (WHERE p_size * p_size * 3 <= 2000) AS largest FROM part GROUP BY p_brand")
def largest_that_fits(spark, sf_dir):
    """The greatest size within a budget, as a set instead of a search."""
    fits = F.col("p_size") * F.col("p_size") * 3 <= 2000
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max(F.when(fits, F.col("p_size"))).alias("largest"))


@query("""WITH u AS (SELECT 0 AS part, c_custkey AS key FROM customer UNION ALL SELECT 1, s_suppkey FROM supplier), i AS (SELECT part, key, row_number() OVER (ORDER BY part, key) - 1 AS idx FROM u)
SELECT CAST(part AS BIGINT) AS part, key, idx, row_number() OVER (ORDER BY idx) - 1 AS sub_idx FROM i WHERE idx % 3 = 0""")
def concat_and_subset(spark, sf_dir):
    """Datasets concatenated under a global index, and a subset of it numbered anew."""
    side = lambda name, key, part: table(spark, sf_dir, name).select(F.lit(part).cast("long").alias("part"), F.col(key).alias("key"))
    both = side("customer", "c_custkey", 0).unionByName(side("supplier", "s_suppkey", 1))
    indexed = numbered(both, ["part", "key"], "place").select("part", "key", (F.col("place") - 1).alias("idx"))
    # every third row of a numbering from 0 is numbered by its own place
    return indexed.where("idx % 3 = 0").withColumn("sub_idx", F.floor(F.col("idx") / 3).cast("long"))


@query(f"""SELECT doc_id, {h("doc_id")} % 12 // 4 AS rank, {h("doc_id")} % 12 % 4 AS worker FROM documents""")
def worker_partition(spark, sf_dir):
    """Rows dealt to 3 ranks of 4 workers by hash, without a global order."""
    slot = keyed_hash("doc_id") % 12
    return table(spark, sf_dir, "documents").select("doc_id", F.floor(slot / 4).cast("long").alias("rank"), (slot % 4).cast("long").alias("worker"))


@query(f"""SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {h("doc_id", "'epoch1'")}, doc_id) AS place FROM documents""")
def shard_shuffle(spark, sf_dir):
    """A seeded shuffle within each shard."""
    order = Window.partitionBy("source").orderBy(keyed_hash("doc_id", F.lit("epoch1")), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(order).cast("long").alias("place"))


@query("""WITH n AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), o AS (SELECT vec_id, CASE WHEN x * 0.2 + y * 0.1 + z > 0 THEN -1 ELSE 1 END AS s, x, y, z FROM n)
SELECT vec_id, round(x * s, 6) AS nx, round(y * s, 6) AS ny, round(z * s, 6) AS nz, CAST(floor(((x * s + 1) * 0.5) * 255) AS BIGINT) AS red FROM o""")
def normal_orientation(spark, sf_dir):
    """Normals turned towards the camera, and their first byte as a colour."""
    x, y, z = (F.col("embedding")[i].cast("double") for i in range(3))
    s = F.when(x * 0.2 + y * 0.1 + z > 0, -1).otherwise(1)
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", (x * s).alias("nx"), (y * s).alias("ny"), (z * s).alias("nz"), F.floor(((x * s + 1) * 0.5) * 255).cast("long").alias("red")))


@query("""SELECT p_partkey, round(degrees(2 * p_size / (p_size * p_size + 1.0) + (exp(-p_size * pi()) * pi()) / (1 + exp(-p_size * pi()))), 6) AS alpha FROM part""")
def kappa_to_alpha(spark, sf_dir):
    """Concentration to expected angular error in degrees."""
    k = F.col("p_size")
    e = F.exp(-k * F.pi())
    return rounded(table(spark, sf_dir, "part").select("p_partkey", F.degrees(2 * k / (k * k + 1.0) + (e * F.pi()) / (1 + e)).alias("alpha")))


@query("""SELECT p_partkey, CAST(round_even(sqrt(480.0 * 640 * (p_size + 20) / (p_size * 2 + 30)) / 64, 0) * 64 AS BIGINT) AS h, CAST(round_even(sqrt(480.0 * 640 / ((p_size + 20.0) / (p_size * 2 + 30))) / 64, 0) * 64 AS BIGINT) AS w FROM part""")
def resize_by_area(spark, sf_dir):
    """Sizes of a given area and aspect, in multiples of 64."""
    h_, w_ = F.col("p_size") + 20, F.col("p_size") * 2 + 30
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", (F.bround(F.sqrt(480.0 * 640 * h_ / w_) / 64) * 64).cast("long").alias("h"), (F.bround(F.sqrt(480.0 * 640 / (h_ * 1.0 / w_)) / 64) * 64).cast("long").alias("w"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey, p_size % 20 + 1 AS t, (p_size * 4.0 + 60) AS lh, (p_size * 6.0 + 80) AS lw FROM part), f AS (SELECT p_partkey, t, CAST(lh / 2 AS DOUBLE) AS h, CAST(lw / 2 AS DOUBLE) AS w, 0 AS i FROM p
UNION ALL SELECT p_partkey, t, h * 0.85::DOUBLE, w * 0.85::DOUBLE, i + 1 FROM f WHERE t * (h / 2) * (w / 2) > 15000 AND h > 4 AND w > 4)
SELECT p_partkey, CAST(greatest(4, CAST(floor(arg_max(h, i)) AS BIGINT) // 2 * 2) AS BIGINT) AS tile_h, CAST(greatest(4, CAST(floor(arg_max(w, i)) AS BIGINT) // 2 * 2) AS BIGINT) AS tile_w FROM f GROUP BY p_partkey""")
def auto_tile_geometry(spark, sf_dir):
    """Half resolution, shrunk by 0.85 until a pass fits the token budget, in even sizes: a bounded fold per row."""
    t = F.col("p_size") % 20 + 1
    start = F.struct(((F.col("p_size") * 4.0 + 60) / 2).alias("h"), ((F.col("p_size") * 6.0 + 80) / 2).alias("w"))

    def shrink(a, _):
        more = (t * (a["h"] / 2) * (a["w"] / 2) > 15000) & (a["h"] > 4) & (a["w"] > 4)
        return F.struct(F.when(more, a["h"] * 0.85).otherwise(a["h"]).alias("h"), F.when(more, a["w"] * 0.85).otherwise(a["w"]).alias("w"))

    fit = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, shrink)
    even = lambda x: F.greatest(F.lit(4), F.floor(F.floor(x) / 2) * 2).cast("long")
    return table(spark, sf_dir, "part").withColumn("fit", fit).select("p_partkey", even(F.col("fit.h")).alias("tile_h"), even(F.col("fit.w")).alias("tile_w"))


@query(f"""{with_views("pixels")} SELECT scene, frame, y - 3 AS y, x - 1 AS x, v FROM pixels WHERE y >= 3 AND x >= 1 AND x < 7""")
def benchmark_crop(spark, sf_dir):
    """The bottom 5 rows and the centred 6 columns, numbered anew."""
    p = pixels(spark, sf_dir).where((F.col("y") >= 8 - 5) & (F.col("x") >= (8 - 6) // 2) & (F.col("x") < (8 - 6) // 2 + 6))
    return p.select("scene", "frame", (F.col("y") - 3).alias("y"), (F.col("x") - 1).alias("x"), "v")


@query("""WITH s AS (SELECT doc_id, doc_id // 2 AS pair, doc_id % 2 AS side FROM documents), d AS (SELECT doc_id FROM labels) SELECT a.doc_id FROM s a JOIN s b ON a.pair = b.pair AND a.side <> b.side WHERE a.doc_id IN (SELECT doc_id FROM d) AND b.doc_id IN (SELECT doc_id FROM d)""")
def valid_stereo_pairs(spark, sf_dir):
    """Frames whose partner exists and that both have depth: semi joins."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).alias("pair"), (F.col("doc_id") % 2).alias("side"))
    there = keyed.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    partner = there.select("pair", (1 - F.col("side")).alias("side"))
    return there.join(partner, ["pair", "side"], "left_semi").select("doc_id")


@query("""WITH e AS (SELECT label, vec_id, embedding AS e, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (CAST(e[i] AS DOUBLE) - n[i]) * (CAST(e[i] AS DOUBLE) - n[i]))) / 64, 6) AS mse FROM e WHERE n IS NOT NULL""")
def latent_mse(spark, sf_dir):
    """Mean squared difference of consecutive latents, on arrays."""
    e = table(spark, sf_dir, "embeddings").withColumn("n", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("n IS NOT NULL")
    d = F.zip_with("embedding", "n", lambda a, b: a.cast("double") - b.cast("double"))
    return rounded(e.select("vec_id", (F.aggregate(d, F.lit(0.0), lambda t, x: t + x * x) / F.size("embedding")).alias("mse")))


@query(f"""{with_views("pixels")} SELECT scene, frame, y, x, CASE WHEN v > 0.12 AND v < 0.3 THEN v ELSE 80.0 END AS filled, CASE WHEN v < 0.2 THEN 0.0 ELSE v END AS composed FROM pixels""")
def far_plane_fill(spark, sf_dir):
    """Invalid pixels set to the far plane, and an image composed with a mask."""
    v = F.col("v")
    return pixels(spark, sf_dir).select("scene", "frame", "y", "x", F.when((v > 0.12) & (v < 0.3), v).otherwise(80.0).alias("filled"), F.when(v < 0.2, 0.0).otherwise(v).alias("composed"))


@query(f"""{with_views("pixels")}, n AS (SELECT a.scene, a.frame, a.y, a.x, a.v, sum(b.v) AS near, count(*) AS k FROM pixels a JOIN pixels b ON b.scene = a.scene AND b.frame = a.frame AND abs(b.y - a.y) + abs(b.x - a.x) = 1 GROUP BY ALL)
SELECT scene, frame, y, x, round(k * v - near, 6) AS laplacian, k AS n_neighbours FROM n""")
def neighbour_laplacian(spark, sf_dir):
    """Each pixel against its four neighbours, by lag and lead."""
    rows, cols = Window.partitionBy("scene", "frame", "y").orderBy("x"), Window.partitionBy("scene", "frame", "x").orderBy("y")
    near = [F.lag("v").over(rows), F.lead("v").over(rows), F.lag("v").over(cols), F.lead("v").over(cols)]
    k = sum((F.when(n.isNotNull(), 1).otherwise(0) for n in near), F.lit(0)).cast("long")
    total = sum((F.coalesce(n, F.lit(0.0)) for n in near), F.lit(0.0))
    return rounded(pixels(spark, sf_dir).select("scene", "frame", "y", "x", (k * F.col("v") - total).alias("laplacian"), k.alias("n_neighbours")))


@query("""SELECT l_orderkey, l_linenumber, round(p_retailprice / nullif(p_size - 10, 0), 6) AS fx_ratio, p_size AS camera FROM lineitem JOIN part ON l_partkey = p_partkey""")
def intrinsics_lookup(spark, sf_dir):
    """Frames joined to their camera's intrinsics; a zero denominator gives null."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_size")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return rounded(lines.join(part, "l_partkey").select("l_orderkey", "l_linenumber", safe_div(F.col("p_retailprice"), F.col("p_size") - 10).alias("fx_ratio"), F.col("p_size").alias("camera")))


@query("""WITH q AS (SELECT CAST(p_partkey % 300 AS DOUBLE) AS x, p_partkey FROM part) SELECT p_partkey, round(greatest(-1.0, least(1.0, x / 127.5 - 1.0)), 6) AS rgb, round(x, 6) AS back FROM q""")
def value_normalisers(spark, sf_dir):
    """Colour bytes to [-1, 1], and a quantile normalisation with its inverse."""
    x = (F.col("p_partkey") % 300).cast("double")
    n = quantile_normalise(x, F.lit(5.0), F.lit(250.0), clip=False)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", rgb_normalise(x).alias("rgb"), denormalise(n, F.lit(5.0), F.lit(250.0)).alias("back")))


@query("""WITH b AS (SELECT i, 0.00085 + i * (0.012 - 0.00085) / 999 AS beta FROM (SELECT unnest(range(1000)) AS i)), a AS (SELECT i AS step, round(exp(sum(ln(1 - beta)) OVER (ORDER BY i)), 9) AS alpha_bar FROM b)
SELECT event_id, event_id % 1000 AS step, alpha_bar FROM events JOIN a ON step = event_id % 1000""")
def noise_schedule(spark, sf_dir):
    """Each event's level in a linear schedule of a thousand steps: cumulative products, as running sums of logarithms."""
    beta = 0.00085 + F.col("id") * (0.012 - 0.00085) / 999
    order = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = spark.range(1000).select(F.col("id").alias("step"), F.round(F.exp(F.sum(F.ln(1 - beta)).over(order)), 9).alias("alpha_bar"))
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1000).alias("step")).join(F.broadcast(levels), "step")  # a thousand rows


@query(f"""{with_views("frames")} SELECT event_type, CAST(round(avg(depth), 6) AS DOUBLE) AS mean, count(*) AS n FROM frames GROUP BY ROLLUP (event_type)""")
def dataset_rollup(spark, sf_dir):
    """Means by dataset and overall in one pass."""
    return rounded(frames(spark, sf_dir).rollup("event_type").agg(F.avg("depth").alias("mean"), F.count("*").alias("n")))


@query("SELECT CAST(label AS BIGINT) AS scene, count(*) AS n_frames, count(*) % 4 AS remainder FROM embeddings GROUP BY label HAVING count(*) >= 1 + 15 * 2")
def long_enough_scenes(spark, sf_dir):
    """Scenes that hold a clip of 16 frames at stride 2."""
    n = rasters(spark, sf_dir).groupBy("scene").agg(F.count("*").alias("n_frames"))
    return n.where(F.col("n_frames") >= 1 + 15 * 2).withColumn("remainder", (F.col("n_frames") % 4).cast("long"))
