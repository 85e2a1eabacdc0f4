"""Scalar helpers, composed stages and repeated streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import border_weight, keyed_hash
from ..functions.scalar import crop_box, is_out_of_memory, prefetch_for
from ..operators import stages
from ..sources import sinks, tar
from ..sources.scratch import scratch
from ..sources.views import frames, pixels, rasters, table, with_views
from ..streaming import clips
from .registry import h, query, rounded
from .sources import _MEMBERS, _shards
from .streams import _SCHEMA


@query(f"{with_views('frames')} SELECT scene, frame_idx, round(1.0 / greatest(depth / 1000, 1e-4), 6) AS inverse FROM frames")
def reciprocal_with_floor(spark, sf_dir):
    """Inverse depth, the depth being at least 1e-4."""
    return frames(spark, sf_dir).select("scene", "frame_idx", F.round(1.0 / F.greatest(F.col("depth") / 1000, F.lit(1e-4)), 6).alias("inverse"))


@query(f"{with_views('pixels')} SELECT scene, frame, y, x, round(least(1.0, least(x + 1, 8 - x, y + 1, 8 - y) / 3.0), 6) AS weight FROM pixels")
def border_masks(spark, sf_dir):
    """Blending masks: the distance to the border over its width, 1 inside."""
    return rounded(pixels(spark, sf_dir).select("scene", "frame", "y", "x", border_weight(F.col("y"), F.col("x"), 8, 8, 3).alias("weight")))


@query(f"{with_views('pixels')} SELECT scene, frame, x AS y, y AS x, round(v, 6) AS v, round((v + v * 2 + v * 3) / 3, 6) AS grey FROM pixels")
def axes_and_channels(spark, sf_dir):
    """Axes exchanged, a channel repeated with gains, and the mean over channels, on arrays."""
    r = rasters(spark, sf_dir)
    turned = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("values", (i % 8) * 8 + F.floor(i / 8).cast("int")))
    channels = F.transform("values", lambda v: F.array(v, v * 2, v * 3))
    grey = F.transform(channels, lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / 3)
    turned_grey = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("grey", (i % 8) * 8 + F.floor(i / 8).cast("int")))
    both = r.withColumn("grey", grey).select("scene", "frame", F.posexplode(F.arrays_zip(turned.alias("v"), turned_grey.alias("g"))).alias("pos", "z"))
    return rounded(both.select("scene", "frame", F.floor(F.col("pos") / 8).cast("long").alias("y"), (F.col("pos") % 8).cast("long").alias("x"), F.col("z.v").alias("v"), F.col("z.g").alias("grey")))


@query("""SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 16 ELSE greatest(1, least(16, 256 // ((p_size % 9) * greatest(1, p_partkey % 40)))) END::BIGINT AS prefetch, (1000 * (1 + p_size % 8))::BIGINT AS n_samples FROM part""")
def loader_limits(spark, sf_dir):
    """Prefetch kept within a budget of samples over all workers, and samples of an epoch over all ranks."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", prefetch_for(F.col("p_partkey") % 40, F.col("p_size") % 9, 16).cast("long").alias("prefetch"), (1000 * (1 + F.col("p_size") % 8)).cast("long").alias("n_samples"))


@query("""SELECT event_id, event_id % 5 IN (0, 1, 2) AS out_of_memory FROM events""")
def memory_errors(spark, sf_dir):
    """Messages of an allocator that ran dry, in its several wordings."""
    wordings = F.array(*map(F.lit, ["CUDA Out Of Memory. Tried", "DefaultCPUAllocator: can't allocate memory", "there is not enough memory here", "index out of range", ""]))
    return table(spark, sf_dir, "events").select("event_id", is_out_of_memory(F.get(wordings, (F.col("event_id") % 5).cast("int"))).alias("out_of_memory"))


@query("""SELECT p_partkey, CASE upper(['nearest', 'Bilinear', 'BICUBIC', 'lanczos', 'area'][p_size % 5 + 1]) WHEN 'NEAREST' THEN 0 WHEN 'BILINEAR' THEN 1 WHEN 'BICUBIC' THEN 2 WHEN 'LANCZOS' THEN 4 END AS code FROM part""")
def interpolation_names(spark, sf_dir):
    """Codes of interpolation modes by name, null for unknown ones."""
    codes = F.create_map(*[F.lit(x) for pair in {"NEAREST": 0, "BILINEAR": 1, "BICUBIC": 2, "LANCZOS": 4}.items() for x in pair])
    names = F.array(*map(F.lit, ["nearest", "Bilinear", "BICUBIC", "lanczos", "area"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.try_element_at(codes, F.upper(F.get(names, (F.col("p_size") % 5).cast("int")))).alias("code"))


@query("""WITH b AS (SELECT p_partkey, CAST(p_size + 20 AS BIGINT) AS hh, CAST(p_partkey % 97 + 20 AS BIGINT) AS ww FROM part), c AS (SELECT *, hh * 64 < ww * 48 AS wide, CAST(floor(hh / 48.0::DOUBLE * 64) AS BIGINT) AS cw, CAST(floor(ww / 64.0::DOUBLE * 48) AS BIGINT) AS ch FROM b)
SELECT p_partkey, CASE WHEN wide THEN 0 ELSE (hh - ch) // 2 END AS top, CASE WHEN wide THEN (ww - cw) // 2 ELSE 0 END AS "left", CASE WHEN wide THEN hh ELSE ch END AS height, CASE WHEN wide THEN cw ELSE ww END AS width FROM c""")
def centre_crops(spark, sf_dir):
    """The centred box of an image that has the target's shape, 48 x 64."""
    hh, ww = (F.col("p_size") + 20).cast("long"), (F.col("p_partkey") % 97 + 20).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(crop_box(hh, ww, 48, 64))))


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN round(value, 6) END AS x, CASE WHEN event_id % 4 = 1 THEN 'cam_' || user_id END AS name, CASE WHEN event_id % 4 <> 0 THEN round(value / 10, 6) END AS focal_length FROM events""")
def camera_structs(spark, sf_dir):
    """Camera metadata from JSON in which any field may be missing."""
    known = F.col("event_id") % 4 != 0
    place = F.when(known, F.struct(F.round("value", 6).alias("x")))
    text = F.to_json(F.struct(F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("cam_"), F.col("user_id").cast("string"))).alias("camera_name"), place.alias("position"), F.when(known, F.round(F.col("value") / 10, 6)).alias("focal_length")))
    schema = "camera_name string, position struct<x:double,y:double,z:double>, rotation struct<pitch:double,yaw:double,roll:double>, focal_length double, fov double, sensor_width double"
    read = table(spark, sf_dir, "events").select("event_id", F.from_json(text, schema).alias("c"))
    return read.select("event_id", F.col("c.position.x").alias("x"), F.col("c.camera_name").alias("name"), F.col("c.focal_length").alias("focal_length"))


@query("""WITH n AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), u AS (SELECT *, greatest(sqrt(x * x + y * y + z * z), 1e-12) AS l FROM n)
SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE CAST(floor((x / l + 1) * 0.5 * 255) AS BIGINT) END AS red, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE CAST(floor((y / l + 1) * 0.5 * 255) AS BIGINT) END AS green, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE CAST(floor((z / l + 1) * 0.5 * 255) AS BIGINT) END AS blue FROM u""")
def normal_colours(spark, sf_dir):
    """Surface normals as three bytes, 0 outside the mask."""
    part = lambda k: F.col("embedding")[k].cast("double")
    length = F.greatest(F.sqrt(part(0) * part(0) + part(1) * part(1) + part(2) * part(2)), F.lit(1e-12))
    byte = lambda k: F.when(F.col("vec_id") % 5 == 0, F.lit(0).cast("long")).otherwise(F.floor((part(k) / length + 1) * 0.5 * 255).cast("long"))
    return table(spark, sf_dir, "embeddings").select("vec_id", byte(0).alias("red"), byte(1).alias("green"), byte(2).alias("blue"))


@query(f"SELECT event_id, {h('event_id', chr(39) + 'uniform' + chr(39))} % 4 AS dataset FROM events")
def uniform_mixture(spark, sf_dir):
    """Draws from four datasets alike; a read that fails is tried again as a task."""
    return table(spark, sf_dir, "events").select("event_id", F.pmod(keyed_hash("event_id", F.lit("uniform")), F.lit(4)).alias("dataset"))


@query(f"{with_views('frames')} SELECT scene, frame_idx, round(depth * 2 + 1, 6) AS depth, round(k / 2, 6) AS half, CASE WHEN depth > 250 THEN 'far' ELSE 'near' END AS band FROM frames WHERE NOT err")
def declared_stages(spark, sf_dir):
    """Stages that declare what they read and add, a transform of columns, a fold of functions, and a source picked by name."""
    sources = stages.Registry()
    sources.add("frames")(frames)
    double = stages.instantiate({"target": "frameloom.operators.stages.on_columns", "params": {"targets": ["depth"]}}, f=lambda c: c * 2)
    chain = [
        stages.Stage("valid", ("err",), (), lambda d: d.where("NOT err")),
        stages.Stage("band", ("depth",), ("band",), lambda d: d.withColumn("band", F.when(F.col("depth") > 250, "far").otherwise("near"))),
        stages.Stage("scaled", ("depth", "k"), ("half",), lambda d: stages.apply_all(d, [double, stages.on_columns(["depth"], lambda c: c + 1), lambda x: x.withColumn("half", F.col("k") / 2)])),
    ]
    return rounded(stages.run_stages(sources.build("frames", spark, sf_dir), chain).select("scene", "frame_idx", "depth", "half", "band"))


@query("SELECT event_id, epoch FROM events, (SELECT unnest(range(3)) AS epoch)")
def stream_epochs(spark, sf_dir):
    """A stream of a folder's files, drained once for each epoch."""
    out = scratch(spark, "epochs")
    for epoch in range(3):
        stream = clips.read_stream(spark, f"{sf_dir}/events.parquet*", _SCHEMA).select("event_id", F.lit(epoch).cast("long").alias("epoch"))
        clips.run_once(stream, f"{out}/checkpoint{epoch}", f"{out}/table{epoch}")
    return spark.read.schema("event_id bigint, epoch bigint").parquet(*[f"{out}/table{epoch}" for epoch in range(3)])


@query(_MEMBERS)
def tar_member_cache(spark, sf_dir):
    """Members of tar shards in random order, through a bounded cache of the shards used last."""
    _, index = _shards(spark, sf_dir)
    shuffled = index.repartition(4, F.xxhash64("member_name"))
    return tar.read_cached(shuffled).select("member_name", F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"))


@query("SELECT 'part-' || p_size AS name, count(*) AS n_lines FROM part WHERE p_size % 2 = 0 GROUP BY p_size")
def filtered_copy(spark, sf_dir):
    """Files copied as they are, those of a filter only."""
    out = scratch(spark, "copy")
    table(spark, sf_dir, "part").select("p_size", F.col("p_name").alias("value")).repartition("p_size").write.partitionBy("p_size").text(f"{out}/in")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{out}/in").select("path")
    size = F.regexp_extract("path", r"p_size=(\d+)", 1).cast("int")
    copied = sinks.copy_files(files.where(size % 2 == 0).select("path", F.concat(F.lit(f"{out}/to/part-"), size.cast("string"), F.lit(".txt")).alias("target")))
    copied.write.json(f"{out}/log")  # a line for each file
    log = spark.read.schema("target string, size bigint").json(f"{out}/log").where("size > 0").select(F.regexp_extract("target", r"([^/]+)\.txt$", 1).alias("name"))
    lines = spark.read.text(f"{out}/to").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("name"))
    return lines.groupBy("name").agg(F.count("*").alias("n_lines")).join(log, "name")
