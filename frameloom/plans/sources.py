"""Queries through the source and sink layer: each writes files in the shared folder and reads them back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import sampling, tensors
from ..sources import codecs, images, listing, sinks, tar, tar_source
from ..sources.scratch import release, scratch, written
from ..sources.views import rasters, table
from .codecs import _VALUES, _sql, _through
from .registry import query, rounded


@query(_sql())
def codec_flow_roundtrip(spark, sf_dir):
    """Flow fields through their tagged format and back."""
    return _through(spark, sf_dir, "flo")


@query(f"SELECT vec_id, CAST(1 AS BIGINT) AS h, CAST(21 AS BIGINT) AS w, round(list_sum(vs[1:21]), 4) AS total, round(vs[9], 5) AS second_row FROM ({_VALUES})")
def codec_camera_roundtrip(spark, sf_dir):
    """Camera matrices, 3 x 3 and 3 x 4, through their tagged format and back."""
    return _through(spark, sf_dir, "cam")


@query(f"""WITH r AS (SELECT vec_id, list_transform(vs, lambda v: CASE WHEN v > 0.3 THEN 0.0 ELSE CAST(CAST(v AS FLOAT) AS DOUBLE) END) AS vs FROM ({_VALUES}))
SELECT vec_id, round(list_sum(vs), 4) AS total, len(list_filter(vs, lambda v: v = 0)) AS n_missing FROM r""")
def codec_raw_roundtrip(spark, sf_dir):
    """Bare float blobs, where infinite means missing and is read as 0."""
    r = rasters(spark, sf_dir).select("vec_id", F.transform("values", lambda v: F.when(v > 0.3, float("inf")).otherwise(v)).alias("values"))
    codec = codecs.raw_codec(8, 8)
    back = codecs.decoded(codecs.encoded(r, codec, 8, 8), codec)
    return back.select("vec_id", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size(F.filter("values", lambda v: v == 0)).cast("long").alias("n_missing"))


def _quantised(scale: int, over: int, n: str = "v") -> str:
    return f"""SELECT vec_id, CAST(8 AS BIGINT) AS h, CAST(8 AS BIGINT) AS w, round(list_sum(list_transform(vs, lambda v: floor({n} * {scale} + 0.5) / {over})), 4) AS total, round(floor({n.replace("v", "vs[9]")} * {scale} + 0.5) / {over}, 5) AS second_row FROM ({_VALUES})"""


@query(_quantised(1000, 1000))
def codec_npz_depth(spark, sf_dir):
    """Depth in millimetres from a numpy archive."""
    return _through(spark, sf_dir, "npz")


@query(f"SELECT vec_id, CAST(8 AS BIGINT) AS h, CAST(8 AS BIGINT) AS w, round(list_sum(vs), 4) AS total, round(vs[9], 5) AS second_row FROM ({_VALUES})")
def codec_npy_roundtrip(spark, sf_dir):
    """Raw numpy arrays and back."""
    return _through(spark, sf_dir, "npy")


_CLIP = f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda e: abs(CAST(e AS DOUBLE)) + 0.1) AS vs FROM embeddings), r AS (SELECT {{by}} AS k, min(list_min(vs)) AS lo, max(list_max(vs)) AS hi FROM v GROUP BY k),
q AS (SELECT vec_id, list_transform(vs, lambda x: floor((x - lo) / (hi - lo + 1e-8) * {{top}} + 0.5)) AS ps FROM v JOIN r ON r.k = {{by}})"""


def _normalised(spark, sf_dir, by):
    """Rasters in [0, 1] by the least and greatest value of each clip, or of all."""
    r = rasters(spark, sf_dir).select("vec_id", "scene", "values")
    key = F.col("scene") if by else F.lit(0)
    ends = r.groupBy(key.alias("k")).agg(F.min(F.array_min("values")).alias("lo"), F.max(F.array_max("values")).alias("hi"))
    joined = r.join(ends, key == F.col("k")) if by else r.crossJoin(F.broadcast(ends))  # one row
    return joined.select("vec_id", F.transform("values", lambda x: (x - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8)).alias("values"))


def _image(df, codec):
    back = codecs.decoded(codecs.encoded(df, codec, 8, 8), codec)
    return rounded(back.select("vec_id", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"), F.element_at("values", 9).alias("second_row"), F.array_max("values").alias("top")))


@query(f"WITH {_CLIP.format(by='label', top=255)} SELECT vec_id, round(list_sum(ps), 6) AS total, round(ps[9], 6) AS second_row, round(list_max(ps), 6) AS top FROM q")
def png_clip_dump(spark, sf_dir):
    """8-bit PNG files of each clip, normalised by its own range, and read back."""
    return _image(_normalised(spark, sf_dir, True), "png8")


@query(f"WITH {_CLIP.format(by='0', top=65535)} SELECT vec_id, round(list_sum(ps), 6) AS total, round(ps[9], 6) AS second_row, round(list_max(ps), 6) AS top FROM q")
def png_depth_16bit(spark, sf_dir):
    """16-bit PNG files normalised by the range of all frames, and read back."""
    return _image(_normalised(spark, sf_dir, False), "png16")


@query(f"WITH {_CLIP.format(by='label', top=255)} SELECT vec_id, round(list_sum(ps) / 255, 6) AS total, round(ps[9] / 255, 6) AS second_row, round(list_max(ps) / 255, 6) AS top FROM q")
def image_unit_floats(spark, sf_dir):
    """Any image read as floats in [0, 1]."""
    return _image(_normalised(spark, sf_dir, True), "unit_png")


_F32 = "CAST(CAST({v} AS FLOAT) AS DOUBLE)"


@query(f"""SELECT vec_id, round(list_sum(vs32), 4) AS red, round(CASE vec_id % 4 WHEN 1 THEN list_sum(vs32) WHEN 3 THEN NULL ELSE list_sum(vs2) END, 4) AS green, round(CASE vec_id % 4 WHEN 0 THEN list_sum(vs3) WHEN 2 THEN list_sum(vs3) WHEN 3 THEN NULL ELSE list_sum(vs32) END, 4) AS blue
FROM (SELECT vec_id, CASE WHEN vec_id % 4 = 3 THEN NULL ELSE list_transform(vs, lambda v: {_F32.format(v="v")}) END AS vs32, list_transform(vs, lambda v: {_F32.format(v="v * 2")}) AS vs2, list_transform(vs, lambda v: {_F32.format(v="v * 3")}) AS vs3 FROM ({_VALUES}))""")
def exr_rgb_channels(spark, sf_dir):
    """Colours from EXR files: by name, from a grey channel, from the first three channels, and none where the file is broken."""
    r = rasters(spark, sf_dir).select("vec_id", F.concat(F.array((F.col("vec_id") % 4).cast("double")), "values").alias("values"))

    def through(a: np.ndarray) -> np.ndarray:
        kind, v = int(a[0, 0]), a[0, 1:].reshape(8, 8)
        content = [lambda: images.encode_exr({"R": v, "G": v * 2, "B": v * 3}), lambda: images.encode_exr({"Y": v}), lambda: images.encode_exr({"a1": v, "a2": v * 2, "a3": v * 3, "a4": v}), lambda: b"broken"][kind]()
        rgb = images.exr_rgb(content)
        return np.full((1, 3), np.nan) if rgb is None else rgb.sum(axis=(0, 1))[None]

    sums = tensors.map_rasters(r, through, 1, 65)
    return sums.select("vec_id", *[F.when(~F.isnan(F.col("values")[k]), F.round(F.col("values")[k], 4)).alias(name) for k, name in enumerate(("red", "green", "blue"))])


@query(f"SELECT vec_id, round(list_sum(list_transform(vs, lambda v: {_F32.format(v='v * 2')})), 4) AS total FROM ({_VALUES})")
def exr_named_channel(spark, sf_dir):
    """One channel of an EXR file, by name."""
    read = lambda a: images.exr_channel(images.encode_exr({"normal.X": a, "depth": a * 2}), "depth")
    r = tensors.map_rasters(rasters(spark, sf_dir).select("vec_id", "values"), read, 8, 8)
    return r.select("vec_id", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""SELECT 'rgb/' || p_partkey || '.png' AS rgb, 'depth/' || p_partkey || '.png' AS depth, CASE WHEN p_size % 3 = 0 THEN 'filled/' || p_partkey || '.png' END AS filled FROM part WHERE p_size % 5 <> 0""")
def file_list_source(spark, sf_dir):
    """A list of files in whitespace-separated columns; rows whose depth is the word None are left out."""
    key, out = F.col("p_partkey").cast("string"), scratch(spark, "list")
    name = lambda kind: F.concat(F.lit(f"{kind}/"), key, F.lit(".png"))
    depth = F.when(F.col("p_size") % 5 == 0, "None").otherwise(name("depth"))
    line = F.concat_ws("  ", name("rgb"), depth, F.when(F.col("p_size") % 3 == 0, name("filled")))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(out)
    return listing.file_list(spark, out)


@query("SELECT CAST(p_partkey AS INT) AS frame, p_size % 2 AS camera, p_retailprice AS fx, p_retailprice * 2 AS fy, CAST(p_size * 10.0 AS DOUBLE) AS cx, CAST(p_size * 5.0 AS DOUBLE) AS cy FROM part")
def intrinsics_source(spark, sf_dir):
    """A table of intrinsics by frame and camera, with a header line."""
    out, price, size = scratch(spark, "intrinsics"), F.col("p_retailprice"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("frame"), (size % 2).alias("camera"), price.alias("k00"), (price * 2).alias("k11"), (size * 10.0).alias("k02"), (size * 5.0).alias("k12"))
    rows.write.option("sep", " ").option("header", True).csv(out)
    return listing.intrinsics(spark, out)


@query("SELECT source AS scene, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS frame, CAST(n_chars * 1.5 AS DOUBLE) AS fx FROM documents")
def focal_lines_source(spark, sf_dir):
    """Text of a line per frame whose first column is the focal length: frames are numbered by line."""
    out = scratch(spark, "focal")
    line = F.concat_ws(" ", (F.col("n_chars") * 1.5).cast("string"), F.lit("960 540"))
    d = table(spark, sf_dir, "documents").select("source", "doc_id", line.alias("value")).repartition("source").sortWithinPartitions("source", "doc_id")
    d.select("source", "value").write.partitionBy("source").text(out)  # a file of a source's lines, in order
    return listing.focal_lines(spark, out, "source").withColumnRenamed("source", "scene")


@query("""SELECT source AS scene, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS idx, 'depth/' || doc_id AS depth_path FROM documents
WHERE NOT (ascii(right(source, 1)) % 4 = 0) AND doc_id % 6 <> 0""")
def scene_manifest(spark, sf_dir):
    """The two-level manifest: a table of scenes, some skipped, and a table of frames for each, some with an error; frames are numbered by place."""
    out = scratch(spark, "manifest")
    d = table(spark, sf_dir, "documents")
    scene = d.select(F.col("source").alias("scene")).distinct()
    scene.select("scene", (F.ascii(F.right("scene", F.lit(1))) % 4 == 0).alias("skipped")).write.option("header", True).csv(f"{out}/dataset")
    rows = d.select(F.col("source").alias("scene"), F.concat(F.lit("depth/"), F.col("doc_id").cast("string")).alias("depht_path"), F.when(F.col("doc_id") % 6 == 0, "unreadable").alias("error"), F.col("doc_id").alias("place"))
    rows.write.option("header", True).csv(f"{out}/scenes")
    return listing.scene_frames(spark, f"{out}/dataset", f"{out}/scenes")


@query("SELECT p_partkey AS scene, p_size AS n FROM part UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def manifest_append(spark, sf_dir):
    """A manifest that is appended to: each part has its header, which is read once."""
    out = scratch(spark, "appended")
    sinks.append_manifest(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scene"), F.col("p_size").alias("n")), out)
    sinks.append_manifest(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scene"), F.col("s_nationkey").alias("n")), out)
    return spark.read.option("header", True).schema("scene bigint, n int").csv(out)


@query("SELECT printf('%05d', p_partkey) AS idx, printf('%.6f', p_retailprice / 7) AS abs_rel, CAST(p_size AS DOUBLE) AS f1 FROM part")
def metrics_lines(spark, sf_dir):
    """A JSON line per sample: metrics as text of six decimals, the boundary scores as numbers."""
    out = scratch(spark, "metrics")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample"), (F.col("p_retailprice") / 7).alias("abs_rel"), F.col("p_size").cast("double").alias("f1"))
    sinks.append_metrics(rows, out, "sample", ["abs_rel"])
    return spark.read.schema("idx string, abs_rel string, f1 double").json(out)


@query("SELECT p_brand AS dataset, round(avg(p_retailprice), 6) AS mean, count(*) AS n FROM part GROUP BY p_brand")
def metrics_summary(spark, sf_dir):
    """Averages by dataset, written anew as one JSON file."""
    out = scratch(spark, "summary")
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("dataset")).agg(F.round(F.avg("p_retailprice"), 6).alias("mean"), F.count("*").alias("n"))
    sinks.write_summary(rows, out)
    sinks.write_summary(rows, out)
    return spark.read.schema("dataset string, mean double, n bigint").json(out)


@query("SELECT p_partkey % 7 AS shard, count(*) AS n, sum(p_size)::BIGINT AS total FROM part GROUP BY 1")
def sharded_sink(spark, sf_dir):
    """Rows written in a folder per shard, under a name that did not exist, and read by shard."""
    base = scratch(spark, "sharded")
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("shard"), "p_size")
    for _ in range(2):
        out = sinks.fresh_folder(spark, base)
        sinks.write_shards(rows, out)
    assert out == f"{base}_1"
    read = spark.read.schema(StructType.fromDDL("p_size int, shard bigint")).parquet(out)
    return read.groupBy("shard").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


def _shards(spark, sf_dir):
    """Documents packed in order into tar shards of at most 200,000 characters for each source; (path, index)."""
    out = scratch(spark, "tar")
    d = sampling.pack(table(spark, sf_dir, "documents").select("source", "doc_id", "text", "n_chars"), "source", ["doc_id"], "n_chars", 200_000, block_rows=50_000)  # a task holds a block's texts
    shard = F.concat_ws("-", F.coalesce("source", F.lit("none")), F.lpad(F.col("shard").cast("string"), 6, "0"))
    items = d.select(shard.alias("shard"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("member"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    tar.write_shards(items, out).write.parquet(f"{out}/index")
    return out, spark.read.schema("shard_path string, member_name string, offset bigint, size bigint").parquet(f"{out}/index")


_MEMBERS = "SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS member_name, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, md5(coalesce(text, '')) AS digest FROM documents"


@query(_MEMBERS)
def tar_member_access(spark, sf_dir):
    """Members of tar shards, read by place and size from the index."""
    _, index = _shards(spark, sf_dir)
    return _digests(tar.read_members(index))


def _digests(members):
    return members.select("member_name", F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"))


@query(_MEMBERS)
def tar_shard_ranges(spark, sf_dir):
    """Whole tar shards in ranges of 64 KB dealt to tasks; what a task reads of a shard begins at the last header that the index knows before it."""
    path, _ = _shards(spark, sf_dir)
    return _digests(tar_source.register(spark).read.format("tarshards").option("splitBytes", 1 << 16).option("batchBytes", 1 << 18).option("index", f"{path}/index").load(path))


@query(_MEMBERS)
def tar_shard_stream(spark, sf_dir):
    """Whole tar shards as a stream: each file's members, once, in ranges of bytes."""
    path, _ = _shards(spark, sf_dir)
    members = _digests(tar_source.register(spark).readStream.format("tarshards").load(path))
    members.writeStream.format("parquet").option("path", f"{path}/members").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(members.schema).parquet(f"{path}/members")


@query(f"WITH {_CLIP.format(by='label', top=255)} SELECT vec_id, round(list_sum(ps), 6) AS total, round(ps[9], 6) AS second_row, round(list_max(ps), 6) AS top FROM q")
def tar_image_access(spark, sf_dir):
    """PNG images of each clip packed into tar shards of at most 20,000 bytes, read from there and decoded."""
    out = scratch(spark, "images")
    clips = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    pngs = codecs.encoded(_normalised(spark, sf_dir, True), "png8", 8, 8).select("vec_id", "content").join(clips, "vec_id")
    pngs = written(pngs.withColumn("bytes", F.octet_length("content").cast("long")), "png")
    packed = sampling.pack(pngs, "label", ["vec_id"], "bytes", 20_000)
    items = packed.select(F.concat_ws("-", F.coalesce(F.col("label").cast("string"), F.lit("none")), F.lpad(F.col("shard").cast("string"), 6, "0")).alias("shard"), F.concat(F.lpad(F.col("vec_id").cast("string"), 12, "0"), F.lit(".png")).alias("member"), "content")
    tar.write_shards(items, out).write.parquet(f"{out}/index")
    release(pngs)
    read = tar_source.register(spark).read.format("tarshards").load(out)
    files = read.select(F.regexp_extract("member_name", "^0*([0-9]+)", 1).cast("long").alias("vec_id"), "content")
    back = codecs.decoded(files, "png8")
    return rounded(back.select("vec_id", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"), F.element_at("values", 9).alias("second_row"), F.array_max("values").alias("top")))
