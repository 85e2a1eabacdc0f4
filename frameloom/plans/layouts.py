"""Queries of layout rules: paths are put together from the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..sources import layouts
from ..sources.views import frames, table, with_views
from .registry import query


def _paths(spark, sf_dir, path: str):
    """A row per part with a path of the given SQL."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr(path).alias("path"))


_SCENE = "'scene' || p_size || '/rgb/img_' || (p_partkey % 90) || CASE WHEN p_partkey % 7 = 0 THEN '.txt' ELSE '.png' END"


@query(f"""SELECT 'scene' || p_size || '/rgb' AS scene, array_to_string(list_sort(list(DISTINCT p_partkey % 90)), ',') AS ids FROM part GROUP BY p_size""")
def layout_suffix_ids(spark, sf_dir):
    """Scenes with the distinct numeric suffixes of their files."""
    ids = layouts.suffix_ids(_paths(spark, sf_dir, _SCENE))
    return ids.select("scene", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


_PREVIEW = "'ai_' || p_size || '/scene_cam_00_final_preview/frame.' || lpad(CAST(p_partkey AS {t}), 4, '0') || CASE WHEN p_partkey % 3 = 0 THEN '.gamma.jpg' ELSE '.tonemap.jpg' END"


@query(f"""WITH p AS (SELECT {_PREVIEW.format(t="VARCHAR").replace("lpad(CAST(p_partkey AS VARCHAR), 4, '0')", "CASE WHEN p_partkey < 10000 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE left(CAST(p_partkey AS VARCHAR), 4) END")} AS path FROM part)
SELECT path AS rgb, replace(replace(path, '_final_preview/', '_geometry_hdf5/'), '.tonemap.jpg', '.depth_meters.hdf5') AS depth, replace(replace(path, '_final_preview/', '_geometry_hdf5/'), '.tonemap.jpg', '.normal_cam.hdf5') AS normal FROM p WHERE path LIKE '%.tonemap.jpg'""")
def layout_tonemapped(spark, sf_dir):
    """Tone-mapped previews with their depth and normal files."""
    return layouts.tonemapped(_paths(spark, sf_dir, _PREVIEW.format(t="STRING")))


@query("""SELECT DISTINCT 'env' || p_size || '/P' || (p_partkey % 3) || '/depth_' || CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS folder, CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS side,
  'env' || p_size || '/P' || (p_partkey % 3) || '/image_' || CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS image_folder FROM part WHERE p_partkey % 5 <> 0""")
def layout_sided_depth(spark, sf_dir):
    """Depth folders with the camera's side in their name."""
    path = "'env' || p_size || '/P' || (p_partkey % 3) || CASE WHEN p_partkey % 5 = 0 THEN '/image_' ELSE '/depth_' END || CASE WHEN p_partkey % 2 = 0 THEN 'left/' ELSE 'right/' END || p_partkey || '.npy'"
    return layouts.sided_depth_folders(_paths(spark, sf_dir, path))


_DAY = "lpad(CAST(p_size % 28 + 1 AS {t}), 2, '0')"


@query(f"""SELECT p_partkey, '2011_09_' || {_DAY.format(t="VARCHAR")} AS date, '2011_09_' || {_DAY.format(t="VARCHAR")} || '/2011_09_' || {_DAY.format(t="VARCHAR")} || '_drive_000' || (p_size % 10) || '_sync/image_02/data/' || p_partkey || '.png' AS rgb FROM part""")
def layout_dated_drive(spark, sf_dir):
    """Image paths from the date in the drive's name of a depth path."""
    path = f"'train/2011_09_' || {_DAY.format(t='STRING')} || '_drive_000' || (p_size % 10) || '_sync/proj_depth/groundtruth/image_02/' || p_partkey || '.png'"
    p = _paths(spark, sf_dir, path)
    return p.select("p_partkey", layouts.drive_date(F.col("path")).alias("date"), layouts.dated_drive(F.col("path")).alias("rgb"))


@query("""WITH c AS (SELECT c_nationkey AS s, c_custkey AS id FROM customer), d AS (SELECT s_nationkey AS s, s_suppkey AS id FROM supplier)
SELECT 'scene' || c.s AS scene, c.id AS id, 'scene' || c.s || '/color/' || c.id || '.jpg' AS color, 'scene' || d.s || '/depth/' || d.id || '.png' AS depth FROM c JOIN d ON c.s = d.s AND c.id = d.id""")
def layout_paired_folders(spark, sf_dir):
    """Colour and depth files of a scene with equal numbers."""
    color = table(spark, sf_dir, "customer").selectExpr("'scene' || c_nationkey || '/color/' || c_custkey || '.jpg' AS path")
    depth = table(spark, sf_dir, "supplier").selectExpr("'scene' || s_nationkey || '/depth/' || s_suppkey || '.png' AS path")
    return layouts.paired_folders(color.unionByName(depth), "color", "depth")


@query("""SELECT DISTINCT 's' || p_size || '/depth' || (p_partkey % 2) AS folder, 's' || p_size || '/rgb' || (p_partkey % 2) AS sibling FROM part WHERE p_size % 2 = 0""")
def layout_depth_with_images(spark, sf_dir):
    """Depth folders whose sibling of images is there."""
    depth = _paths(spark, sf_dir, "'s' || p_size || '/depth' || (p_partkey % 2) || '/' || p_partkey || '.png'")
    rgb = _paths(spark, sf_dir, "'s' || p_size || '/rgb' || (p_partkey % 2) || '/' || p_partkey || '.png'").where("p_size % 2 = 0")
    return layouts.depth_folders_with_images(depth.unionByName(rgb))


@query("""SELECT p_partkey, 'room' || p_size || '/depth_' || p_partkey || '.npy' AS depth, CAST(CAST(p_partkey + 0.25 AS DECIMAL(18, 2)) AS DOUBLE) AS at FROM part""")
def layout_extension_and_time(spark, sf_dir):
    """The depth file by its extension, and the time in seconds that a file's stem gives."""
    p = _paths(spark, sf_dir, "'room' || p_size || '/depth_' || p_partkey || '.jpg'")
    at = F.regexp_extract(F.concat(F.col("p_partkey").cast("string"), F.lit(".25.png")), r"^(\d+\.\d+)\.[^.]*$", 1).cast("double")
    return p.select("p_partkey", layouts.swap_extension(F.col("path"), ".npy").alias("depth"), at.alias("at"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN 'shot' || p_size END AS shot, CASE WHEN p_size % 5 <> 0 THEN p_partkey END AS frame, CASE WHEN p_size % 5 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'right' END END AS side FROM part""")
def layout_stereo_names(spark, sf_dir):
    """Shot, frame and side of stereo images; other names give nulls."""
    path = "'in/shot' || p_size || '/f_' || p_partkey || CASE WHEN p_size % 5 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN '_left' ELSE '_right' END || '.png'"
    return _paths(spark, sf_dir, path).select("p_partkey", layouts.stereo_name(F.col("path")).alias("n")).select("p_partkey", "n.shot", "n.frame", "n.side")


@query("""SELECT p_partkey AS frame, 'seq/' || p_partkey || '.exr' AS path FROM part WHERE p_size % 6 <> 0 AND p_partkey BETWEEN 100 AND 1500""")
def layout_frame_range(spark, sf_dir):
    """Files of a sequence between two frames; names that are no numbers are skipped."""
    path = "'seq/' || CASE WHEN p_size % 6 = 0 THEN 'thumb' ELSE '' END || p_partkey || '.exr'"
    return layouts.in_frame_range(_paths(spark, sf_dir, path), 100, 1500).select("frame", "path")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'show' || p_size || '/depth/take' || p_partkey END AS output FROM part""")
def layout_wildcards(spark, sf_dir):
    """Output folders by patterns with wildcards."""
    p = _paths(spark, sf_dir, "'show' || p_size || CASE WHEN p_size % 3 = 0 THEN '/rgb/take' ELSE '/mask/take' END || p_partkey")
    return p.select("p_partkey", layouts.map_wildcards(F.col("path"), "*/rgb/*", "^/depth/^").alias("output"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'still_depth.exr' ELSE 'clip_depth.' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE CAST(p_partkey AS VARCHAR) END || '.exr' END AS name FROM part""")
def layout_depth_names(spark, sf_dir):
    """Names of depth files that keep the frame's digits."""
    p = _paths(spark, sf_dir, "'a/' || CASE WHEN p_size % 4 = 0 THEN 'still' ELSE 'clip_' || p_partkey END || '.png'")
    return p.select("p_partkey", layouts.depth_file_name(F.col("path"), ".exr").alias("name"))


@query("""SELECT source AS scene, count(*) AS n_rgb, count(*) AS n_intrinsics FROM documents GROUP BY source""")
def intrinsics_complete(spark, sf_dir):
    """Scenes whose number of intrinsics must equal that of their frames; a difference ends the query."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("scene"))
    rgb, rows = d.groupBy("scene").agg(F.count("*").alias("n_rgb")), d.withColumn("fx", F.lit(1.0)).groupBy("scene").agg(F.count("fx").alias("n_intrinsics"))
    return layouts.checked_equal(rgb.join(rows, "scene", "left"), F.col("n_rgb"), F.col("n_intrinsics"), "frames and intrinsics")


@query(f"""{with_views("frames")}, a AS (SELECT scene, event_id, row_number() OVER (PARTITION BY scene ORDER BY frame_idx) - 1 AS pos FROM frames), b AS (SELECT scene, event_id, row_number() OVER (PARTITION BY scene ORDER BY frame_idx DESC) - 1 AS pos FROM frames)
SELECT a.scene, CAST(a.pos AS BIGINT) AS pos, a.event_id AS rgb_id, b.event_id AS depth_id FROM a JOIN b ON a.scene = b.scene AND a.pos = b.pos""")
def positional_zip_checked(spark, sf_dir):
    """Two lists paired by position, whose lengths must be equal."""
    f = frames(spark, sf_dir).select("scene", "event_id", "frame_idx")
    side = lambda name, order: f.select("scene", F.col("event_id").alias(name), order.alias(f"{name}_order"))
    left, right = side("rgb_id", F.col("frame_idx")), side("depth_id", -F.col("frame_idx"))
    lengths = left.groupBy("scene").agg(F.count("*").alias("n")).join(right.groupBy("scene").agg(F.count("*").alias("m")), "scene", "full")
    checked = layouts.checked_equal(lengths, F.col("n"), F.col("m"), "lengths").select("scene")
    zipped = joins.zip_by_position(left, right, ["scene"], ["rgb_id_order"], ["depth_id_order"])
    return zipped.join(checked, "scene", "left_semi").select("scene", "pos", "rgb_id", "depth_id")


@query(f"""{with_views("frames")} SELECT scene, event_type AS variant, CAST(k AS BIGINT) % 2 AS camera, count(*) AS n, array_to_string(list(frame_idx ORDER BY frame_idx), ',') AS frames FROM frames GROUP BY ALL""")
def frames_by_camera(spark, sf_dir):
    """The frames of each scene, variant and camera, as lists in order."""
    f = frames(spark, sf_dir).select("scene", F.col("event_type").alias("variant"), (F.col("k").cast("long") % 2).alias("camera"), "frame_idx")
    lists = f.groupBy("scene", "variant", "camera").agg(F.sort_array(F.collect_list("frame_idx")).alias("fs"))
    return lists.select("scene", "variant", "camera", F.size("fs").cast("long").alias("n"), F.array_join(F.transform("fs", lambda x: x.cast("string")), ",").alias("frames"))
