"""Catalog rules of particular folder layouts, over a column of relative paths: listings come from ``binaryFile`` without content, or a manifest."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SUFFIX = r"(\d+)(?:\.[^./]*)?$"


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def suffix_ids(files: DataFrame, path: str = "path") -> DataFrame:
    """(scene, ids): the distinct numeric suffixes of file stems of each folder, ascending; other files are skipped."""
    parsed = files.select(parent(F.col(path)).alias("scene"), F.regexp_extract(path, _SUFFIX, 1).try_cast("bigint").alias("id")).where("id IS NOT NULL")
    return parsed.groupBy("scene").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def tonemapped(files: DataFrame, path: str = "path") -> DataFrame:
    """(rgb, depth, normal) of tone-mapped previews; depth and normals lie in the geometry folder beside the preview's."""
    kept = files.where(F.col(path).endswith(".tonemap.jpg"))
    other = lambda name: F.replace(F.replace(path, F.lit("_final_preview/"), F.lit("_geometry_hdf5/")), F.lit(".tonemap.jpg"), F.lit(name))
    return kept.select(F.col(path).alias("rgb"), other(".depth_meters.hdf5").alias("depth"), other(".normal_cam.hdf5").alias("normal"))


def sided_depth_folders(files: DataFrame, path: str = "path") -> DataFrame:
    """(folder, side, image_folder) of folders depth_<side>; the side is read from the name."""
    folder = parent(F.col(path))
    dirs = files.select(folder.alias("folder")).where(F.col("folder").rlike(r"(^|/)depth_[^/]*$")).distinct()
    side = F.when(F.regexp_extract("folder", r"([^/]*)$", 1).contains("left"), "left").otherwise("right")
    return dirs.select("folder", side.alias("side"), F.concat(F.regexp_replace("folder", r"depth_[^/]*$", ""), F.lit("image_"), side).alias("image_folder"))


def dated_drive(path: Column) -> Column:
    """The image's path from a depth path: <date>/<drive>/image_<camera>/data/<name>, the date being the head of the drive's name."""
    drive, camera, name = F.regexp_extract(path, r"([^/]*_sync)/", 1), F.regexp_extract(path, r"(image_\d+)", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat_ws("/", drive_date(path), drive, camera, F.lit("data"), name)


def drive_date(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d{4}_\d{2}_\d{2})", 1)


def paired_folders(files: DataFrame, left: str, right: str, path: str = "path") -> DataFrame:
    """(scene, id, left, right): files of scene/<left>/ and scene/<right>/ whose numeric stems are equal."""
    side = lambda name: files.where(F.col(path).rlike(rf"/{re.escape(name)}/[^/]*$")).select(parent(parent(F.col(path))).alias("scene"), F.regexp_extract(path, _SUFFIX, 1).try_cast("bigint").alias("id"), F.col(path).alias(name)).where("id IS NOT NULL")
    return side(left).join(side(right), ["scene", "id"])


def depth_folders_with_images(files: DataFrame, path: str = "path") -> DataFrame:
    """Folders whose name holds ``depth`` and whose sibling with ``rgb`` in its stead is there."""
    folders = files.select(parent(F.col(path)).alias("folder")).distinct()
    depth = folders.where(F.regexp_extract("folder", r"([^/]*)$", 1).contains("depth")).withColumn("sibling", F.regexp_replace("folder", r"depth([^/]*)$", "rgb$1"))
    return depth.join(folders.select(F.col("folder").alias("sibling")), "sibling", "left_semi").select("folder", "sibling")


def swap_extension(path: Column, to: str) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", to)


def stereo_name(path: Column) -> Column:
    """struct<shot,frame,side> of shot/..._<frame>_<side>.ext; null where the name is of another form."""
    form = r"([^/]+)/[^/]*?(\d+)_(left|right)\.[^./]*$"
    found = F.struct(F.regexp_extract(path, form, 1).alias("shot"), F.regexp_extract(path, form, 2).try_cast("bigint").alias("frame"), F.regexp_extract(path, form, 3).alias("side"))
    return F.when(path.rlike(form), found)


def in_frame_range(files: DataFrame, first: int | None = None, last: int | None = None, path: str = "path") -> DataFrame:
    """Adds ``frame``; files without a number as their stem are skipped, and those outside [first, last]."""
    rows = files.withColumn("frame", stem(F.col(path)).try_cast("bigint")).where("frame IS NOT NULL")
    rows = rows if first is None else rows.where(F.col("frame") >= first)
    return rows if last is None else rows.where(F.col("frame") <= last)


def map_wildcards(folder: Column, inputs: str, outputs: str) -> Column:
    """The output folder of an input folder: ``*`` stands for any name, ``^`` for the name at its place; null without a match."""
    split = lambda spec: [s for s in re.split(r"[\\/]+", spec.strip()) if s]
    ins, outs = split(inputs), split(outputs)
    if len(ins) != len(outs):
        raise ValueError("both patterns need the same number of parts")
    if any(a == "*" and b != "^" for a, b in zip(ins, outs, strict=True)):
        raise ValueError("a * among the inputs needs a ^ among the outputs")
    names = F.split(folder, "/")
    fits = F.size(names) == len(ins)
    for k, s in enumerate(ins):
        fits = fits if s == "*" else fits & (F.get(names, F.lit(k)) == s)
    return F.when(fits, F.concat_ws("/", *[F.get(names, F.lit(k)) if s == "^" else F.lit(s) for k, s in enumerate(outs)]))


def depth_file_name(path: Column, extension: str, width: int = 4) -> Column:
    """The output's name: the digits at the end of the stem stay, padded, behind _depth; a stem without any gets _depth."""
    name, digits = stem(path), F.regexp_extract(stem(path), r"(\d+)$", 1)
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    head = F.regexp_replace(name, r"[._-]?\d+$", "")
    return F.when(digits == "", F.concat(name, F.lit("_depth"), F.lit(extension))).otherwise(F.concat(head, F.lit("_depth."), padded, F.lit(extension)))


def checked_equal(rows: DataFrame, left: Column, right: Column, what: str) -> DataFrame:
    """The same rows; a row whose two counts differ ends the query with a message."""
    text = F.concat(F.lit(f"{what}: "), left.cast("string"), F.lit(" and "), right.cast("string"))
    return rows.where(F.assert_true(left.eqNullSafe(right), text).isNull())
