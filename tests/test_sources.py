"""Codecs, listings, sinks, whole-raster operators and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import tensors
from frameloom.sources import codecs, listing, sinks
from frameloom.streaming import clips


def test_codecs_round_trip():
    rng = np.random.default_rng(0)
    a = rng.random((3, 5)).astype(np.float32)
    for encode, decode in codecs.CODECS.values():
        assert (decode(encode(a)) == a).all()
    flow = rng.random((2, 3, 2)).astype(np.float32)
    assert (codecs.decode_flow(codecs.encode_flow(flow)) == flow).all()
    m, n = codecs.decode_camera(codecs.encode_camera(np.eye(3), np.ones((3, 4))))
    assert (m == np.eye(3)).all() and n.shape == (3, 4)
    rgb = rng.random((2, 4, 3)).astype(np.float32)
    assert (codecs.decode_pfm(codecs.encode_pfm(rgb)) == rgb).all()
    assert codecs.decode_raw(np.array([1, np.inf], "<f4").tobytes(), 1, 2).tolist() == [[1, 0]]
    with pytest.raises(ValueError):
        codecs.decode_depth(b"\0" * 20)


def test_files_are_read_and_bad_ones_give_nulls(spark, tmp_path):
    a = np.arange(6, dtype=np.float32).reshape(2, 3)
    (tmp_path / "a.dpt").write_bytes(codecs.encode_depth(a))
    (tmp_path / "b.dpt").write_bytes(b"nonsense")
    got = {r["path"][-5:]: (r["h"], r["w"], r["values"]) for r in codecs.read_files(spark, str(tmp_path), "dpt", "*.dpt").collect()}
    assert got == {"a.dpt": (2, 3, a.reshape(-1).tolist()), "b.dpt": (None, None, None)}


def test_listings(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a.png a.exr\nb.png None\n\nc.png c.exr c.fill\n")
    assert [(r["rgb"], r["depth"], r["filled"]) for r in listing.file_list(spark, str(tmp_path / "list.txt")).orderBy("rgb").collect()] == [("a.png", "a.exr", None), ("c.png", "c.exr", "c.fill")]
    paths = spark.createDataFrame([("s/f10.png",), ("s/f2.png",), ("t/f1.png",), ("t/f2.png",), ("u/x.png",)], "path string")
    got = {r["scene"]: (r["n_frames"], r["first_idx"], r["contiguous"], r["frames"]) for r in listing.scene_index(paths, least=2).collect()}
    assert got == {"s": (2, 2, False, ["s/f2.png", "s/f10.png"]), "t": (2, 1, True, ["t/f1.png", "t/f2.png"])}
    (tmp_path / "k.txt").write_text("frame camera k00 k11 k02 k12\n0 1 7 8 3 4\n")
    assert listing.intrinsics(spark, str(tmp_path / "k.txt")).first().asDict() == {"frame": 0, "camera": 1, "fx": 7.0, "fy": 8.0, "cx": 3.0, "cy": 4.0}
    (tmp_path / "m.csv").write_text("scene,depht_path,error,skipped\na,x,,\nb,y,boom,\nc,z,,True\n")
    rows = listing.manifest(spark, str(tmp_path / "m.csv")).collect()
    assert [(r["scene"], r["depth_path"]) for r in rows] == [("a", "x")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 0.25), (2, 1.0, 0.75)], "sample long, rmse double, f1 double")
    sinks.append_metrics(df, str(tmp_path / "m"), "sample", ["rmse"])
    lines = sorted(json.loads(x)["idx"] + json.loads(x)["rmse"] + str(json.loads(x)["f1"]) for p in (tmp_path / "m").glob("*.json") for x in p.read_text().splitlines())
    assert lines == ["000010.5000000.25", "000021.0000000.75"]
    sinks.write_shards(df.withColumn("shard", F.col("sample") % 2), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert sinks.fresh_folder(spark, str(tmp_path / "s")).endswith("s_1")


def test_bilinear_and_bands():
    a = np.arange(24.0).reshape(4, 6)
    assert np.allclose(tensors.bilinear(a, 4, 6), a) and np.allclose(tensors.bilinear(np.full((3, 3), 2.0), 7, 5), 2.0)
    assert np.allclose(tensors.band_merge(a, a + 5, 2), tensors.band_merge(a, a, 2))


def test_components_and_median():
    m = np.array([[1, 1, 0, 0], [0, 0, 0, 1], [0, 0, 1, 0]], bool)
    assert tensors.component_areas(m).tolist() == [[2, 2, 0, 0], [0, 0, 0, 2], [0, 0, 2, 0]]
    assert tensors.keep_large_components(m, 3).sum() == 0
    spiked = np.zeros((7, 7))
    spiked[3, 3] = 9
    assert tensors.median_filter(spiked).max() == 0


def test_plane_normals_of_a_plane():
    n = tensors.plane_normals(np.full((8, 8), 2.0), 7.0)
    assert np.allclose(n, [0, 0, -1], atol=1e-9)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, float(i), i) for i in range(40)], "scene long, value double, id long")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = clips.read_stream(spark, str(tmp_path / "in"), "scene long, value double, id long", 2)
    kept = clips.select_valid(stream, 3.0, 30.0)
    for _ in range(2):
        clips.run_once(kept, str(tmp_path / "ck"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 26
