"""Frame datasets through their hooks."""

import json

import pytest

from frameloom.sources import frame_source, sinks


@pytest.fixture
def folder(tmp_path):
    for scene, frames in (("b", [3, 1, 10]), ("a", [2]), ("empty", [])):
        for kind, ending in (("rgb", "png"), ("depth", "dpt"), ("camera", "json")):
            (tmp_path / scene / kind).mkdir(parents=True)
            for n in frames:
                if kind == "depth" and n == 10 or kind == "camera" and n == 1:
                    continue
                content = json.dumps({"fx": n, "width": 8}) if kind == "camera" else f"{scene}{kind}{n}"
                (tmp_path / scene / kind / f"{n:08d}.{ending}").write_text(content)
    return tmp_path


def _read(spark, folder, **options):
    spark.dataSource.register(frame_source.FolderFrames)
    return spark.read.format("framefolders").option("path", f"file://{folder}").options(**options).load()


def test_frames_have_both_images_and_cameras_may_lack(spark, folder):
    rows = {(r["scene"], r["frame"]): (bytes(r["rgb"]), bytes(r["depth"]), r["fx"], r["width"]) for r in _read(spark, folder, framesPerTask=1, batchBytes=1).collect()}
    assert rows == {("b", 1): (b"brgb1", b"bdepth1", None, None), ("b", 3): (b"brgb3", b"bdepth3", 3.0, 8.0), ("a", 2): (b"argb2", b"adepth2", 2.0, 8.0)}
    assert _read(spark, folder, framesPerTask=1).rdd.getNumPartitions() == 3


def test_colour_only_needs_no_depth(spark, folder):
    assert sorted((r["scene"], r["frame"], r["depth"]) for r in _read(spark, folder, colourOnly="true").collect()) == [("a", 2, None), ("b", 1, None), ("b", 3, None), ("b", 10, None)]


def test_a_dataset_of_ones_own(spark):
    class Made(frame_source.FrameDataset):
        @classmethod
        def name(cls):
            return "made"

        def sequences(self):
            yield "s", list(range(7))

        def load(self, scene, frame, depth):
            if frame == 5:
                raise OSError("lost")
            return bytes([frame]), b"d" if depth else None

    spark.dataSource.register(Made)
    assert sorted(r["frame"] for r in spark.read.format("made").option("skipErrors", "true").option("framesPerTask", 3).load().collect()) == [0, 1, 2, 3, 4, 6]
    with pytest.raises(Exception, match="lost"):
        spark.read.format("made").load().collect()


def test_files_are_written_whole(spark, tmp_path):
    rows = spark.createDataFrame([(f"file://{tmp_path}/x/{i}.bin", None if i == 0 else b"z" * i) for i in range(5)], "path string, content binary")
    assert {r["size"] for r in sinks.write_files(rows).collect()} == {0, 1, 2, 3, 4}
    assert sorted(p.name for p in (tmp_path / "x").iterdir()) == [f"{i}.bin" for i in range(5)] and (tmp_path / "x" / "3.bin").read_bytes() == b"zzz"
