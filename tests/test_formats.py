"""Image formats against files made by other means, tar shards against the standard library, and the errors of composed stages."""

import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions.scalar import is_out_of_memory
from frameloom.operators import stages
from frameloom.sources import images, layouts, sinks, tar


def _filtered_png(a, modes):
    """A PNG whose rows use the given filters in turn, byte by byte."""
    h, w, c = a.shape
    out, before = b"", np.zeros(w * c, int)
    for y in range(h):
        row, mode = a[y].reshape(-1).astype(int), modes[y % len(modes)]
        left = np.r_[np.zeros(c, int), row[:-c]]
        corner = np.r_[np.zeros(c, int), before[:-c]]
        if mode == 4:
            guess = [min((abs(b + l - k - p), i, p) for i, (p, b, l, k) in enumerate([(l, b, l, k), (b, b, l, k), (k, b, l, k)]))[2] for l, b, k in zip(left, before, corner)]
        else:
            guess = [np.zeros_like(row), left, before, (left + before) // 2][mode]
        out += bytes([mode]) + bytes(((row - guess) % 256).tolist())
        before = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    packed = zlib.compress(out)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_filters(channels):
    a = np.random.default_rng(1).integers(0, 256, (11, 7, channels)).astype(np.uint8)
    got = images.decode_png(_filtered_png(a, [0, 1, 2, 3, 4]))
    assert (got.reshape(a.shape) == a).all()


def test_png_round_trips_and_refusals():
    rng = np.random.default_rng(2)
    for a in (rng.integers(0, 65536, (4, 5)).astype(np.uint16), rng.integers(0, 65536, (4, 5, 3)).astype(np.uint16), rng.integers(0, 256, (1, 1)).astype(np.uint8)):
        back = images.decode_png(images.encode_png(a))
        assert back.dtype == a.dtype and (back == a).all()
    with pytest.raises(ValueError):
        images.decode_png(b"GIF89a")
    assert images.unit_image(np.array([[np.nan, np.inf, -1.0, 0.5, 7.0]])).tolist() == [[0, 0, 0, 0.5, 1]]
    assert images.unit_image(np.array([[255, 0]], np.uint8)).tolist() == [[1.0, 0.0]]


@pytest.mark.parametrize("packed", [0, 2, 3])
def test_exr_of_each_packing(packed):
    a = {"B": np.random.default_rng(3).random((37, 6)).astype("<f2"), "Z": np.arange(222, dtype="<u4").reshape(37, 6)}
    text = images.encode_exr({k: v.astype(float) for k, v in a.items()})
    head = text[: text.index(b"screenWindowWidth")]
    listed = b"B\0" + struct.pack("<i4x2i", 1, 1, 1) + b"Z\0" + struct.pack("<i4x2i", 0, 1, 1) + b"\0"
    old = b"B\0" + struct.pack("<i4x2i", 2, 1, 1) + b"Z\0" + struct.pack("<i4x2i", 2, 1, 1) + b"\0"
    head = head.replace(old, listed).replace(b"compression\0compression\0\x01\0\0\0\0", b"compression\0compression\0\x01\0\0\0" + bytes([packed]))
    head += b"screenWindowWidth\0float\0\4\0\0\0" + struct.pack("<f", 1) + b"\0"
    blocks, step = [], 16 if packed == 3 else 1
    for y in range(0, 37, step):
        data = b"".join(a["B"][k].tobytes() + a["Z"][k].tobytes() for k in range(y, min(37, y + step)))
        if packed:
            b = np.frombuffer(data, np.uint8)
            b = np.r_[b[0::2], b[1::2]].astype(int)
            zipped = zlib.compress(bytes(np.r_[b[0], (np.diff(b) + 128) % 256].tolist()))
            data = zipped if len(zipped) < len(data) else data
        blocks.append(struct.pack("<2i", y, len(data)) + data)
    at = len(head) + 8 * len(blocks) + np.cumsum([0, *map(len, blocks[:-1])])
    got = images.decode_exr(head + struct.pack(f"<{len(at)}Q", *at.tolist()) + b"".join(blocks))
    assert (got["B"] == a["B"]).all() and (got["Z"] == a["Z"]).all()


def test_exr_colours_and_missing_channels():
    v = np.ones((2, 2))
    assert images.exr_rgb(images.encode_exr({"r": v, "B": v * 3})).tolist() == [[[1, 1, 3]] * 2] * 2
    assert images.exr_rgb(images.encode_exr({"a": v})) is None and images.exr_rgb(b"") is None
    with pytest.raises(KeyError):
        images.exr_channel(images.encode_exr({"a": v}), "depth")


def test_tar_shards_are_plain_tar_files(spark, tmp_path):
    rows = [("a", f"m{i:03d}", bytes([i]) * (i * 37 % 1500)) for i in range(40)] + [("b", "n" * 120, b"long name"), ("b", "empty", b"")]
    index = tar.write_shards(spark.createDataFrame(rows, "shard string, member string, content binary"), f"file://{tmp_path}").cache()
    assert index.count() == len(rows)
    want = {m: c for _, m, c in rows}
    with tarfile.open(f"{tmp_path}/a.tar") as t:
        assert {m.name: t.extractfile(m).read() for m in t} == {m: c for s, m, c in rows if s == "a"}
    for read in (tar.read_members(index), tar.read_cached(index, 1), tar.read_cached(index)):
        assert {r["member_name"]: bytes(r["content"]) for r in read.collect()} == want
    for read in (tar.read_members(index, 1), tar.read_cached(index, 1, 1)):
        assert {r["member_name"]: bytes(r["content"]) for r in read.collect()} == want
    assert tar.read_members(index.where("false")).count() == 0


def test_copies_are_equal(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.bin").write_bytes(b"x" * 3_000_000)
    rows = spark.createDataFrame([(f"file://{tmp_path}/in/x.bin", f"file://{tmp_path}/out/deep/y.bin")], "path string, target string")
    assert sinks.copy_files(rows).first()["size"] == 3_000_000 and (tmp_path / "out" / "deep" / "y.bin").read_bytes() == b"x" * 3_000_000


def test_patterns_and_counts_that_do_not_fit(spark):
    with pytest.raises(ValueError, match="same number"):
        layouts.map_wildcards(F.lit("a"), "*/b", "^")
    with pytest.raises(ValueError, match="needs a"):
        layouts.map_wildcards(F.lit("a"), "*/b", "x/b")
    df = spark.createDataFrame([("s", 1, 1), ("t", 2, 3)], "s string, n int, m int")
    assert layouts.checked_equal(df.where("s = 's'"), F.col("n"), F.col("m"), "sizes").count() == 1
    with pytest.raises(Exception, match="sizes: 2 and 3"):
        layouts.checked_equal(df, F.col("n"), F.col("m"), "sizes").collect()


def test_stages_say_what_is_missing(spark):
    df = spark.range(3)
    with pytest.raises(ValueError, match="lacks"):
        stages.run_stages(df, [stages.Stage("s", ("x",), (), lambda d: d)])
    with pytest.raises(ValueError, match="did not add"):
        stages.run_stages(df, [stages.Stage("s", ("id",), ("x",), lambda d: d)])
    with pytest.raises(ValueError, match="no columns"):
        stages.on_columns(["x"], lambda c: c)(df)
    with pytest.raises(KeyError):
        stages.instantiate({})
    registry = stages.Registry()
    registry.add("One")(lambda k: k + 1)
    assert registry.build("one", 1) == 2 and registry.build("ONE", 2) == 3
    assert stages.instantiate({"target": "fractions.Fraction", "params": {"numerator": 1}}, denominator=2) == 0.5
    with pytest.raises(KeyError):
        registry.build("two")
    assert df.select(is_out_of_memory(F.lit(None).cast("string")).alias("x")).first()["x"] is False
