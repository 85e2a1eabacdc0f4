"""The tar data source, batch and stream, against tarfile."""

import io
import os
import tarfile

import pytest

from frameloom.sources import tar, tar_source


@pytest.fixture
def shards(tmp_path):
    """Two shards with long names, folders, empty members and one member above the split; {(file, name): content}."""
    want = {}
    for k in range(2):
        with tarfile.open(tmp_path / f"s{k}.tar", "w", format=tarfile.PAX_FORMAT if k else tarfile.GNU_FORMAT) as out:
            for i in range(60):
                if i % 9 == 0:
                    folder = tarfile.TarInfo(f"folder{i}")
                    folder.type = tarfile.DIRTYPE
                    out.addfile(folder)
                name = ("é" * 300 if i % 7 == 3 else "m") + f"{i:03d}"
                content = os.urandom(0 if i % 5 == 0 else 40_000 if i == 30 else i * 31)
                info = tarfile.TarInfo(name)
                info.size = len(content)
                out.addfile(info, io.BytesIO(content))
                want[f"s{k}.tar", name] = content
    (tmp_path / "empty.tar").write_bytes(b"")
    (tmp_path / "note.txt").write_text("no shard")
    return tmp_path, want


def _got(df):
    rows = df.collect()
    out = {(os.path.basename(r["shard_path"]), r["member_name"]): bytes(r["content"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("split,batch", [(512, 1), (3_000, 1_000), (10_000, 1 << 20), (1 << 30, 5_000)])
def test_ranges_give_every_member_once(spark, shards, split, batch):
    path, want = shards
    df = tar_source.register(spark).read.format("tarshards").option("splitBytes", split).option("batchBytes", batch).load(f"file://{path}")
    assert _got(df) == want
    assert df.rdd.getNumPartitions() >= min(200, sum(os.path.getsize(path / f"s{k}.tar") for k in range(2)) // split)


@pytest.mark.parametrize("split", [512, 2_000, 20_000])
def test_an_index_gives_the_same(spark, shards, split):
    path, want = shards
    members = tar_source.register(spark).read.format("tarshards").option("contents", "false").load(f"file://{path}")
    assert {r["content"] for r in members.collect()} == {None}
    members.drop("content").write.parquet(f"file://{path}/index")
    assert _got(spark.read.format("tarshards").option("splitBytes", split).option("index", f"file://{path}/index").load(f"file://{path}")) == want
    for r in members.limit(20).collect():
        with open(r["shard_path"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            assert f.read(r["size"]) == want[os.path.basename(r["shard_path"]), r["member_name"]]


def test_a_range_reads_its_own_bytes_only(shards):
    path, want = shards
    files = tar_source.list_shards(f"file://{path}")
    assert [os.path.basename(f[1]) for f in files if f[2]] == ["s0.tar", "s1.tar"]
    batches = [b for part in tar_source.ranges(files, 8_192, {}) for b in tar_source.read_range(part, 4_096, True)]
    sizes = [(b.num_rows, sum(len(c.as_py()) for c in b.column(4))) for b in batches]
    assert sum(n for n, _ in sizes) == len(want) and all(n == 1 or size <= 4_096 for n, size in sizes)


def test_small_ranges_share_tasks(spark, shards):
    path, want = shards
    parts = tar_source.ranges(tar_source.list_shards(f"file://{path}"), 512, {})
    tasks = tar_source.tasks(parts)
    assert len(parts) > len(tasks) == tar_source.TASKS
    dealt = [p for t in tasks for p in t.parts]
    assert [(p.path, p.start) for p in parts] == [(p.path, at) for p in dealt for at in range(p.start, p.stop, 512)]
    assert all(a.path != b.path for t in tasks for a, b in zip(t.parts, t.parts[1:], strict=False))
    df = tar_source.register(spark).read.format("tarshards").option("splitBytes", 512).load(f"file://{path}")
    assert df.rdd.getNumPartitions() == tar_source.TASKS and _got(df) == want
    huge = [tar_source.ByteRange("x", k * tar_source.TASK_BYTES, (k + 1) * tar_source.TASK_BYTES, 0) for k in range(3 * tar_source.TASKS)]
    assert [t.parts for t in tar_source.tasks(huge)] == [(p,) for p in huge]


def test_an_empty_folder_has_no_members(spark, tmp_path):
    assert tar_source.register(spark).read.format("tarshards").load(f"file://{tmp_path}").collect() == []
    assert tar_source.tasks([]) == []


def test_a_stream_reads_each_file_once(spark, shards, tmp_path_factory):
    path, want = shards
    out = tmp_path_factory.mktemp("stream")

    def drain():
        stream = tar_source.register(spark).readStream.format("tarshards").option("splitBytes", 4_000).load(f"file://{path}")
        stream.writeStream.format("parquet").option("path", f"file://{out}/rows").option("checkpointLocation", f"file://{out}/log").trigger(availableNow=True).start().awaitTermination()
        return _got(spark.read.schema(tar_source.SCHEMA).parquet(f"file://{out}/rows"))

    assert drain() == want
    assert drain() == want
    index = tar.write_shards(spark.createDataFrame([("later", "x", b"1"), ("later", "y", b"22")], "shard string, member string, content binary"), f"file://{path}")
    assert index.count() == 2
    assert drain() == want | {("later.tar", "x"): b"1", ("later.tar", "y"): b"22"}


def test_missing_options(spark):
    with pytest.raises(Exception, match="path"):
        tar_source.register(spark).read.format("tarshards").load().count()
    with pytest.raises(ValueError):
        tar_source._Settings({"path": "x", "splitBytes": "1"})
