"""Tar shards as a data source, batch and stream: ``spark.read.format("tarshards").load(folder)``.

Files are listed by the driver and cut into ranges of bytes, which are dealt in order to tasks: to ``TASKS`` of them, or to
more where these would pass ``TASK_BYTES``, as a task costs far more than a small range. A task reads neighbouring ranges of
a file as one, and the members whose headers begin there: it
walks from header to header, reading no contents, to the first of them, from the start of the file or, where an index is
given, from the last header that the index knows before the range. Rows
come in batches bounded by bytes, so neither a shard nor a row count decides the memory; a member has to fit in a row.

Options: ``path`` (a folder or a .tar file), ``splitBytes`` (128 MB), ``batchBytes`` (16 MB), ``index`` (a Parquet table of
``tar.write_shards``; the driver keeps a number per range of it), ``contents`` (false leaves them null and unread) and, in a
stream, ``settleSeconds`` (0): files as young as this wait, so that files of one moment are listed together.

Rows: shard_path, member_name, offset (of the content), size, content. Only regular files are members; an empty folder and
an empty shard have none. A stream's offset is the last file by time and name; each file is read once.
"""

from __future__ import annotations

import sys
import tarfile
import time
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME, SCHEMA = "tarshards", "shard_path string, member_name string, offset bigint, size bigint, content binary"
_ARROW = pa.schema([("shard_path", pa.string()), ("member_name", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("content", pa.binary())])

#: Ranges are dealt to so many tasks, or to as many as hold so many bytes each.
TASKS, TASK_BYTES = 200, 128 << 20

# planners and workers need not find this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class ByteRange(InputPartition):
    """Members of a file whose headers begin in [start, stop); the walk begins at ``first``."""

    path: str
    start: int
    stop: int
    first: int


@dataclass(frozen=True)
class Task(InputPartition):
    """What a task reads, in order."""

    parts: tuple[ByteRange, ...]


def _place(uri: str):
    """(pyarrow filesystem, path in it, what precedes such paths in a uri)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/"), "file://"
    if "://" not in uri:
        return fs.LocalFileSystem(), uri, ""
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, uri[: uri.index(path)] if path in uri else uri.split("://")[0] + "://"


def list_shards(uri: str) -> list[tuple[int, str, int]]:
    """(time of change in ns, uri, size) of the shards, in this order."""
    from pyarrow import fs

    system, path, head = _place(uri)
    if path.endswith(".tar"):
        infos = [system.get_file_info(path)]
    else:
        infos = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((info.mtime_ns, head + info.path, info.size) for info in infos if info.type == fs.FileType.File and info.path.endswith(".tar"))


def indexed_ends(uri: str, split: int) -> dict[tuple[str, int], int]:
    """The last end of a member (where a header begins) in each range of each shard of an index: at most a number a range, whatever the number of members."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    system, path, _ = _place(uri)
    out: dict[tuple[str, int], int] = {}
    for batch in ds.dataset(path, filesystem=system, format="parquet").to_batches(columns=["shard_path", "offset", "size"]):
        blocks = pc.divide(pc.add(batch["size"], 511), 512)
        end = pc.add(batch["offset"], pc.multiply(blocks, 512))
        found = pa.table({"shard": batch["shard_path"], "k": pc.divide(end, split), "end": end}).group_by(["shard", "k"]).aggregate([("end", "max")])
        for shard, k, last in zip(*[found[c].to_pylist() for c in ("shard", "k", "end_max")], strict=True):
            out[shard, k] = max(last, out.get((shard, k), 0))
    return out


def ranges(files: list[tuple[int, str, int]], split: int, ends: dict[tuple[str, int], int]) -> list[ByteRange]:
    out = []
    for _, path, size in files:
        first = 0
        for k, start in enumerate(range(0, size, split)):
            first = max(first, ends.get((path, k - 1), 0))
            out.append(ByteRange(path, start, min(start + split, size), first))
    return out


def tasks(parts: list[ByteRange]) -> list[Task]:
    """The ranges dealt in order, neighbours of a file as one range."""
    n = min(len(parts), max(TASKS, -(-sum(p.stop - p.start for p in parts) // TASK_BYTES)))
    out = []
    for i in range(n):
        joined: list[ByteRange] = []
        for p in parts[i * len(parts) // n : (i + 1) * len(parts) // n]:
            if joined and joined[-1].path == p.path and joined[-1].stop == p.start:
                joined[-1] = replace(joined[-1], stop=p.stop)
            else:
                joined.append(p)
        out.append(Task(tuple(joined)))
    return out


def read_range(part: ByteRange, batch_bytes: int, contents: bool) -> Iterator[pa.RecordBatch]:
    """The rows of a range, in batches of at most batch_bytes of contents (one member at least)."""
    system, path, _ = _place(part.path)
    held: list[list] = [[], [], [], [], []]
    size = 0
    with system.open_input_file(path) as file:
        for name, header, offset, length in headers(file, part):
            if header >= part.stop:
                break
            if held[0] and size + length > batch_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(held, _ARROW, strict=True)], schema=_ARROW)
                held, size = [[], [], [], [], []], 0
            content = None
            if contents:
                file.seek(offset)
                content = file.read(length)
                if len(content) < length:
                    raise EOFError(f"{part.path} ends within {name}")
                size += length
            for column, value in zip(held, (part.path, name, offset, length, content), strict=True):
                column.append(value)
            if len(held[0]) == 10_000:
                size = batch_bytes
    if held[0]:
        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(held, _ARROW, strict=True)], schema=_ARROW)


def headers(file, part: ByteRange) -> Iterator[tuple[str, int, int, int]]:
    """(name, offset of the header, offset of the content, size) of the regular files from the range's start on."""
    file.seek(part.first)
    with tarfile.open(fileobj=file, mode="r:") as tar:
        while (member := tar.next()) is not None:
            tar.members = []  # else all headers are kept
            if member.isreg() and member.offset >= part.start:
                yield member.name, member.offset, member.offset_data, member.size


class _Settings:
    def __init__(self, options):
        self.path, self.index = options.get("path"), options.get("index")
        if not self.path:
            raise ValueError("tarshards needs a path")
        self.split, self.batch = int(options.get("splitBytes", 128 << 20)), int(options.get("batchBytes", 16 << 20))
        self.contents = str(options.get("contents", "true")).lower() == "true"
        self.settle = float(options.get("settleSeconds", 0))
        if self.split < 512 or self.batch < 1:
            raise ValueError("splitBytes has to be 512 at least and batchBytes 1")

    def plan(self, files: list[tuple[int, str, int]]) -> list[Task]:
        return tasks(ranges(files, self.split, indexed_ends(self.index, self.split) if self.index else {}))

    def read(self, task: Task | None) -> Iterator[pa.RecordBatch]:
        for part in task.parts if task else ():  # Spark asks for None where nothing is planned
            yield from read_range(part, self.batch, self.contents)


class TarShards(DataSource):
    """The source; register it with ``spark.dataSource.register`` or ``register``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(_Settings(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(_Settings(self.options))


class _Batch(DataSourceReader):
    def __init__(self, settings: _Settings):
        self.settings = settings

    def partitions(self) -> list[Task]:
        return self.settings.plan(list_shards(self.settings.path))

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return self.settings.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, settings: _Settings):
        self.settings = settings

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        young = time.time_ns() - int(self.settings.settle * 1e9)
        files = [f for f in list_shards(self.settings.path) if f[0] <= young]
        return {"changed": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Task]:
        low, high = ((o["changed"], o["path"]) for o in (start, end))
        return self.settings.plan([f for f in list_shards(self.settings.path) if low < f[:2] <= high])

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return self.settings.read(partition)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(TarShards)
    return spark
