"""Tar shards: an atomic writer that gives an index, and reads of members by place and size (``tar_source`` reads whole shards).

Members of a shard are written in name order by one task, streaming, so a shard may be of any size. The index is
(shard_path, member_name, offset, size), offset being where the member's content begins.
"""

from __future__ import annotations

import os
import tarfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import filesystem

_BLOCK = 512  # fixed value: tar pads members to blocks of this size


def write_shards(items: DataFrame, path: str) -> DataFrame:
    """Writes rows (shard string, member string, content binary) to path/<shard>.tar; the index is lazy, so act on it once."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = out = None
        offset, rows, temporary = 0, [], ""

        def close() -> pa.RecordBatch:
            system, place = filesystem(f"{path}/{shard}.tar")
            out.write(b"\0" * (2 * _BLOCK))
            out.close()
            system.move(temporary, place)  # readers see whole shards only
            names, at, sizes = zip(*rows, strict=True)
            uri = pa.array([f"{path}/{shard}.tar"] * len(rows), pa.string())
            return pa.RecordBatch.from_arrays([uri, pa.array(names, pa.string()), pa.array(at, pa.int64()), pa.array(sizes, pa.int64())], ["shard_path", "member_name", "offset", "size"])

        for batch in batches:
            for name, member, content in zip(*[batch.column(k) for k in range(3)], strict=True):
                name, member, content = name.as_py(), member.as_py(), content.as_py() or b""
                if name != shard:
                    if out is not None:
                        yield close()
                    shard, offset, rows = name, 0, []
                    system, place = filesystem(f"{path}/{shard}.tar")
                    system.create_dir(os.path.dirname(place), recursive=True)
                    temporary = f"{place}.{uuid.uuid4().hex}.part"
                    out = system.open_output_stream(temporary)
                info = tarfile.TarInfo(member)
                info.size = len(content)
                head = info.tobuf(tarfile.GNU_FORMAT)
                out.write(head + content + b"\0" * (-len(content) % _BLOCK))
                rows.append((member, offset + len(head), len(content)))
                offset += len(head) + len(content) + -len(content) % _BLOCK
        if out is not None:
            yield close()

    dealt = items.select("shard", "member", "content").repartition("shard").sortWithinPartitions("shard", "member")
    return dealt.mapInArrow(write, "shard_path string, member_name string, offset long, size long")


#: Contents of a batch of rows: at most so many bytes, or one member.
BATCH_BYTES = 16 << 20
_MEMBER = "member_name string, content binary"


class _Batches:
    """Rows (name, content), handed on whenever they hold so many bytes."""

    def __init__(self, batch_bytes: int):
        self.batch_bytes, self.names, self.contents, self.size = batch_bytes, [], [], 0

    def add(self, name: str, content: bytes) -> Iterator[pa.RecordBatch]:
        if self.names and self.size + len(content) > self.batch_bytes:
            yield from self.rest()
        self.names.append(name)
        self.contents.append(content)
        self.size += len(content)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.names:
            yield pa.RecordBatch.from_arrays([pa.array(self.names, pa.string()), pa.array(self.contents, pa.binary())], ["member_name", "content"])
        self.names, self.contents, self.size = [], [], 0


def read_members(index: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(member_name, content) of the rows of an index, by random access; a shard is opened once for rows that stand together."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, file, out = None, None, _Batches(batch_bytes)
        for batch in batches:
            for path, name, offset, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if path != shard:
                    system, place = filesystem(path)
                    shard, file = path, system.open_input_file(place)
                file.seek(offset)
                yield from out.add(name, file.read(size))
        yield from out.rest()

    rows = index.select("shard_path", "member_name", "offset", "size").sortWithinPartitions("shard_path", "offset")
    return rows.mapInArrow(read, _MEMBER)


def read_cached(index: DataFrame, cache_bytes: int = 256 << 20, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """As read_members, in the order of the rows: each task keeps the shards used last whole, up to cache_bytes together; larger ones are read by place."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[str, bytes] = OrderedDict()
        total, out = 0, _Batches(batch_bytes)
        for batch in batches:
            for path, name, offset, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if path in held:
                    held.move_to_end(path)
                else:
                    system, place = filesystem(path)
                    with system.open_input_file(place) as file:
                        if file.size() > cache_bytes:
                            file.seek(offset)
                            yield from out.add(name, file.read(size))
                            continue
                        held[path] = file.read()
                    total += len(held[path])
                    while total > cache_bytes:
                        total -= len(held.popitem(last=False)[1])
                yield from out.add(name, held[path][offset : offset + size])
        yield from out.rest()

    return index.select("shard_path", "member_name", "offset", "size").mapInArrow(read, _MEMBER)
