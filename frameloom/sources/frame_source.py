"""Frame datasets as data sources: a dataset says which sequences it has and how a frame is loaded, Spark plans the rest.

A subclass of ``FrameDataset`` gives three hooks: ``sequences`` (name and frame numbers of each sequence, without opening
files), ``load`` (the colour and depth files of a frame) and ``camera`` (focal length and width, or None). The driver cuts
the frames of sequences into ranges of at most ``framesPerTask``; a task loads its range and hands on rows in batches
bounded by bytes. Options besides: ``path``, ``batchBytes`` (16 MB), ``colourOnly`` (true skips depth files altogether).

Rows: scene, frame, rgb, depth (null if colourOnly), fx and width (null without a camera). A frame that cannot be loaded
ends the read, or is left out where ``skipErrors`` is true.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "scene string, frame bigint, rgb binary, depth binary, fx double, width double"
_ARROW = pa.schema([("scene", pa.string()), ("frame", pa.int64()), ("rgb", pa.binary()), ("depth", pa.binary()), ("fx", pa.float64()), ("width", pa.float64())])

# planners and workers need not find this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Frames(InputPartition):
    scene: str
    numbers: tuple[int, ...]


class FrameDataset(DataSource):
    """The hooks of a dataset; subclasses are registered with ``spark.dataSource.register``."""

    def sequences(self) -> Iterator[tuple[str, list[int]]]:
        raise NotImplementedError

    def load(self, scene: str, frame: int, depth: bool) -> tuple[bytes, bytes | None]:
        raise NotImplementedError

    def camera(self, scene: str, frame: int) -> tuple[float, float] | None:
        return None

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, dataset: FrameDataset):
        get = dataset.options.get
        self.dataset, self.per_task, self.batch = dataset, int(get("framesPerTask", 256)), int(get("batchBytes", 16 << 20))
        self.colour_only, self.skip = (str(get(k, "false")).lower() == "true" for k in ("colourOnly", "skipErrors"))
        if self.per_task < 1 or self.batch < 1:
            raise ValueError("framesPerTask and batchBytes have to be 1 at least")

    def partitions(self) -> list[Frames]:
        return [Frames(scene, tuple(numbers[i : i + self.per_task])) for scene, numbers in self.dataset.sequences() for i in range(0, len(numbers), self.per_task)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for frame in partition.numbers:
            try:
                rgb, depth = self.dataset.load(partition.scene, frame, not self.colour_only)
                fx, width = self.dataset.camera(partition.scene, frame) or (None, None)
            except OSError:
                if self.skip:
                    continue
                raise
            size += len(rgb) + len(depth or b"")
            rows.append((partition.scene, frame, rgb, depth, fx, width))
            if size >= self.batch:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class FolderFrames(FrameDataset):
    """Folders scene/rgb, scene/depth and scene/camera, whose files are named by the frame's number; a frame has both images, a camera or not."""

    @classmethod
    def name(cls) -> str:
        return "framefolders"

    def _system(self):
        from pyarrow import fs

        uri = self.options.get("path") or ""
        if not uri:
            raise ValueError("framefolders needs a path")
        if uri.startswith("file:"):
            return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
        return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)

    def sequences(self) -> Iterator[tuple[str, list[int]]]:
        from pyarrow import fs

        system, root = self._system()
        colour_only = str(self.options.get("colourOnly", "false")).lower() == "true"
        for scene in sorted(i.base_name for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory):
            kinds = ("rgb",) if colour_only else ("rgb", "depth")
            found = [{int(m[0]) for i in system.get_file_info(fs.FileSelector(f"{root}/{scene}/{kind}", allow_not_found=True)) if (m := re.match(r"\d+(?=\.)", i.base_name))} for kind in kinds]
            if numbers := sorted(set.intersection(*found)):
                yield scene, numbers

    def _read(self, *parts: str) -> bytes:
        system, root = self._system()
        with system.open_input_stream("/".join((root, *parts))) as f:
            return f.read()

    def load(self, scene: str, frame: int, depth: bool) -> tuple[bytes, bytes | None]:
        return self._read(scene, "rgb", f"{frame:08d}.png"), self._read(scene, "depth", f"{frame:08d}.dpt") if depth else None

    def camera(self, scene: str, frame: int) -> tuple[float, float] | None:
        try:
            meta = json.loads(self._read(scene, "camera", f"{frame:08d}.json"))
        except FileNotFoundError:
            return None
        return float(meta["fx"]), float(meta["width"])
