"""Binary raster formats: pure bytes-to-array functions, and DataFrame readers and writers around them.

Values of formats are fixed by their definitions: the float tag, sizes as little-endian int32, row-major data.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import images

TAG = 202021.25  # fixed value: begins depth, flow and camera files


def _tagged(content: bytes) -> bytes:
    if struct.unpack_from("<f", content)[0] != TAG:
        raise ValueError("wrong tag")
    return content[4:]


def decode_depth(content: bytes) -> np.ndarray:
    body = _tagged(content)
    w, h = struct.unpack_from("<2i", body)
    return np.frombuffer(body, "<f4", w * h, 8).reshape(h, w)


def encode_depth(a: np.ndarray) -> bytes:
    return struct.pack("<f2i", TAG, a.shape[1], a.shape[0]) + a.astype("<f4").tobytes()


def decode_flow(content: bytes) -> np.ndarray:
    body = _tagged(content)
    w, h = struct.unpack_from("<2i", body)
    return np.frombuffer(body, "<f4", w * h * 2, 8).reshape(h, w, 2)


def encode_flow(a: np.ndarray) -> bytes:
    return struct.pack("<f2i", TAG, a.shape[1], a.shape[0]) + a.astype("<f4").tobytes()


def decode_camera(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = np.frombuffer(_tagged(content), "<f8", 21)
    return body[:9].reshape(3, 3), body[9:].reshape(3, 4)


def encode_camera(intrinsic: np.ndarray, extrinsic: np.ndarray) -> bytes:
    return struct.pack("<f", TAG) + intrinsic.astype("<f8").tobytes() + extrinsic.astype("<f8").tobytes()


def decode_pfm(content: bytes) -> np.ndarray:
    """Rows stand bottom up; a negative scale means little-endian."""
    kind, size, scale, data = content.split(b"\n", 3)
    w, h = map(int, size.split())
    channels = {b"Pf": 1, b"PF": 3}[kind.strip()]
    a = np.frombuffer(data, "<f4" if float(scale) < 0 else ">f4", w * h * channels).reshape(h, w, channels)[::-1]
    return a[:, :, 0] if channels == 1 else a


def encode_pfm(a: np.ndarray) -> bytes:
    kind = "Pf" if a.ndim == 2 else "PF"
    return f"{kind}\n{a.shape[1]} {a.shape[0]}\n-1.0\n".encode() + np.ascontiguousarray(a[::-1]).astype("<f4").tobytes()


def decode_raw(content: bytes, h: int, w: int) -> np.ndarray:
    """A bare float32 blob; infinite means missing and becomes 0."""
    a = np.frombuffer(content, "<f4").reshape(h, w).copy()
    a[np.isinf(a)] = 0
    return a


def raw_codec(h: int, w: int) -> tuple[Callable, Callable]:
    return lambda a: a.astype("<f4").tobytes(), lambda content: decode_raw(content, h, w)


#: Codecs of any (h, w) array of floats.
CODECS: dict[str, tuple[Callable, Callable]] = {"dpt": (encode_depth, decode_depth), "pfm": (encode_pfm, decode_pfm)}
#: Codecs of (h, w) arrays of a kind: flow has its two components side by side, a camera is a row of 21 numbers, millimetres and pixels are stored as integers.
PARTICULAR: dict[str, tuple[Callable, Callable]] = {
    "flo": (lambda a: encode_flow(a.reshape(len(a), -1, 2)), lambda content: (f := decode_flow(content)).reshape(len(f), -1)),
    "cam": (lambda a: encode_camera(a.reshape(-1)[:9], a.reshape(-1)[9:21]), lambda content: np.concatenate([m.reshape(-1) for m in decode_camera(content)])[None]),
    "npz": (lambda a: images.encode_npz(depth=np.floor(a * 1000 + 0.5).astype(np.uint16)), lambda content: images.decode_npz(content, "depth") / 1000.0),
    "npy": (images.encode_npy, images.decode_npy),
    "png8": (lambda a: images.encode_png(np.floor(a * 255 + 0.5).astype(np.uint8)), lambda content: images.decode_png(content).astype(float)),
    "png16": (lambda a: images.encode_png(np.floor(a * 65535 + 0.5).astype(np.uint16)), lambda content: images.decode_png(content).astype(float)),
    "unit_png": (lambda a: images.encode_png(np.floor(a * 255 + 0.5).astype(np.uint8)), lambda content: images.unit_image(images.decode_png(content))),
}


def _named(codec: str) -> tuple[Callable, Callable]:
    return CODECS[codec] if codec in CODECS else PARTICULAR[codec]


def unpack_disparity(r: Column, g: Column, b: Column) -> Column:
    """Disparity from the three bytes of a packed image."""
    return r * 4.0 + g / 64.0 + b / 16384.0


def unpack_segment(r: Column, g: Column, b: Column) -> Column:
    """Segment number from the three bytes of a packed image."""
    return (r * 256 + g) * 256 + b


def decoded(files: DataFrame, codec: str | tuple[Callable, Callable], content: str = "content") -> DataFrame:
    """Adds h, w, values (array<double>) to rows with binary content; content that does not decode gives nulls."""
    decode, names = (_named(codec) if isinstance(codec, str) else codec)[1], files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ws, values = [], [], []
            for raw in batch.column(names.index(content)):
                try:
                    a = decode(raw.as_py())
                    h, w, v = *a.shape[:2], a.astype(np.float64).reshape(-1)
                except (ValueError, KeyError, TypeError, struct.error):
                    h = w = v = None
                hs.append(h)
                ws.append(w)
                values.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hs, pa.int64()), pa.array(ws, pa.int64()), pa.array(values, pa.list_(pa.float64()))], [*names, "h", "w", "values"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{schema}, h long, w long, values array<double>").drop(content)


def encoded(rasters: DataFrame, codec: str | tuple[Callable, Callable], h: int, w: int, values: str = "values") -> DataFrame:
    """Replaces the values by ``content``, the file's bytes."""
    encode, names = (_named(codec) if isinstance(codec, str) else codec)[0], rasters.columns
    others = [c for c in names if c != values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [None if v.as_py() is None else encode(np.array(v.as_py()).reshape(h, w)) for v in batch.column(names.index(values))]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in others], pa.array(content, pa.binary())], [*others, "content"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.schema.fields if f.name != values)
    return rasters.mapInArrow(run, f"{schema}, content binary")


def read_files(spark: SparkSession, path: str, codec: str, glob: str = "*") -> DataFrame:
    """(path, h, w, values) of the raster files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return decoded(files.select("path", "content"), codec)
