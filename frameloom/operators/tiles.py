"""Rasters larger than a row, as a row per tile, with borders exchanged between neighbours.

A raster is cut on a regular grid: tile (ty, tx) begins at (ty, tx) times the tile's size, and the last of a row or column
may be smaller. A function that looks ``radius`` pixels around needs borders of its neighbours: each tile sends them the
strips that they need (halo exchange, one shuffle of strips and tiles), so no task ever holds more than a batch of padded
tiles, and results at seams equal those of the whole raster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Arrays = dict[str, np.ndarray]


def cut(pixels: DataFrame, by: list[str], values: list[str], size: int) -> DataFrame:
    """(by..., ty, tx, h, w, values...) from a row per pixel (by..., y, x, values...); values become row-major arrays of doubles.

    Every raster is a full rectangle from (0, 0); a null value becomes NaN.
    """
    if size < 1:
        raise ValueError("a tile has to hold a pixel")
    place = {"ty": F.floor(F.col("y") / size).cast("int"), "tx": F.floor(F.col("x") / size).cast("int")}
    each = F.struct("y", "x", *[F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias(v) for v in values])
    tiles = pixels.withColumns(place).groupBy(*by, "ty", "tx").agg(F.array_sort(F.collect_list(each)).alias("p"))  # size * size pixels at most
    each = lambda c: F.transform("p", lambda p: p[c])
    extent = lambda c: (F.array_max(each(c)) - F.array_min(each(c)) + 1).cast("int")
    return tiles.select(*by, "ty", "tx", extent("y").alias("h"), extent("x").alias("w"), *[each(v).alias(v) for v in values])


def uncut(tiles: DataFrame, by: list[str], values: list[str], size: int) -> DataFrame:
    """The inverse of cut: (by..., y, x, values...)."""
    zipped = tiles.select(*by, "ty", "tx", "w", F.posexplode(F.arrays_zip(*values)).alias("at", "p"))
    return zipped.select(*by, (F.col("ty") * size + F.floor(F.col("at") / F.col("w"))).cast("long").alias("y"), (F.col("tx") * size + F.col("at") % F.col("w")).cast("long").alias("x"), *[F.col(f"p.`{v}`").alias(v) for v in values])


@dataclass(frozen=True)
class TileFunction:
    """A function of batches of padded tiles that declares what it reads, what it gives and how far it looks.

    ``run`` gets arrays (n, h + 2 radius, w + 2 radius) of its inputs, all of one shape, and returns arrays (n, h, w) of its
    outputs. Beyond the raster, pixels repeat the nearest one (``edge``) or are ``fill``.
    """

    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    run: Callable[[Arrays], Arrays]
    radius: int = 0
    fill: float | None = None
    batch: int = 16
    keep: tuple[str, ...] = field(default=())

    def checked(self, arrays: Arrays, n: int, h: int, w: int) -> Arrays:
        out = self.run(arrays)
        if set(out) != set(self.outputs):
            raise ValueError(f"the function declared {sorted(self.outputs)} and gave {sorted(out)}")
        for name, a in out.items():
            if np.shape(a) != (n, h, w):
                raise ValueError(f"{name} has the shape {np.shape(a)} instead of {(n, h, w)}")
        return out


def map_tiles(tiles: DataFrame, by: list[str], f: TileFunction, size: int) -> DataFrame:
    """(by..., ty, tx, h, w, kept columns, outputs) of every tile."""
    if missing := [c for c in (*f.inputs, *f.keep) if c not in tiles.columns]:
        raise ValueError(f"the tiles have no columns {missing}")
    if not 0 <= f.radius <= size:
        raise ValueError("the radius must not exceed the tile's size")
    keys = [*by, "ty", "tx"]
    kept = [*f.keep, *[c for c in f.inputs if c not in f.keep]]
    types = {x.name: x.dataType.simpleString() for x in tiles.schema.fields}
    rows = tiles.select(*keys, "h", "w", *kept)
    if f.radius:
        strips = rows.mapInArrow(_sender(keys, f, size), ", ".join([*[f"`{k}` {types[k]}" for k in keys], "h int", "w int", *[f"`{c}` {types[c]}" for c in kept], "oy int", "ox int", "sh int", "sw int"]))
        rows = strips.repartition(*keys).sortWithinPartitions(*keys, "oy", "ox")
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "h int", "w int", *[f"`{c}` {types[c]}" for c in f.keep], *[f"`{c}` array<double>" for c in f.outputs]])
    return rows.mapInArrow(_receiver(keys, f, size), schema)


def _sender(keys: list[str], f: TileFunction, size: int) -> Callable:
    """Each tile, and for each neighbour the strip of it that lies within the neighbour's padding, at (oy, ox) of the neighbour."""
    r = f.radius
    double = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w = batch["h"].to_numpy(), batch["w"].to_numpy()
            ty, tx = batch["ty"].to_numpy(), batch["tx"].to_numpy()
            columns = {c: batch[c] for c in f.inputs}
            take, places, strips = [], [], {c: [] for c in f.inputs}
            for i in range(batch.num_rows):
                arrays = {c: np.asarray(columns[c][i].values.to_numpy(zero_copy_only=False)).reshape(h[i], w[i]) for c in f.inputs}
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if ty[i] + dy < 0 or tx[i] + dx < 0:
                            continue
                        rows = slice(max(0, h[i] - r), h[i]) if dy == 1 else slice(0, min(r, h[i])) if dy == -1 else slice(0, h[i])
                        cols = slice(max(0, w[i] - r), w[i]) if dx == 1 else slice(0, min(r, w[i])) if dx == -1 else slice(0, w[i])
                        # where the strip's first pixel stands, counted from the first pixel of the neighbour
                        take.append(i)
                        places.append((ty[i] + dy, tx[i] + dx, rows.start - dy * size, cols.start - dx * size, rows.stop - rows.start, cols.stop - cols.start))
                        for c in f.inputs:
                            strips[c].append(arrays[c][rows, cols].reshape(-1))
            at = pa.array(take, pa.int64())
            cols = [np.array(v, np.int32) for v in zip(*places, strict=True)] if places else [np.empty(0, np.int32)] * 6
            own = (cols[2] == 0) & (cols[3] == 0) & (cols[0] == ty[take]) & (cols[1] == tx[take]) if places else np.empty(0, bool)
            out = {}
            for k in keys:
                out[k] = pa.array(cols[0]) if k == "ty" else pa.array(cols[1]) if k == "tx" else batch[k].take(at)
            # only the tile itself carries its size and what is kept
            mask = pa.array(~own)
            null = lambda a: pa.compute.if_else(mask, pa.nulls(len(mask), a.type), a)  # noqa: E731, B023
            out["h"], out["w"] = null(batch["h"].take(at)), null(batch["w"].take(at))
            for c in (*f.keep, *[c for c in f.inputs if c not in f.keep]):
                out[c] = pa.array(strips[c], double) if c in f.inputs else null(batch[c].take(at))
            yield pa.RecordBatch.from_arrays([*out.values(), *map(pa.array, cols[2:])], [*out, "oy", "ox", "sh", "sw"])

    return run


def _receiver(keys: list[str], f: TileFunction, size: int) -> Callable:
    """Pads tiles by what came for them, runs the function on batches of equal shape and cuts its outputs to rows."""
    r = f.radius
    double = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list[tuple[dict, Arrays]]] = {}

        def flush(shape: tuple[int, int]) -> pa.RecordBatch:
            rows = waiting.pop(shape)
            (h, w), n = shape, len(rows)
            out = f.checked({c: np.stack([a[c] for _, a in rows]) for c in f.inputs}, n, h, w)
            columns = {k: pa.array([row[k].as_py() for row, _ in rows], rows[0][0][k].type) for k in (*keys, *f.keep)}
            sizes = {"h": pa.array([h] * n, pa.int32()), "w": pa.array([w] * n, pa.int32())}
            made = {c: pa.array(list(np.ascontiguousarray(out[c], float).reshape(n, -1)), double) for c in f.outputs}
            names = [*keys, "h", "w", *f.keep, *f.outputs]
            return pa.RecordBatch.from_arrays([{**columns, **sizes, **made}[c] for c in names], names)

        def add(parts: list[dict]) -> Iterator[pa.RecordBatch]:
            own = next((p for p in parts if p["h"].is_valid), None)
            if own is None:  # strips sent beyond the raster
                return
            h, w = own["h"].as_py(), own["w"].as_py()
            low_y, low_x = (min(p[c].as_py() for p in parts) for c in ("oy", "ox")) if r else (0, 0)
            high_y, high_x = (max(p[c].as_py() + p[s].as_py() for p in parts) for c, s in (("oy", "sh"), ("ox", "sw"))) if r else (h, w)
            arrays = {}
            for c in f.inputs:
                known = np.zeros((high_y - low_y, high_x - low_x))
                for p in parts:
                    values = p[c].values.to_numpy(zero_copy_only=False)
                    if r:
                        y, x, sh, sw = (p[k].as_py() for k in ("oy", "ox", "sh", "sw"))
                        known[y - low_y : y - low_y + sh, x - low_x : x - low_x + sw] = values.reshape(sh, sw)
                    else:
                        known[:] = values.reshape(h, w)
                pad = ((r + low_y, h + r - high_y), (r + low_x, w + r - high_x))
                arrays[c] = np.pad(known, pad, mode="edge") if f.fill is None else np.pad(known, pad, constant_values=f.fill)
            waiting.setdefault((h, w), []).append((own, arrays))
            if len(waiting[h, w]) == f.batch:
                yield flush((h, w))

        key, parts = None, []
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i] for j, c in enumerate(names)}
                found = tuple(row[k].as_py() for k in keys)
                if found != key and parts:
                    yield from add(parts)
                    parts = []
                key = found
                parts.append(row)
        if parts:
            yield from add(parts)
        for shape in list(waiting):
            yield flush(shape)

    return run


def shifted(a: np.ndarray, radius: int, dy: int, dx: int) -> np.ndarray:
    """Of padded tiles (n, h + 2 radius, w + 2 radius), each pixel's neighbour at (dy, dx)."""
    h, w = a.shape[1] - 2 * radius, a.shape[2] - 2 * radius
    return a[:, radius + dy : radius + dy + h, radius + dx : radius + dx + w]
