"""Principal components and whitened coordinates of embeddings, by passes of products over centred rows.

Entries become whole numbers (floor of 256 times the entry), so counts, sums and squared deviations are exact. The fit list
holds each distinct vector once and is written once. A pass over it computes X'(XQ) / n for a block Q of directions, in
tasks that hold a batch of rows and a block; the covariance is never formed. The driver orthogonalises (QR) what the pass
adds, and a Rayleigh-Ritz step over the subspace of this pass and those before gives the best components within it; where
it has ``basis`` directions, the leading ones alone are kept. Passes end once the residuals |V q - e q| of all components
are below ``tolerance`` times the largest eigenvalue.

Defined results: rows whose vector is null, or holds null, NaN or infinite entries, or entries of 2^53 steps or more, where doubles skip whole numbers, are left out, and so are
rows of another length than most (of equally frequent lengths the longest stays). Repeated rows and null ids are kept.
Directions without variance are no components, so vectors of rank r give r at most; no rows, or one distinct vector, give
no rows. A squared deviation beyond a long is null. Components of equal eigenvalues are any basis of their space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

#: Steps of a unit, and the largest eigenvalue's share below which a direction counts as rounding.
STEPS, NO_VARIANCE = 256, 1e-12


@dataclass(frozen=True)
class Components:
    """What whitening needs: exact moments of the fit list, and its leading components."""

    n: int
    sums: tuple[int, ...]
    trace: float
    vectors: np.ndarray  # a column for each component
    values: np.ndarray
    residuals: np.ndarray
    passes: int
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): the rows whose vectors have finite entries, as whole numbers."""
    steps = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * STEPS))
    bad = F.exists(F.col(vector_col), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) * STEPS >= 2.0**53))
    return vectors.where(F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).alias("id"), steps.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _moments(fit: DataFrame, d: int) -> tuple[int, list[int], list[int]]:
    """(n, sums, sums of squares) of each dimension, exact; the driver gets a row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, [0] * d, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            if len(x) and max(int(x.max()), -int(x.min())) ** 2 * len(x) >= 1 << 62:
                x = x.astype(object)
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0), strict=True)]
            squares = [a + int(b) for a, b in zip(squares, (x * x).sum(axis=0), strict=True)]
        if n:
            text = lambda v: pa.array([str(i) for i in v])
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), text(sums), text(squares)], ["i", "n", "s", "q"])

    parts = fit.mapInArrow(run, "i int, n long, s string, q string")
    summed = parts.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "sq"]).collect()
    rows = sorted(summed, key=lambda r: r["i"])
    return (rows[0]["n"], [int(r["s"]) for r in rows], [int(r["q"]) for r in rows]) if rows else (0, [], [])


def _summed_products(fit: DataFrame, mean: np.ndarray, right: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
    """The sum over rows of (row' left)' (row' right), left being the identity if None; the driver gets that matrix alone."""
    d, height, width = len(mean), len(mean) if left is None else left.shape[1], right.shape[1]
    names = [f"y{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((height, width)), False
        for batch in batches:
            rows = _matrix(batch.column(0), d).astype(float) - mean
            total += (rows if left is None else rows @ left).T @ (rows @ right)
            seen = seen or len(rows) > 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), *map(pa.array, total.T)], ["i", *names])

    sums = fit.mapInArrow(run, ", ".join(["i int", *[f"{c} double" for c in names]])).groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()
    out = np.zeros((height, width))
    for r in sums:
        out[r["i"]] = r[1:]
    return out


def _fresh(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block adds to the basis."""
    for _ in range(2):  # the second time removes what rounding left of the basis
        block = block - basis @ (basis.T @ block)
        sizes = np.linalg.norm(block, axis=0)
        block = block[:, sizes > 0] / sizes[sizes > 0]
    if not block.shape[1] or basis.shape[1] >= len(basis):
        return np.zeros((len(basis), 0))
    q, r = np.linalg.qr(block)
    q = q[:, np.abs(np.diag(r)) > 1e-8][:, : len(basis) - basis.shape[1]]
    q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def fit_components(rows: DataFrame, k: int = 4, block: int = 16, basis: int = 128, tolerance: float = 1e-13, max_passes: int = 500, seed: int = 12) -> Components | None:
    """The k leading components of the distinct vectors x of rows (id, x); None where there is no variance."""
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes or sizes[0]["d"] < 1:
        return None
    d = sizes[0]["d"]
    fit = materialize(rows.where(F.size("x") == d).select("x").distinct(), "fit")
    n, sums, squares = _moments(fit, d)
    trace = float(sum(Fraction(q, n) - Fraction(s, n) ** 2 for s, q in zip(sums, squares, strict=True)))
    if trace <= 0:
        return None
    mean = np.array([float(Fraction(s, n)) for s in sums])
    k, block = min(k, d), min(d, max(block, k))
    space, image = np.zeros((d, 0)), np.zeros((d, 0))
    new, passes = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, block)))[0], 0
    while True:
        passes += 1
        space, image = np.hstack([space, new]), np.hstack([image, _summed_products(fit, mean, new) / n])
        inner = space.T @ image
        values, ways = np.linalg.eigh((inner + inner.T) / 2)
        values, ways = values[::-1], ways[:, ::-1]
        vectors, images = space @ ways, image @ ways
        residuals = np.linalg.norm(images[:, :k] - vectors[:, :k] * values[:k], axis=0)
        if (residuals <= tolerance * values[0]).all():
            break
        if space.shape[1] + block > max(basis, 3 * block):
            space, image = vectors[:, : 2 * block], images[:, : 2 * block]
        new = _fresh(images[:, :block] - vectors[:, :block] * values[:block], space)
        if not new.shape[1]:
            if space.shape[1] < d:
                new = _fresh(np.random.default_rng(seed + passes).standard_normal((d, block)), space)
            elif (residuals <= 1e3 * tolerance * values[0]).all():
                break  # the whole space is searched, and what is left is rounding
        if passes >= max_passes or not new.shape[1]:
            raise ArithmeticError(f"residuals {residuals} after {passes} passes")
    some = int((values[:k] > NO_VARIANCE * values[0]).sum())
    values, vectors = values[:some].copy(), np.linalg.qr(vectors[:, :some])[0]
    scaled = vectors / np.sqrt(values)
    error = float(np.abs(_summed_products(fit, mean, scaled, scaled) / n - np.eye(some)).max())
    return Components(n, tuple(sums), trace, vectors, values, residuals[:some], passes, error)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, list[int | None]]:
    """((n x - S) / n, sum over dimensions of (n x - S)^2), the latter exact."""
    bound = n * max(int(x.max()), -int(x.min())) + max(map(abs, sums)) if len(x) else 0
    small = bound * bound * x.shape[1] < 1 << 63
    exact = (x if small else x.astype(object)) * n - np.array(sums, np.int64 if small else object)
    squares = (exact * exact).sum(axis=1)
    return np.array(exact / n, float), squares.tolist() if small else [s if s < 1 << 63 else None for s in squares]


def whiten(rows: DataFrame, found: Components | None, id_col: str = "vec_id") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row (id, x) and component, numbered from 1."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    d, n, k = len(found.sums), found.n, len(found.values)
    scaled, shares = (found.vectors / np.sqrt(found.values)).T.copy(), found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            centred, squares = _deviations(_matrix(batch.column(1), d), n, found.sums)
            # element by element, so equal rows get equal values wherever they stand
            whitened = np.stack([(centred * way).sum(axis=1) for way in scaled], axis=1)
            take = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(squares, pa.int64()).take(take),
                pa.array(whitened.reshape(-1)), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, found.identity_error)),
            ], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == d).mapInArrow(run, schema)


def whitened_embeddings(vectors: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fits the components and whitens every row by them."""
    rows = quantised(vectors, id_col, vector_col)
    return whiten(rows, fit_components(rows, k), id_col)
