"""Whitening against a dense eigendecomposition and exact sums."""

import numpy as np
import pytest

from frameloom.llm import whitening
from frameloom.llm.queries import queries

SF = "/root/testdata/sf0.01"


def _exact(vectors):
    return {tuple(int(np.floor(256 * float(c))) for c in v) for v in vectors}


def _check(rows, kept, k):
    fit = np.array(sorted(_exact(kept.values())), float)
    mean = fit.mean(axis=0)
    e, v = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    e, v = e[::-1], v[:, ::-1]
    sums = [int(s) for s in fit.sum(axis=0)]
    assert len(rows) == len(kept) * k
    signs = {}
    for r in rows:
        c, x = r["component"] - 1, np.floor(256 * np.array(kept[r["vec_id"]], float))
        want = (x - mean) @ v[:, c] / np.sqrt(e[c])
        sign = signs.setdefault(c, np.sign(want * r["whitened"])) if abs(want) > 0.1 else signs.get(c, 1)
        if abs(want) > 0.1:
            assert r["whitened"] == pytest.approx(sign * want, rel=1e-6)
        assert r["n"] == len(fit) and r["deviation"] == sum((len(fit) * int(a) - s) ** 2 for a, s in zip(x, sums))
        assert r["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-9) and 0 <= r["identity_error"] < 1e-9


def test_query_equals_a_dense_eigendecomposition(spark):
    kept = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])}
    _check(queries()["op12_whitening"](spark, SF).collect(), kept, 4)


def test_restarts_reach_the_same_components(spark):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((400, 40)) * np.linspace(1, 3, 40)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    rows = whitening.quantised(df)
    found = whitening.fit_components(rows, 3, block=4, basis=12)
    fit = np.floor(256 * data)
    e, v = np.linalg.eigh(np.cov(fit.T, bias=True))
    assert found.passes > 3 and np.allclose(found.values, e[::-1][:3], rtol=1e-11)
    assert np.allclose(np.abs(np.sum(found.vectors * v[:, ::-1][:, :3], axis=0)), 1, atol=1e-9)
    assert (found.residuals <= 1e-13 * found.values[0]).all()


def test_rows_left_out_and_rank(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0], "a"), (2, [-1.0, 0.0, 0.0], "b"), (2, [-1.0, 0.0, 0.0], "c"), (None, [0.5, 0.0, 0.0], "d"), (4, None, "e"), (5, [1.0, None, 0.0], "f"), (6, [nan, 0.0, 0.0], "g"), (7, [inf, 0.0, 0.0], "h"), (8, [1.0], "i"), (9, [], "j"), (10, [1e30, 0.0, 0.0], "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")
    got = whitening.whitened_embeddings(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (1, 1), (2, 1), (2, 1)]
    assert {r["n"] for r in got} == {3} and all(r["explained"] == pytest.approx(1) for r in got)
    assert {r["deviation"] for r in got if r["vec_id"] == 1} == {(3 * 256 - 128) ** 2}


def test_nothing_to_whiten(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    for df in (empty, one):
        got = whitening.whitened_embeddings(df)
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_a_long(spark):
    x = np.array([[2**40, 0], [-(2**40), 1]])
    centred, squares = whitening._deviations(x, 2, (0, 1))
    assert squares == [None, None] and centred.tolist() == [[2.0**40, -0.5], [-(2.0**40), 0.5]]
    assert whitening._deviations(np.array([[3, 4]]), 2, (1, 1))[1] == [25 + 49]
