"""Tiles that exchange borders against whole rasters, and the Poisson solve against a dense one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import poisson, tiles


def _table(spark, rasters):
    rows = [(k, y, x, float(a[y, x])) for k, a in rasters.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "k string, y long, x long, v double").repartition(3)


def _arrays(df, value, shapes):
    out = {k: np.full(s, np.inf) for k, s in shapes.items()}
    for r in df.collect():
        assert out[r["k"]][r["y"], r["x"]] == np.inf
        out[r["k"]][r["y"], r["x"]] = r[value]
    assert all((a != np.inf).all() for a in out.values())
    return out


@pytest.fixture(scope="module")
def rasters():
    rng = np.random.default_rng(7)
    return {k: rng.random(s) for k, s in {"a": (23, 17), "b": (5, 31), "c": (1, 1), "d": (10, 10), "e": (11, 6)}.items()}


def test_cut_and_uncut(spark, rasters):
    cut = tiles.cut(_table(spark, rasters), ["k"], ["v"], 5)
    assert {(r["h"], r["w"]) for r in cut.where("k = 'a' AND ty = 4 AND tx = 3").collect()} == {(3, 2)}
    back = _arrays(tiles.uncut(cut, ["k"], ["v"], 5), "v", {k: a.shape for k, a in rasters.items()})
    assert all((back[k] == a).all() for k, a in rasters.items())
    assert tiles.cut(_table(spark, rasters).where("false"), ["k"], ["v"], 5).count() == 0


@pytest.mark.parametrize("size,radius,fill", [(5, 1, None), (5, 2, 0.0), (4, 4, None), (7, 3, -1.0), (64, 2, None), (3, 0, None)])
def test_every_seam_equals_the_whole_raster(spark, rasters, size, radius, fill):
    weights = np.random.default_rng(1).random((2 * radius + 1, 2 * radius + 1))

    def run(a):
        near = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]
        return {"s": sum(weights[dy + radius, dx + radius] * tiles.shifted(a["v"], radius, dy, dx) for dy, dx in near), "top": np.max([tiles.shifted(a["v"], radius, dy, dx) for dy, dx in near], axis=0)}

    f = tiles.TileFunction(("v",), ("s", "top"), run, radius, fill, batch=3, keep=("v",))
    out = tiles.uncut(tiles.map_tiles(tiles.cut(_table(spark, rasters), ["k"], ["v"], size), ["k"], f, size), ["k"], ["s", "top", "v"], size)
    shapes = {k: a.shape for k, a in rasters.items()}
    got = {c: _arrays(out, c, shapes) for c in ("s", "top", "v")}
    for k, a in rasters.items():
        padded = np.pad(a, radius, mode="edge") if fill is None else np.pad(a, radius, constant_values=fill)
        want = run({"v": padded[None]})
        assert np.allclose(got["s"][k], want["s"][0], rtol=1e-12) and (got["top"][k] == want["top"][0]).all() and (got["v"][k] == a).all()


def test_declared_columns_and_shapes_are_checked(spark, rasters):
    cut = tiles.cut(_table(spark, rasters), ["k"], ["v"], 5)
    with pytest.raises(ValueError, match="no columns"):
        tiles.map_tiles(cut, ["k"], tiles.TileFunction(("z",), ("v",), lambda a: a), 5)
    with pytest.raises(ValueError, match="radius"):
        tiles.map_tiles(cut, ["k"], tiles.TileFunction(("v",), ("v",), lambda a: a, 6), 5)
    with pytest.raises(Exception, match="declared"):
        tiles.map_tiles(cut, ["k"], tiles.TileFunction(("v",), ("z",), lambda a: a), 5).collect()
    with pytest.raises(Exception, match="shape"):
        tiles.map_tiles(cut, ["k"], tiles.TileFunction(("v",), ("v",), lambda a: a, 1), 5).collect()


def test_the_local_solve():
    rng = np.random.default_rng(0)
    x, right, free = rng.random((3, 8, 6)), rng.random((3, 8, 6)), rng.random((3, 8, 6)) > 0.3
    free[:, [0, -1]] = free[:, :, [0, -1]] = False
    free[2] = False
    got = poisson.solve_inside(x, free, right, 1e-11)
    inner = free[:, 1:-1, 1:-1]
    assert np.abs(poisson.laplacian(got) - right[:, 1:-1, 1:-1])[inner].max() <= 1e-10 and (got[~free] == x[~free]).all()


@pytest.mark.parametrize("overlap", [0, 2])
def test_poisson_equals_a_dense_solve(spark, overlap):
    rng = np.random.default_rng(3)
    shapes = {"a": (14, 9), "b": (6, 6), "none": (4, 4)}
    data = {k: (rng.random(s), rng.random(s), (rng.random(s) > 0.3) & (k != "none")) for k, s in shapes.items()}
    data["b"][1][3, 3] = np.nan
    rows = [(k, y, x, float(s[y, x]), float(t[y, x]), float(m[y, x])) for k, (s, t, m) in data.items() for y in range(s.shape[0]) for x in range(s.shape[1])]
    df = spark.createDataFrame(rows, "k string, y long, x long, source double, target double, mask double")
    out, log = poisson.blend(tiles.cut(df, ["k"], ["source", "target", "mask"], 5), ["k"], 5, overlap, tolerance=1e-10)
    got = {c: _arrays(tiles.uncut(out, ["k"], ["inside", "blended"], 5), c, shapes) for c in ("inside", "blended")}
    for k, (s, t, m) in data.items():
        h, w = s.shape
        inside = np.zeros((h, w), bool)
        for y in range(1, h - 1):
            for x in range(1, w - 1):
                inside[y, x] = m[y, x] and not np.isnan([t[y, x], t[y - 1, x], t[y + 1, x], t[y, x - 1], t[y, x + 1]]).any()
        assert (got["inside"][k] == inside).all()
        at = {p: i for i, p in enumerate(zip(*np.nonzero(inside), strict=True))}
        a, b = np.zeros((len(at), len(at))), np.zeros(len(at))
        for (y, x), i in at.items():
            a[i, i] = 4
            b[i] = 4 * s[y, x]
            for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                b[i] -= s[q]
                if q in at:
                    a[i, at[q]] = -1
                else:
                    b[i] += t[q]
        want = t.copy()
        want[inside] = np.linalg.solve(a, b) if at else []
        assert np.allclose(got["blended"][k], want, atol=1e-8, equal_nan=True)
    steps = log.where("k = 'a'").orderBy("sweep").collect()
    assert steps[0]["residual"] > 1e-3 and steps[-1]["residual"] <= 1e-10 and [r["sweep"] for r in steps] == list(range(len(steps)))
    with pytest.raises(ArithmeticError):
        poisson.blend(tiles.cut(df, ["k"], ["source", "target", "mask"], 5), ["k"], 5, 1, tolerance=1e-10, max_sweeps=1)
