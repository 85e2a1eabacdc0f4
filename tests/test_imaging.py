"""Splats, clean-up, strokes, colours and resizing against plain loops."""

import colorsys
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import colour
from frameloom.operators import occlusion, resample, shapes


@pytest.mark.parametrize("to_left", [True, False])
def test_splat_equals_a_loop(spark, to_left):
    rng = np.random.default_rng(5)
    h, w = 6, 15
    d = np.round(rng.integers(0, 9, (h, w)) / 2, 1)  # halves and ties
    d[2, 3], d[4, 4] = np.nan, np.inf
    rows = [("k", y, x, None if (y, x) == (1, 1) else float(d[y, x]), float(10 * y + x)) for y in range(h) for x in range(w)]
    got = {(r["y"], r["x"]): (r["v"], r["from_x"], r["hole"]) for r in occlusion.splat(spark.createDataFrame(rows, "k string, y long, x long, d double, v double"), ["k"], "d", "v", to_left).collect()}
    want = {}
    for y in range(h):
        best = {}
        for x in range(w):
            if (y, x) != (1, 1) and np.isfinite(d[y, x]):
                t = math.floor(x + (-d[y, x] if to_left else d[y, x]) + 0.5)
                if t not in best or d[y, x] > best[t][0]:
                    best[t] = (d[y, x], x)
        for x in range(w):
            want[y, x] = (10.0 * y + best[x][1], best[x][1], False) if x in best else (None, None, True)
    assert got == want


def test_clean_up_equals_a_loop():
    rng = np.random.default_rng(1)

    def components(mask, least):
        out, seen = np.zeros_like(mask), set()
        for p in zip(*np.nonzero(mask), strict=True):
            if p in seen:
                continue
            found, todo = {p}, [p]
            while todo:
                y, x = todo.pop()
                for q in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if q not in found and 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q]:
                        found.add(q)
                        todo.append(q)
            seen |= found
            if len(found) >= least:
                for q in found:
                    out[q] = True
        return out

    def near(mask, y, x):
        return [mask[j, i] for j in range(max(0, y - 1), min(mask.shape[0], y + 2)) for i in range(max(0, x - 1), min(mask.shape[1], x + 2))]

    def each(mask, f):
        return np.array([[f(mask, y, x) for x in range(mask.shape[1])] for y in range(mask.shape[0])], bool)

    def summed(mask, y, x):
        at = lambda j, i: 0 <= j < mask.shape[0] and 0 <= i < mask.shape[1] and mask[j, i]
        return sum(occlusion.KERNEL[j + 1][i + 1] * at(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)) > 0.9

    for _ in range(5):
        holes = rng.random((20, 24)) > 0.93
        mask = components(each(each(holes, lambda m, y, x: any(near(m, y, x))), lambda m, y, x: any(near(m, y, x))), 30)
        for _ in range(4):
            mask = each(components(each(mask, summed), 12), lambda m, y, x: any(near(m, y, x)))
        assert (occlusion.clean(holes, 30, 12, 4) == mask).all()
    assert not occlusion.clean(np.zeros((5, 5))).any() and occlusion.clean(np.ones((20, 20))).any()


def test_strokes_equal_a_distance_test(spark):
    rng = np.random.default_rng(2)
    lines = [[(float(x), float(y)) for x, y in rng.uniform(-5, 35, (n, 2))] for n in (1, 2, 3, 8, 20)] + [[(4.3, 5.1), (4.3, 5.1)], [(2.2, 7.3), (20.2, 7.3)], [(9.1, -4.0), (9.1, 40.0)], []]
    widths = [3.1, 5.3, 0.7, 2.9, 4.4, 2.6, 3.3, 1.9, 2.0]
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(zip(lines, widths, strict=True))] + [(90, lines[1], None), (91, lines[1], -1.0)], "k long, points array<struct<x:double,y:double>>, width double")
    rows = shapes.rasterise(df, ["k"], "points", "width", (28, 30)).collect()
    got = {(r["k"], r["y"], r["x"]) for r in rows}
    assert len(got) == len(rows) and not {k for k, _, _ in got} & {8, 90, 91}
    for k, (points, width) in enumerate(zip(lines[:-1], widths, strict=False)):
        for y in range(28):
            for x in range(30):
                best = min(_distance(x + 0.5, y + 0.5, *a, *b) for a, b in zip(points, points[1:] or points, strict=False))
                if abs(best - width / 2) > 1e-9:
                    assert ((k, y, x) in got) == (best < width / 2), (k, y, x)


def test_strokes_of_one_key_on_a_wide_raster(spark):
    lines = [[(3.2, 2.1), (150.3, 2.1)], [(60.2, -3.0), (60.2, 9.0)], [(127.6, 4.2)], [(400.0, 2.0), (401.0, 2.0)]]
    df = spark.createDataFrame([(7 if i < 3 else 8, p, 3.3) for i, p in enumerate(lines)], "k long, points array<struct<x:double,y:double>>, width double")
    rows = shapes.rasterise(df, ["k"], "points", "width", (8, 130)).collect()
    want = {(7, y, x) for y in range(8) for x in range(130) if min(_distance(x + 0.5, y + 0.5, *p[0], *p[-1]) for p in lines[:3]) < 1.65}
    assert {(r["k"], r["y"], r["x"]) for r in rows} == want and len(rows) == len(want)


def test_strokes_move_no_pieces(spark):
    from frameloom.plans import QUERIES

    plan = QUERIES["stroke_masks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert "Sort" not in plan and "Window" not in plan and len(exchanges) == 1
    assert "Generate" not in plan[plan.index(exchanges[0]) :]  # parts are dealt, not what is made of them


def _distance(px, py, x0, y0, x1, y1):
    length = (x1 - x0) ** 2 + (y1 - y0) ** 2
    s = min(1, max(0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / length)) if length else 0
    return math.hypot(px - x0 - s * (x1 - x0), py - y0 - s * (y1 - y0))


def test_merged_intervals_do_not_touch(spark):
    rows = [("k", 0, 5.0, 7.0), ("k", 0, 1.0, 2.0), ("k", 0, 1.5, 3.0), ("k", 0, 3.0, 4.0), ("k", 0, 1.0, 1.2), ("k", 1, 0.0, 1.0)]
    got = shapes.merged(spark.createDataFrame(rows, "k string, y long, low double, high double"), ["k"]).collect()
    assert sorted((r["y"], r["low"], r["high"]) for r in got) == [(0, 1.0, 4.0), (0, 5.0, 7.0), (1, 0.0, 1.0)]


def test_hue_round_trip(spark):
    rng = np.random.default_rng(8)
    colours = [tuple(map(float, c)) for c in rng.random((300, 3))] + [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.5, 0.5, 0.5), (1.0, 0.0, 0.0), (0.0, 1.0, 1.0), (0.3, 0.3, 0.9), (0.9, 0.2, 0.9)]
    df = spark.createDataFrame(colours, "r double, g double, b double")
    p = colour.pixel(F.col("r"), F.col("g"), F.col("b"))
    for r in df.select("r", "g", "b", colour.to_hsv(p).alias("hsv"), colour.from_hsv(colour.to_hsv(p)).alias("back")).collect():
        assert tuple(r["hsv"]) == pytest.approx(colorsys.rgb_to_hsv(r["r"], r["g"], r["b"]), abs=1e-12)
        assert tuple(r["back"]) == pytest.approx((r["r"], r["g"], r["b"]), abs=1e-9)


def test_adjustments_leave_and_change_images(spark):
    image = F.array(*[colour.pixel(F.lit(a), F.lit(b), F.lit(c)) for a, b, c in ((0.2, 0.4, 0.9), (0.6, 0.6, 0.6), (1.0, 0.0, 0.1))])
    one = spark.range(1).select(image.alias("i"))
    same = one.select(*[colour.adjust(F.col("i"), k, F.lit(0.0 if k == "hue" else 1.0)).alias(k) for k in colour.KINDS]).first()
    plain = [tuple(p) for p in one.first()["i"]]
    for k in colour.KINDS:
        assert np.allclose([tuple(p) for p in same[k]], plain, atol=1e-12)
    grey = [0.299 * r + 0.587 * g + 0.114 * b for r, g, b in plain]
    none = one.select(*[colour.adjust(F.col("i"), k, F.lit(0.0)).alias(k) for k in colour.KINDS[:3]]).first()
    assert np.allclose([tuple(p) for p in none["brightness"]], 0) and np.allclose([tuple(p) for p in none["contrast"]], np.mean(grey)) and np.allclose([tuple(p) for p in none["saturation"]], np.array(grey)[:, None])
    assert spark.range(1).select(colour.adjust(F.array().cast("array<struct<r:double,g:double,b:double>>"), "contrast", F.lit(0.5)).alias("x")).first()["x"] == []
    with pytest.raises(ValueError):
        colour.adjust(image, "sharpness", F.lit(1.0))


def test_parameters_persist_and_do_not_depend_on_partitions(spark):
    df = spark.range(60).select((F.col("id") % 3).alias("clip"), F.floor(F.col("id") / 3).alias("call"))
    got = {}
    for n in (1, 7):
        rows = df.repartition(n).select("clip", "call", colour.jitter_parameters(F.col("clip"), F.col("call"), 4, 9, 0.5, 0.5, 0.5, 0.1).alias("p")).collect()
        got[n] = {(r["clip"], r["call"]): r["p"] for r in rows}
    assert got[1] == got[7]
    for (clip, call), p in got[1].items():
        assert p == got[1][clip, call // 4 * 4] and 0.5 <= p["brightness"] <= 1.5 and -0.1 <= p["hue"] <= 0.1 and 0 <= p["order"] < 24
    assert len(set(map(str, got[1].values()))) == 15
    with pytest.raises(ValueError):
        colour.jitter_parameters(F.lit(1), F.lit(1), 0, 1)


def test_white_light_needs_no_gain(spark):
    r = spark.range(1).select(colour.black_body_gains(F.lit(6500.0)).alias("w"), colour.black_body_gains(F.lit(3000.0)).alias("warm")).first()
    assert tuple(r["w"]) == pytest.approx((1, 1)) and r["warm"]["r"] > 1 > r["warm"]["b"]


@pytest.mark.parametrize("method", resample.METHODS)
def test_resizing_equals_a_brute_force_sum(spark, method):
    rng = np.random.default_rng(6)
    data = {k: rng.random(s) for k, s in {"a": (7, 5), "b": (3, 12), "c": (1, 1), "d": (6, 4)}.items()}
    rows = [(k, *a.shape, y, x, float(a[y, x])) for k, a in data.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    df = spark.createDataFrame(rows, "k string, h long, w long, y long, x long, v double")
    got = {}
    for r in resample.resize(df, ["k"], "h", "w", ["v"], (6, 4), method).collect():
        got.setdefault(r["k"], np.zeros((6, 4)))[r["y"], r["x"]] = r["v"]

    def weights(n, m):
        out = np.zeros((m, n))
        for i in range(m):
            c = (i + 0.5) * n / m - 0.5
            if method == "nearest":
                out[i, i * n // m] = 1
            elif method == "area":
                for k in range(n):
                    out[i, k] = max(0, min(k + 1, (i + 1) * n / m) - max(k, i * n / m)) / (n / m)
            else:
                for k in range(math.floor(c) - 1, math.floor(c) + 3):
                    d = abs(c - k)
                    a = resample.CUBIC
                    wt = max(0, 1 - d) if method == "linear" else (a + 2) * d**3 - (a + 3) * d**2 + 1 if d <= 1 else a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a if d < 2 else 0
                    out[i, min(max(k, 0), n - 1)] += wt
        return out

    for k, a in data.items():
        want = weights(a.shape[0], 6) @ a @ weights(a.shape[1], 4).T
        assert np.allclose(got[k], want, atol=1e-12)
    if method != "nearest":
        assert np.allclose(got["d"], data["d"])


def test_taps_sum_to_one_and_nulls_spread(spark):
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 3, 10, 37, None, 0)], "n long")
    for method in resample.METHODS:
        for r in resample.taps(sizes, "n", 7, method).groupBy("n", "out").agg(F.sum("weight").alias("s")).collect():
            assert r["s"] == pytest.approx(1)
    df = spark.createDataFrame([("k", 1, 4, 0, x, None if x == 3 else 1.0) for x in range(4)], "k string, h long, w long, y long, x long, v double")
    assert {r["x"]: r["v"] for r in resample.resize(df, ["k"], "h", "w", ["v"], (1, 2), "area").collect()} == {0: 1.0, 1: None}
    with pytest.raises(ValueError):
        resample.taps(sizes, "n", 7, "sharp")
