"""Invariants and micro-fixtures of the operators."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameloom import functions as fn
from frameloom.operators import align, joins, metrics, reports, sampling, stats, windows
from frameloom.operators.ordering import numbered, running_total
from frameloom.plans import QUERIES


def _windows(spark, lengths, size, overlap, tail):
    df = spark.createDataFrame([(n,) for n in lengths], "n long").select("n", F.inline(windows.windows(F.col("n"), size, overlap, tail)))
    out = {n: [] for n in lengths}
    for r in df.collect():
        out[r["n"]].append((r["start"], r["end"]))
    return out


@pytest.mark.parametrize("tail", ["short", "snapped"])
def test_windows_cover_and_chain(spark, tail):
    for n, ws in _windows(spark, [1, 10, 81, 82, 100, 300], 81, 21, tail).items():
        ws.sort()
        assert ws[0][0] == 0 and ws[-1][1] == n
        assert all(b[0] <= a[1] - 21 for a, b in zip(ws, ws[1:]))
        if tail == "snapped":
            assert all(e - s == min(81, n) for s, e in ws)


@pytest.mark.parametrize("length,tile,overlap", [(100, 60, 20), (64, 64, 16), (50, 60, 20), (37, 32, 8), (640, 480, 100)])
def test_blending_a_constant_gives_the_constant(spark, length, tile, overlap):
    df = spark.range(length).select(F.col("id").alias("x")).select("x", F.inline(windows.windows(F.lit(length).cast("long"), tile, overlap))).where("x >= start AND x < end")
    df = df.withColumn("w", fn.ramp(F.col("x"), F.col("start"), F.col("end"), F.lit(length), overlap)).withColumn("v", F.lit(3.5))
    rows = align.blend(df, ["x"], "v", "w").collect()
    assert len(rows) == length and all(abs(r["v"] - 3.5) < 1e-12 for r in rows)


def test_windows_reject_a_too_large_overlap():
    with pytest.raises(ValueError):
        windows.windows(F.lit(3), 4, 4)


def test_affine_fit_recovers_and_degenerates(spark):
    rows = [("a", float(i), 1.2 * i - 3, True) for i in range(20)] + [("b", 2.0, float(i), True) for i in range(5)] + [("c", 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "k string, pred double, gt double, valid boolean")
    got = {r["k"]: (round(r["scale"], 9), round(r["shift"], 9)) for r in align.fit(df, ["k"]).collect()}
    assert got == {"a": (1.2, -3.0), "b": (1.0, 0.0), "c": (1.0, 0.0)}
    guarded = {r["k"]: (round(r["scale"], 9), round(r["shift"], 9)) for r in align.guarded_fit(df, ["k"]).collect()}
    assert guarded == {"a": (1.2, -3.0), "b": (1.0, 0.0), "c": (1.0, 0.0)}


def test_nearest_within_takes_the_earlier_and_is_strict(spark):
    left = spark.createDataFrame([("s", 1.0), ("s", 5.0), ("s", 9.0)], "k string, t double")
    right = spark.createDataFrame([("s", 0.5), ("s", 1.5), ("s", 7.0), ("s", 7.0)], "k string, t double")
    got = {r["t"]: r["match_t"] for r in joins.nearest_within(left, right, ["k"], "t", 2.0).collect()}
    assert got == {1.0: 0.5}


def test_packing_restarts_and_lets_a_large_item_stand_alone(spark):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate([5, 6, 30, 1, 9, 1])], "d string, i long, n long")
    assert [r["shard"] for r in sampling.pack(df, "d", ["i"], "n", 10).orderBy("i").collect()] == [0, 1, 2, 3, 3, 4]


@pytest.mark.parametrize("n", [1, 3, 4, 5])
def test_quartiles_are_index_picks(spark, n):
    df = spark.createDataFrame([("s", float(i)) for i in range(n)], "s string, v double")
    r = stats.index_quartiles(df, "s", "v").first()
    assert (r["p25"], r["median"], r["p75"]) == (n // 4, n // 2, 3 * n // 4)


def test_top_n_keeps_input_order_of_ties(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(5)], "i long, v double")
    assert [(r["rank"], r["i"]) for r in reports.top_n(df, F.col("v"), "i").orderBy("rank").collect()] == [(1, 0), (2, 1), (3, 2)]


def test_percentile_normaliser_planes_and_flat_range(spark):
    df = spark.createDataFrame([(0.0, 1.0, 2.0), (10.0, 1.0, 2.0), (3.0, 1.0, 2.0), (1.5, 1.0, 1.0), (1.0, 1.0, 1.0), (5.0, None, None)], "d double, lo double, hi double")
    got = [r[0] for r in df.select(fn.normalise_percentile(F.col("d"), F.col("lo"), F.col("hi"), 0.0, 10.0)).collect()]
    assert got == [-1.0, 1.0, 3.0, 1.0, -1.0, 0.0]


def test_metrics_leave_out_empty_frames(spark):
    rows = [(0, 0, 0, 0, 2.0, 1.0, True), (0, 1, 0, 0, 2.0, 0.0, False)]
    r = metrics.summary(spark.createDataFrame(rows, "scene long, frame long, y long, x long, pred double, gt double, valid boolean")).first()
    assert r["abs_rel"] == 1.0 and r["n_empty_frames"] == 1


def test_stitch_query_equals_a_plain_loop(spark):
    from frameloom.plans import QUERIES
    from frameloom.sources.views import frames

    sf = "/root/testdata/sf0.001"
    got = {}
    for r in QUERIES["window_stitch"](spark, sf).collect():
        got.setdefault(r["scene"], {})[r["pos"]] = r["value"]
    scenes = {}
    for r in frames(spark, sf).orderBy("scene", "frame_idx").collect():
        scenes.setdefault(r["scene"], []).append(r["depth"])
    for scene, depth in scenes.items():
        n, at, canvas, reached = len(depth), 0, [], 0
        starts = [0]
        while starts[-1] + 21 < n:
            starts.append(min(starts[-1] + 16, n - 21))
        for i, s in enumerate(starts):
            e = min(s + 21, n)
            w = np.array(depth[s:e]) * (1 + i * 0.05) + i
            if i:
                o = reached - s
                ref, cur = np.array(canvas[-o:]), w[:o]
                a, b = np.linalg.lstsq(np.stack([cur, np.ones(o)], 1), ref, rcond=None)[0]
                w = np.maximum(w * min(max(a, 0.7), 1.5) + b, 0)
                t = np.linspace(0, 1, o)
                canvas[-o:] = (1 - t) * ref + t * w[:o]
                canvas += list(w[o:])
            else:
                canvas = list(w)
            reached = e
        assert len(got[scene]) == n and max(abs(got[scene][i] - v) for i, v in enumerate(canvas)) < 1e-4


@settings(max_examples=50, deadline=None)
@given(st.floats(-0.5, 1.5))
def test_curve_is_monotone_and_hits_its_ends(x):
    from frameloom.functions.depth import lut_value

    xs, ys = fn.curve_points("medium", 64)
    assert ys[0] == 0 and abs(ys[-1] - 1) < 1e-12 and all(b >= a for a, b in zip(xs, xs[1:]))
    if 0 <= x <= 1:
        assert -1e-9 <= lut_value(x, xs, ys) <= 1 + 1e-9


def test_natural_key(spark):
    df = spark.createDataFrame([("f10",), ("f2",), ("f2a",)], "s string")
    assert [r["s"] for r in df.orderBy(fn.natural_key(F.col("s"))).collect()] == ["f2", "f2a", "f10"]


@pytest.mark.parametrize("low,high", [(1, 3), (2, 2)])
def test_strided_clips_fit(spark, low, high):
    scenes = spark.createDataFrame([(i, 30) for i in range(40)], "s long, n long")
    for r in sampling.strided_clips(scenes, "s", "n", 6, low, high).collect():
        steps = np.diff(r["clip"])
        assert r["clip"][0] >= 0 and r["clip"][-1] < 30 and set(steps) <= set(range(low, max(high, low + 1)))


def test_running_totals_in_many_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(None if i % 17 == 0 else f"s{int(x)}", int(y), i) for i, (x, y) in enumerate(zip(rng.integers(0, 9, 400), rng.integers(-50, 50, 400)))]
    df = spark.createDataFrame(rows, "s string, k long, i long").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    want, total = {}, 0
    for place, r in enumerate(order, 1):
        total += r[2]
        want[r[2]] = (place, total)
    for size in (7, 60, 0):
        place = numbered(df, ["s", "k", "i"], "place", size)
        got = running_total(place, ["s", "k", "i"], F.col("i"), "total", size).collect()
        assert {r["i"]: (r["place"], r["total"]) for r in got} == want
    assert numbered(df.where("false"), ["s"], "place").count() == 0


def test_windows_at_a_place_are_those_that_hold_it(spark):
    rows = [(n, p) for n in (1, 5, 20, 21, 22, 37, 38, 100) for p in range(n)]
    df = spark.createDataFrame(rows, "n long, p long").select("n", "p", windows.windows(F.col("n"), 21, 5).alias("every"), windows.windows_at(F.col("p"), F.col("n"), 21, 5).alias("here"))
    for r in df.collect():
        assert [tuple(w) for w in r["here"]] == [(i, *w) for i, w in enumerate(r["every"]) if w["start"] <= r["p"] < w["end"]]


def test_a_zero_depth_has_no_disparity(spark, tmp_path):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(10 * s + i, at + datetime.timedelta(seconds=i), s, "view", v, '{"k": 1}') for s in (3, 4, 5) for i, v in enumerate([0.0, 2.0, 4.0, 8.0])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["scene"], r["frame_idx"]): r["n"] for r in QUERIES["norm_type_switch"](spark, str(tmp_path)).collect()}
    assert got[3, 0] == got[4, 0] == 0.0 and got[3, 1] == pytest.approx(1, abs=1e-4) and got[3, 3] == 0.0


@pytest.mark.parametrize("name", ["high", "medium", "low"])
def test_curves_equal_a_search(spark, name):
    xs, ys = fn.curve_points(name)
    at = [-0.5, 0.0, 1e-9, 0.1, 0.5, xs[500], 0.999, 1.0, 1.5]
    got = [r["y"] for r in spark.createDataFrame([(x,) for x in at], "x double").select(fn.lut(F.col("x"), xs, ys).alias("y")).collect()]
    assert got == pytest.approx(list(np.interp(at, xs, ys)), abs=1e-9)


def test_stitching_streams_and_keeps_two_windows():
    rng = np.random.default_rng(2)
    stitcher, canvas, got, held = align.Stitcher(), np.empty(0), {}, 0
    for i in range(400):
        start, values = i * 16, rng.random(21) + i % 3
        if i:
            ref, cur = canvas[-5:], values[:5]
            a, b = np.linalg.lstsq(np.stack([cur, np.ones(5)], 1), ref, rcond=None)[0]
            aligned, t = np.maximum(values * np.clip(a, 0.7, 1.5) + b, 0), np.linspace(0, 1, 5)
            canvas = np.concatenate([canvas[:-5], (1 - t) * ref + t * aligned[:5], aligned[5:]])
        else:
            canvas = values
        first, final = stitcher.add(start, start + 21, values)
        got.update(enumerate(final, first))
        held = max(held, len(stitcher.tail))
    got.update(enumerate(stitcher.rest()[1], stitcher.done - 21))
    assert held == 21 and sorted(got) == list(range(len(canvas))) and max(abs(got[i] - v) for i, v in enumerate(canvas)) < 1e-6


def test_stitching_of_gaps_scales_and_disorder(spark):
    rows = [("a", 0, 2, 0, 1.0), ("a", 0, 2, 1, 2.0), ("a", 2, 4, 2, 5.0), ("a", 2, 4, 3, -1.0), (None, 0, 1, 0, 3.0), ("b", 0, 3, 0, 1.0), ("b", 0, 3, 1, 2.0), ("b", 0, 3, 2, 4.0), ("b", 1, 4, 1, 4.0), ("b", 1, 4, 2, 8.0), ("b", 1, 4, 3, 2.0)]
    df = spark.createDataFrame(rows, "k string, start long, end long, pos long, value double")
    got = {}
    for r in align.stitch(df, "k", scale_only=True).collect():
        got.setdefault(r["k"], {})[r["pos"]] = round(r["value"], 5)
    assert got["a"] == {0: 1.0, 1: 2.0, 2: 5.0, 3: -1.0} and got[None] == {0: 3.0}
    assert got["b"] == {0: 1.0, 1: 2.0, 2: 5.6, 3: 1.4}
    assert align.stitch(df.where("false"), "k").count() == 0
    with pytest.raises(ValueError):
        s = align.Stitcher()
        s.add(0, 10, np.ones(10))
        s.add(2, 5, np.ones(3))
