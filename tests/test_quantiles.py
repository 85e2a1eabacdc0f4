"""Exact quantiles against numpy and DuckDB, with few values held."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameloom.operators.quantiles import exact_quantiles

QS = [0.0, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]


def _data():
    rng = np.random.default_rng(4)
    groups = {
        "normal": rng.normal(0, 1, 3_000), "spread": np.exp(rng.normal(0, 60, 2_000)) * rng.choice([-1, 1], 2_000), "one value": np.full(1_500, 2.5), "two values": rng.choice([1.0, 1.0 + 2**-52], 999),
        "tiny": rng.integers(-40, 40, 900) * 5e-324, "geometric": 2.0 ** -np.arange(1_000), "huge": rng.uniform(-1, 1, 800) * 1.7e308, "infinite": np.r_[rng.normal(0, 1, 500), [np.inf] * 90, [-np.inf] * 20], "single": np.array([7.0]), "zeros": np.r_[np.zeros(300), -np.zeros(200), rng.normal(0, 1e-9, 100)],
    }
    return [(g, float(v)) for g, vs in groups.items() for v in vs]


@pytest.mark.parametrize("held,bins", [(1, 16), (50, 64), (100_000, 1_024)])
def test_quantiles_equal_sql_bit_by_bit(spark, held, bins):
    rows = _data()
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "v"])).repartition(5)
    got = {r["g"]: (r["n"], r["q"]) for r in exact_quantiles(df, ["g"], F.col("v"), QS, held, bins).collect()}
    frame = pd.DataFrame(rows, columns=["g", "v"])
    for g, part in frame.groupby("g"):
        values = np.sort(part["v"].to_numpy())
        want = []
        for q in QS:
            at = (len(values) - 1) * q
            low, high = values[math.floor(at)], values[math.ceil(at)]
            want.append(low if low == high else low + (high - low) * (at - math.floor(at)))
        assert got[g] == (len(values), pytest.approx(want, rel=0, abs=0, nan_ok=True)), g
    con = duckdb.connect()
    for g in ("normal", "spread", "geometric", "two values"):
        part = frame[frame["g"] == g]  # noqa: F841
        assert got[g][1] == list(con.execute(f"SELECT quantile_cont(v, {QS}) FROM part").fetchone()[0])


def test_null_keys_values_and_no_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([(None, 1, 1.0), (None, 1, 3.0), ("a", 1, None), ("b", None, 2.0), ("c", 1, nan), ("c", 1, 1.0), ("c", 1, 2.0)], "g string, h int, v double")
    got = {(r["g"], r["h"]): (r["n"], r["q"]) for r in exact_quantiles(df, ["g", "h"], F.col("v"), [0.5], held=1).collect()}
    assert got == {(None, 1): (2, [2.0]), ("a", 1): (0, None), ("b", None): (1, [2.0]), ("c", 1): (3, [2.0])}
    assert exact_quantiles(df.where("false"), ["g"], F.col("v"), [0.5]).count() == 0
    top = exact_quantiles(df, ["g"], F.col("v"), [1.0], held=1).where("g = 'c'").first()["q"][0]
    assert math.isnan(top)
    with pytest.raises(ValueError):
        exact_quantiles(df, ["g"], F.col("v"), [1.5])


def test_one_group_of_all_rows(spark):
    df = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("v"))
    got = exact_quantiles(df, [], F.col("v"), [0.25, 0.5], held=100).first()
    values = df.toPandas()["v"].to_numpy()
    assert got["n"] == 20_000 and got["q"] == np.quantile(values, [0.25, 0.5]).tolist()
    assert exact_quantiles(df.where("false"), [], F.col("v"), [0.5]).first()["q"] is None
