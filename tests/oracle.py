"""Compares a Spark query with its SQL in DuckDB, as sets of rows with multiplicity."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _row(values):
    return tuple(f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else v for v in values)


def assert_same(df, con, sql):
    names = sorted(df.columns)
    mine = Counter(_row(r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    theirs = Counter(_row([r[i] for i in at]) for r in found.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
