"""The registry of queries and their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with equivalent SQL where SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as engines add in different orders."""
    from pyspark.sql import functions as F

    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


#: The hash of keyed_hash in SQL; {k} is the text to hash.
HASH = "CAST('0x' || substr(md5({k}), 1, 8) AS BIGINT)"


def h(*parts: str) -> str:
    return HASH.format(k=" || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts))
