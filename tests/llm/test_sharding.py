"""Shards against a plain permutation, and its invariants."""

import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from frameloom.llm import sharding
from frameloom.llm.queries import queries

SF = "/root/testdata/sf0.001"


def _hash(seed, *values):
    out = 42
    for v in (seed, *values):
        out = xxhash.xxh64_intdigest(struct.pack("<q", v), out)
    return out - (1 << 64) if out >> 63 else out


def _place(x, n, seed=0):
    a, b = sharding.grid(n)
    while True:
        left, right = divmod(x, b)
        for k in range(sharding.ROUNDS):
            if k % 2 == 0:
                left = (left + _hash(seed, k, right) % a) % a
            else:
                right = (right + _hash(seed, k, left) % b) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 40, 41, 97, 1009, 5003])
def test_places_are_a_permutation_that_can_be_undone(spark, n):
    rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 5).alias("p"))
    back = rows.select("id", "p", sharding.row_of(F.col("p") % 7, F.floor(F.col("p") / 7), n, 7, 5).alias("back"))
    got = {r["id"]: (r["p"], r["back"]) for r in back.collect()}
    assert sorted(p for p, _ in got.values()) == list(range(n)) and all(b == i for i, (_, b) in got.items())
    assert all(got[i][0] == _place(i, n, 5) for i in range(0, n, max(1, n // 50)))


def test_a_slot_beyond_the_last_row_is_empty(spark):
    got = spark.range(1).select(*[sharding.row_of(F.lit(s), F.lit(t), 5, 3).alias(f"{s}{t}") for s in (0, 2) for t in (1, 2)]).first()
    assert got["01"] is not None and got["21"] is None and got["02"] is None


def test_grids_waste_little():
    for n in (1, 10, 999, 10**6 + 3, 10**12 + 39):
        a, b = sharding.grid(n)
        assert 0 <= a * b - n < max(1, a) and a <= b <= 4 * a + 4


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    n = len(docs)
    want = {}
    for i, r in enumerate(sorted(docs, key=lambda r: r["doc_id"])):
        raw, p = (r["text"] or "").encode(), _place(i, n)
        want[r["doc_id"]] = (len(raw) + 16, zlib.crc32(raw), "rows", p % 40, p // 40, None)
    got = queries()["op11_sharding"](spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == n


def test_hard_rows(spark):
    rows = [(None, None, 1), (None, None, 2), (3, "", 3), (3, "", 4), (2, "é" * 30_000, 5), (1, "a", 6), (1, "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    got = sharding.shard_documents(docs.repartition(5), 3).collect()
    assert Counter(r["shard"] for r in got) == {0: 3, 1: 2, 2: 2}
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(len([r for r in got if r["shard"] == s])))
    assert [r["row"] for r in got if r["doc_id"] is None and r["size"] == 16] and {r["row"] for r in got if r["doc_id"] is None} == {0, 1}
    assert {r["size"] for r in got if r["doc_id"] == 2} == {60_016}
    again = sharding.shard_documents(docs.coalesce(1), 3).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sharding.shard_documents(docs.where("false"), 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, 0)


def test_written_shards_hold_their_slots_in_order(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") * 3).alias("k"), F.lit("clash").alias("shard"))
    path = sharding.write_shards(sharding.shard_rows(rows, ["k"], 4), f"file://{tmp_path}/out", files=3)
    found = spark.read.parquet(path)
    assert sorted(r["k"] for r in found.collect()) == list(range(0, 1500, 3))
    for s in range(4):
        assert sorted(r["slot"] for r in found.where(F.col("shard") == s).collect()) == list(range(125))
