"""Token ids in binary shard files, and their reader.

Ids are ranked by frequency, so common ids take one byte, in a byte-aligned variable-length code with
separate control bytes: two bits per id give its length of 1 to 4 bytes. Reading looks the lengths
of four ids up per control byte in a numpy table, and ids in the block's rank table.

A shard: magic, then blocks (header of four u4: ids, ranks, control bytes, data bytes; rank table as
u4; control bytes; data bytes), then an index (doc ids as i8, their null flags as u1, ends as i8)
and a footer (number of documents, offset of the index, magic). A block holds at most ``block_ids``
ids with a rank table of its own, so a writer holds one block whatever the shard's size.

Defined results: a null or empty text is the end id alone; null ids sort first and are kept; repeated
rows are repeated documents, ties in text order; an empty table writes no shard and reads as empty.
Only the id and the text are read. Shards are named by range partition and renamed when whole, so a
repeated task writes the same file again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import filesystem, fresh_path, write_file
from .bpe import encoder

MAGIC = b"FLTOKEN1"
#: For each control byte the lengths of its four ids.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode_block(ids: np.ndarray) -> list[bytes]:
    """One block of the file format."""
    if len(ids) and ids.max() < 1 << 22:  # as many counters as ids, else a sort
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        counts = counts[values]
        index = ids
    else:
        values, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((values, -counts))
    rank = np.empty(int(values[-1]) + 1 if index is ids else len(order), np.uint32)
    rank[values[order] if index is ids else order] = np.arange(len(order), dtype=np.uint32)
    ranks = rank[index]
    size = (1 + (ranks > 0xFF) + (ranks > 0xFFFF).astype(np.uint8) + (ranks > 0xFFFFFF)).astype(np.uint8)
    codes = np.zeros(-len(ids) % 4 + len(ids), np.uint8)
    codes[: len(ids)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < size[:, None]]
    head = struct.pack("<4I", len(ids), len(order), len(control), len(data))
    return [head, values[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()]


def decode_block(table: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    ranks = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        ranks[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return table[ranks]


def shard_bytes(docs: Iterator[tuple[int | None, np.ndarray]], block_ids: int, summary: dict) -> Iterator[bytes]:
    """The bytes of a shard, block by block; summary gets its numbers of documents and ids."""
    names, nulls, ends, held, n_held, total, offset = [], [], [], [], 0, 0, len(MAGIC)
    yield MAGIC

    def blocks(last: bool) -> Iterator[bytes]:
        nonlocal held, n_held, offset
        if n_held >= block_ids or last and n_held:
            flat = np.concatenate(held)
            stop = len(flat) if last else len(flat) - len(flat) % block_ids
            for i in range(0, stop, block_ids):
                chunk = b"".join(encode_block(flat[i : min(i + block_ids, stop)]))
                offset += len(chunk)
                yield chunk
            held, n_held = [flat[stop:]], len(flat) - stop

    for name, ids in docs:
        held.append(ids)
        n_held += len(ids)
        total += len(ids)
        names.append(0 if name is None else name)
        nulls.append(name is None)
        ends.append(total)
        yield from blocks(False)
    yield from blocks(True)
    yield np.array(names, "<i8").tobytes() + np.array(nulls, np.uint8).tobytes() + np.array(ends, "<i8").tobytes()
    yield struct.pack("<qq", len(names), offset) + MAGIC
    summary |= {"n_docs": len(names), "n_tokens": total}


def read_shard(uri: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc id, its first id's place in the shard, ids) in file order; holds a block and a document at a time."""
    system, path = filesystem(uri)
    with system.open_input_file(path) as f:
        f.seek(f.size() - 16 - len(MAGIC))
        n, index = struct.unpack("<qq", f.read(16))
        if f.read() != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        f.seek(index)
        names, nulls, ends = np.frombuffer(f.read(8 * n), "<i8"), np.frombuffer(f.read(n), np.uint8), np.frombuffer(f.read(8 * n), "<i8")
        f.seek(len(MAGIC))
        held, have, start = [], 0, 0
        for name, null, end in zip(names.tolist(), nulls.tolist(), ends.tolist(), strict=True):
            while have < end - start:
                k, ranks, c, d = struct.unpack("<4I", f.read(16))
                table, control, data = np.frombuffer(f.read(4 * ranks), "<u4"), np.frombuffer(f.read(c), np.uint8), np.frombuffer(f.read(d), np.uint8)
                held.append(decode_block(table, control, data, k))
                have += k
            flat = held[0] if len(held) == 1 else np.concatenate(held)
            yield None if null else name, start, flat[: end - start]
            held, have, start = [flat[end - start :]], len(flat) - (end - start), end


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 20, shards: int | None = None, keep_words: bool = False) -> DataFrame:
    """Encodes whole texts, appends end_id to each and writes shards in ascending id order; returns (shard, uri, n_docs, n_tokens).

    The texts are dealt by id range once and encoded where their shard is written. With keep_words a worker's bounded
    caches serve its later tasks too, about half of whose distinct words they hold; else their memory is freed for later stages.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, first = encoder(tokenizer).encode, np.array([end_id], "<u4"), next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def rows() -> Iterator[tuple[int | None, np.ndarray]]:
            batch = first
            while batch is not None:
                for name, text in zip(batch.column(0), batch.column(1), strict=True):
                    yield name.as_py(), np.concatenate([encode(text.as_py() or ""), end])
                batch = next((b for b in batches if b.num_rows), None)

        shard, summary = first.column(2)[0].as_py(), {}
        uri = f"{path}/shard-{shard:06d}.tok"
        write_file(uri, shard_bytes(rows(), block_ids, summary))
        if not keep_words:
            encoder(tokenizer).forget()
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([uri]), pa.array([summary["n_docs"]], pa.int64()), pa.array([summary["n_tokens"]], pa.int64())], ["shard", "uri", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(*([shards] if shards else []), F.col("id").asc_nulls_first()).withColumn("shard", F.spark_partition_id())
    return dealt.sortWithinPartitions(F.col("id").asc_nulls_first(), "text").mapInArrow(write, "shard int, uri string, n_docs long, n_tokens long")


def read_token_files(spark: SparkSession, manifest: list[tuple[int, str, int]], id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the shards (shard, uri, n_tokens), a task per shard."""
    base, rows = 0, []
    for _, uri, n in sorted(manifest):
        rows.append((uri, base))
        base += n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch["uri"].to_pylist(), batch["base"].to_pylist(), strict=True):
                out: list[tuple] = []
                for name, at, ids in read_shard(uri):
                    out.append((name, start + at, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())))
                    if len(out) == 10_000:
                        yield _rows(out, id_col)
                        out = []
                if out:
                    yield _rows(out, id_col)

    listed = spark.createDataFrame(rows, "uri string, base long").repartition(max(1, len(rows))) if rows else spark.createDataFrame([], "uri string, base long")
    return listed.mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple], id_col: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [id_col, "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Writes the shards below the shared folder and reads them back. The driver holds a row per shard."""
    spark = docs.sparkSession
    written = write_token_files(docs, fresh_path(spark, "tokens"), tokenizer, end_id, id_col, text_col, **options).collect()
    return read_token_files(spark, [(r["shard"], r["uri"], r["n_tokens"]) for r in written], id_col)
