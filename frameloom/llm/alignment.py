"""Alignment of two tokenizers: which tokens of one overlap which of the other, and how often in the corpus.

Both sides encode a space and the text, so their tokens cover the same bytes. Offsets where tokens of both sides end cut
them into groups, and a stretch between neighbouring ends of either side is a link of the one token of each side that holds
it. Texts whose tokens do not give their bytes back have no tokens.

Documents are encoded once, in chunks, and each distinct word of a chunk is aligned once, into a written table of document rows, link blocks and pre-aggregated pair counts.
First-side ids are dealt to stripes by remainder, so frequent ids, which stand together, spread. The counts of a stripe meet
in a dense matrix (its ids by the other side's), where ``np.add.at`` adds them and row maxima give the best partners; where
the counts of a stripe are many, parts of them are added first. Links are then scored beside their stripe's matrix: a
stripe with many links is split, by chunks, over as many tasks as its counted links need. Scores of a document meet by chunk.

Defined results: a null or empty text, and one that either side does not give back byte by byte, has no tokens: all numbers
are 0 and groups_sha256 is ''. Repeated rows and null ids are documents of their own; an empty table gives an empty table;
only the id and the text are read. Strings of special tokens in a text are plain text.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize
from .bpe import _BYTE_LETTERS, _splits_as_assumed

#: First-side ids are dealt to so many stripes; a matrix has (ids / STRIPES) x (ids of the other side) long counts.
STRIPES = 197
#: Bytes of text and documents of a chunk; pair counts held by a task before it passes them on.
CHUNK_BYTES, DOC_BITS, HELD_PAIRS = 1 << 20, 15, 1 << 21
CHUNK_DOCS = 1 << DOC_BITS
#: Words whose alignments a worker process keeps.
MAX_WORDS = 600_000
#: Counts added by one task, and links scored by one.
TASK_CELLS, TASK_LINKS = 1 << 25, 1 << 24


#: How a byte-level tokenizer file splits texts into pieces, which merges never leave.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A byte-level tokenizer file, whose tokens are taken of a space and the text; they always give its bytes back.

    Its merges are replayed by rank, so it has to rank tokens by their ids, as such files do.
    """

    def __init__(self, path: str):
        import tiktoken

        settings = json.loads(Path(path).read_text())
        if not _splits_as_assumed(settings):
            raise ValueError("the tokens of this file are not byte-level, so their bytes are not known from their ids")
        vocab, merges = settings["model"]["vocab"], settings["model"]["merges"]
        added = {t["content"] for t in settings.get("added_tokens", [])}
        byte_of = {letter: b for b, letter in _BYTE_LETTERS.items()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        if merged != sorted(merged) or len(set(merged)) < len(merged) or any(bytes([b]) not in ranks for b in range(256)) or len(ranks) != 256 + len(merges):
            raise ValueError("the merges of this file are not in the order of their ids")
        self.tokens = [b""] * (1 + max(vocab.values()))
        for token, i in ranks.items():
            self.tokens[i] = token
        self.encode_one = tiktoken.Encoding(Path(path).name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encode_one(" " + text) for text in texts]


class Pieces:
    """A sentencepiece model, which adds the space itself; its pieces may not give a text's bytes back."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces) or self.model.normalize("  a  ") != "▁▁▁a▁▁":
            raise ValueError("pieces of this model go on behind the end of a word, or it changes white space")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Sides:
    """Both tokenizers, with what chunks need of them."""

    def __init__(self, first: str, second: str, stripes: int):
        self.a, self.b = (Pieces(p) if p.endswith(".model") else ByteLevel(p) for p in (first, second))
        self.n_a, self.n_b, self.stripes = len(self.a.tokens), len(self.b.tokens), stripes
        self.cells = -(-self.n_a // stripes) * self.n_b  # of a stripe
        self.bits = (self.cells - 1).bit_length()
        if self.bits > 32 or self.bits + DOC_BITS + stripes.bit_length() > 63:
            raise ValueError("too many ids for a stripe: take more stripes")
        ids = np.arange(self.n_a, dtype=np.int64)
        #: the part of a key that a first-side id decides
        self.places = (ids % stripes << self.bits + DOC_BITS) + ids // stripes * self.n_b
        self.lengths_a, self.lengths_b = (np.array([len(t) for t in side.tokens], np.int32) for side in (self.a, self.b))
        #: an id and what follows it: a comma, or the end of its side of a group
        shown = [f"{i}{end}" for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for i in range(n) for end in ends]
        if max(map(len, shown)) > 8:
            raise ValueError("ids have seven digits at most")
        self.shown, self.widths = np.array(shown, "S8").view("<u8"), np.array([len(x) for x in shown], np.int8)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both sides of each text; none where either does not give its bytes back."""
        wanted = [b" " + text.encode() for text in texts]
        sides = []
        for side in (self.a, self.b):
            ids = side.encode(texts)
            if b"".join(map(side.tokens.__getitem__, chain.from_iterable(ids))) != b"".join(wanted):
                sides.append([x if b"".join(map(side.tokens.__getitem__, x)) == want else [] for x, want in zip(ids, wanted, strict=True)])
            else:
                sides.append(ids)
        return tuple([x if y and z else [] for x, y, z in zip(side, *sides, strict=True)] for side in sides)


@dataclass
class Aligned:
    """What links the tokens of some texts: numbers of each, its groups as text behind each other, and its links in order."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    shown: list[bytes]
    links: np.ndarray  # places of first-side ids plus second-side ids
    first: np.ndarray  # where each text's links begin

    @classmethod
    def none(cls) -> Aligned:
        zero = np.zeros(0, np.int64)
        return cls(zero, zero, zero, [], zero, zero)

    def __add__(self, more: Aligned) -> Aligned:
        both = [np.concatenate(pair) for pair in ((self.n_a, more.n_a), (self.n_b, more.n_b), (self.n_links, more.n_links), (self.links, more.links), (self.first, more.first + len(self.links)))]
        return Aligned(*both[:3], self.shown + more.shown, *both[3:])


def align(of: Sides, texts: list[str]) -> Aligned:
    """The alignment of each text by itself."""
    encoded = of.encode(texts)
    n_a, n_b = (np.fromiter(map(len, side), np.int64, len(texts)) for side in encoded)
    ids_a, ids_b = (np.fromiter(chain.from_iterable(side), np.int32, int(n.sum())) for side, n in zip(encoded, (n_a, n_b), strict=True))
    ends_a, ends_b = np.cumsum(of.lengths_a[ids_a]), np.cumsum(of.lengths_b[ids_b])  # both sides of a text have the same bytes
    size = int(ends_a[-1]) if len(ends_a) else 0
    at_a, at_b = np.zeros(size + 1, np.int8), np.zeros(size + 1, np.int8)
    at_a[ends_a], at_b[ends_b] = 1, 1
    either, both = at_a | at_b, at_a & at_b
    cuts = np.flatnonzero(either)  # the ends of the links
    # before each end, as many ends of its side as tokens stand before; a text ends where both sides do
    linked_a, linked_b = (ids[np.cumsum(at[cuts], dtype=np.int64) - at[cuts]] for at, ids in ((at_a, ids_a), (at_b, ids_b)))
    n_links = np.diff(np.searchsorted(cuts, np.append(0, ends_a)[np.cumsum(n_a)], "right"), prepend=0)

    # in the order of groups, first sides before second ones: a side's tokens are those up to the group's end
    closes_a, closes_b = both[ends_a], both[ends_b]
    group_a, group_b = np.cumsum(closes_a, dtype=np.int64) - closes_a, np.cumsum(closes_b, dtype=np.int64) - closes_b
    upto_a, upto_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
    codes = np.empty(len(ids_a) + len(ids_b), np.int32)
    codes[np.arange(len(ids_a)) + np.append(0, upto_b)[group_a]] = ids_a * 2 + closes_a
    codes[np.arange(len(ids_b)) + upto_a[group_b] if size else []] = (ids_b + of.n_a) * 2 + closes_b
    text = of.shown[codes].tobytes().translate(None, b"\0")  # eight bytes for each token, zeros behind it
    upto = np.append(0, np.cumsum(of.widths[codes], dtype=np.int64))[np.append(0, np.cumsum(n_a + n_b))].tolist()
    shown = [text[start:stop] for start, stop in zip(upto, upto[1:], strict=False)]
    return Aligned(n_a, n_b, n_links, shown, of.places[linked_a] + linked_b, np.cumsum(n_links) - n_links)


class Words:
    """Alignments of words, each made once.

    Neither side's tokens cross a single space between two other characters, so the alignment of a text is that of its words,
    each with the space before it, one behind the other. A text with other spaces is aligned whole.
    """

    def __init__(self, of: Sides):
        self.of, self.index, self.known = of, {}, Aligned.none()

    def chunk(self, texts: list[str | None]) -> tuple[dict[str, object], np.ndarray, np.ndarray]:
        """(numbers of each text, sorted keys of its linked id pairs, how often each is linked).

        A key has, from its upper bits down, the stripe, DOC_BITS of the text's place and ``bits`` of the cell, which is
        (id // stripes) * n_b + id of the other side.
        """
        if len(self.index) > MAX_WORDS:
            self.index, self.known = {}, Aligned.none()
        collecting = gc.isenabled()
        gc.disable()  # millions of small lists and no cycles
        try:
            split = [text.split(" ") if text else [] for text in texts]
            new = set(chain.from_iterable(split)).difference(self.index)
            new = [word for word in new if word and not word[0].isspace() and not word[-1].isspace()]
            self.known += align(self.of, new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            places, whole = [], []
            for text, words in zip(texts, split, strict=True):
                try:
                    places.append(list(map(self.index.__getitem__, words)))
                except KeyError:
                    places.append([len(self.index) + len(whole)])
                    whole.append(text)
            known = self.known + align(self.of, whole) if whole else self.known
            return self._joined(known, places)
        finally:
            if collecting:
                gc.enable()

    def _joined(self, known: Aligned, places: list[list[int]]) -> tuple[dict[str, object], np.ndarray, np.ndarray]:
        n, counts = len(places), np.fromiter(map(len, places), np.int64, len(places))
        word, doc = np.fromiter(chain.from_iterable(places), np.int64, int(counts.sum())), np.repeat(np.arange(n), counts)
        lost = np.bincount(doc, known.n_a[word] == 0, n) > 0  # a word that does not give its bytes back takes its text's tokens
        if lost.any():
            word, doc = word[~lost[doc]], doc[~lost[doc]]
        total = lambda each: np.bincount(doc, each[word], n).astype(np.int64)
        numbers = {"n_a": total(known.n_a), "n_b": total(known.n_b), "n_links": total(known.n_links)}
        numbers["n_groups"] = numbers["n_a"] + numbers["n_b"] - numbers["n_links"]
        shown = known.shown
        numbers["groups_sha256"] = [hashlib.sha256(b"".join(map(shown.__getitem__, p))[:-1]).hexdigest() if p and not gone else "" for p, gone in zip(places, lost.tolist(), strict=True)]
        length = known.n_links[word]
        at = np.repeat(known.first[word] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        keys = known.links[at] + np.repeat(doc << self.of.bits, length)
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        return numbers, keys[first], np.diff(np.append(first, len(keys)))


@lru_cache(maxsize=2)
def words(first: str, second: str, stripes: int) -> Words:
    """One pair of tokenizers, and its words, per worker process."""
    return Words(Sides(first, second, stripes))


class PairCounts:
    """How many documents hold each pair, held within a bound: keys have the stripe above ``bits`` of the cell."""

    def __init__(self, bits: int):
        self.bits, self.parts, self.held = bits, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > HELD_PAIRS:
            self.combine()

    def combine(self) -> None:
        if self.parts:
            keys, at = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
            self.parts, self.held = [(keys, np.bincount(at, np.concatenate([p[1] for p in self.parts]).astype(float), len(keys)).astype(np.int64))], len(keys)

    def flush(self) -> Iterator[tuple[int, bytes, bytes, int]]:
        """(stripe, cells, counts, number of cells) of what is held, which is dropped."""
        self.combine()
        for keys, counts in self.parts:
            for s, start, stop in _runs(keys >> self.bits):
                yield s, (keys[start:stop] & (1 << self.bits) - 1).astype("<u4").tobytes(), counts[start:stop].astype("<i8").tobytes(), stop - start
        self.parts, self.held = [], 0


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, stop) of each run of equal values."""
    if len(sorted_values):
        starts = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])).tolist()
        for start, stop in zip(starts, [*starts[1:], len(sorted_values)], strict=True):
            yield int(sorted_values[start]), start, stop


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
#: Kinds of rows of the written table, and the columns each has beside kind.
_DOCUMENT, _LINKS, _COUNTS = 0, 1, 2


def encode_links(docs: DataFrame, first: str, second: str, id_col: str, text_col: str, stripes: int) -> DataFrame:
    """The written table: document rows (chunk, idx, id, numbers), link blocks (chunk, stripe, docs, cells, times) and pair counts (stripe, pair_cells, pair_counts, n_cells)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    types = {"kind": pa.int8(), "chunk": pa.int64(), "idx": pa.int32(), "id": None, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "stripe": pa.int32(), "docs": pa.binary(), "cells": pa.binary(), "times": pa.binary(), "pair_cells": pa.binary(), "pair_counts": pa.binary(), "n_cells": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned, task, chunks = words(first, second, stripes), TaskContext.get().partitionId(), 0
        of = aligned.of
        counts, names, texts, size, kind_of_id = PairCounts(of.bits), [], [], 0, None

        def table(kind: int, length: int, **columns: object) -> pa.RecordBatch:
            get = lambda name, t: columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name], t)
            filled = {name: get(name, t) if name in columns else pa.nulls(length, kind_of_id if name == "id" else t) for name, t in types.items() if name != "kind"}
            return pa.RecordBatch.from_arrays([pa.array(np.full(length, kind, np.int8)), *filled.values()], list(types))

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal chunks, names, texts, size
            chunk, m = (task << 32) + chunks, len(texts)
            numbers, keys, times = aligned.chunk(texts)
            yield table(_DOCUMENT, m, chunk=np.full(m, chunk, np.int64), idx=np.arange(m, dtype=np.int32), id=pa.array(names, kind_of_id), **numbers)
            stripe, doc, cell = keys >> of.bits + DOC_BITS, keys >> of.bits & CHUNK_DOCS - 1, keys & (1 << of.bits) - 1
            blocks = [(s, doc[i:j].astype("<u2").tobytes(), cell[i:j].astype("<u4").tobytes(), times[i:j].astype("<u4").tobytes()) for s, i, j in _runs(stripe)]
            if blocks:
                found, d, c, t = map(list, zip(*blocks, strict=True))
                yield table(_LINKS, len(found), chunk=np.full(len(found), chunk, np.int64), stripe=found, docs=d, cells=c, times=t)
                counts.add(*np.unique((stripe << of.bits) + cell, return_counts=True))
                if counts.held > HELD_PAIRS // 2:
                    yield from passed_on()
            chunks, names, texts, size = chunks + 1, [], [], 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for s, cells, n, length in counts.flush():
                yield table(_COUNTS, 1, stripe=[s], pair_cells=[cells], pair_counts=[n], n_cells=[length])

        for batch in batches:
            kind_of_id = batch.schema.field(0).type
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                names.append(name.as_py())
                texts.append(text)
                size += len(text or "")
                if size >= CHUNK_BYTES or len(names) == CHUNK_DOCS:
                    yield from close()
        if names:
            yield from close()
        yield from passed_on()

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"kind byte, chunk long, idx int, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, docs binary, cells binary, times binary, pair_cells binary, pair_counts binary, n_cells long"
    return materialize(rows.mapInArrow(run, schema), "links")


def _add_counts(parts: DataFrame, cells: int) -> DataFrame:
    """(stripe, part, pair_cells, pair_counts, n_cells, n_links) of rows (stripe, part, pair_cells, pair_counts): their sum in a dense matrix for each stripe and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, matrix = None, np.zeros(cells, np.int64)

        def close() -> pa.RecordBatch:
            held = np.flatnonzero(matrix)
            out = [[key[0]], [key[1]], [held.astype("<u4").tobytes()], [matrix[held].astype("<i8").tobytes()], [len(held)], [int(matrix[held].sum())]]
            matrix[held] = 0
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["stripe", "part", "pair_cells", "pair_counts", "n_cells", "n_links"])

        for batch in batches:
            for stripe, part, at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if (stripe, part) != key:
                    if key:
                        yield close()
                    key = (stripe, part)
                np.add.at(matrix, np.frombuffer(at.as_buffer(), "<u4"), np.frombuffer(n.as_buffer(), "<i8"))
        if key:
            yield close()

    dealt = parts.select("stripe", "part", "pair_cells", "pair_counts").repartition("stripe", "part").sortWithinPartitions("stripe", "part")
    return dealt.mapInArrow(run, "stripe int, part int, pair_cells binary, pair_counts binary, n_cells long, n_links long")


def _split(column: str, parts: dict[int, int]) -> Column:
    """How many parts each stripe has: a literal map of the stripes with more than one."""
    many = {s: p for s, p in parts.items() if p > 1}
    if not many:
        return F.lit(1)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for item in many.items() for v in item]), F.col(column)), F.lit(1))


def count_pairs(encoded: DataFrame, cells: int, task_cells: int = TASK_CELLS) -> DataFrame:
    """A written table of each stripe's pairs and in how many documents they are linked (stripe, pair_cells, pair_counts, n_links)."""
    counts = encoded.where(F.col("kind") == _COUNTS)
    sizes = {r["stripe"]: -(-r["n"] // task_cells) for r in counts.groupBy("stripe").agg(F.sum("n_cells").alias("n")).collect()}  # a row per stripe
    parts = counts.select("stripe", F.pmod(F.xxhash64("pair_cells"), _split("stripe", sizes)).cast("int").alias("part"), "pair_cells", "pair_counts")
    if any(p > 1 for p in sizes.values()):
        parts = materialize(_add_counts(parts, cells), "parts").withColumn("part", F.lit(0))
    return materialize(_add_counts(parts, cells), "counts")


def score_links(encoded: DataFrame, counts: DataFrame, cells: int, n_b: int, task_links: int = TASK_LINKS) -> DataFrame:
    """(chunk, idx, n_best, count_sum) of each document with links."""
    parts = {r["stripe"]: -(-r["n_links"] // task_links) for r in counts.select("stripe", "n_links").collect()}  # a row per stripe
    n = _split("stripe", parts)
    links = encoded.where(F.col("kind") == _LINKS).select("stripe", F.pmod(F.xxhash64("chunk"), n).cast("int").alias("part"), F.lit(1).alias("later"), "chunk", "docs", "cells", "times")
    known = counts.select("stripe", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"), F.lit(0).alias("later"), F.lit(0).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("docs"), F.col("pair_cells").alias("cells"), F.col("pair_counts").alias("times"))
    dealt = known.unionByName(links).repartition("stripe", "part").sortWithinPartitions("stripe", "part", "later")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, held = np.zeros(cells, np.int64), np.empty(0, np.int64)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for later, chunk, docs, at, times in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), batch.column(6), strict=True):
                at = np.frombuffer(at.as_buffer(), "<u4")
                if not later:
                    matrix[held] = 0
                    held = at
                    matrix[held] = np.frombuffer(times.as_buffer(), "<i8")
                    best = matrix.reshape(-1, n_b).max(axis=1)
                    continue
                docs, times = np.frombuffer(docs.as_buffer(), "<u2"), np.frombuffer(times.as_buffer(), "<u4").astype(np.int64)
                starts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
                found = matrix[at]
                out[0].append(chunk)
                out[1].append(docs[starts].tobytes())
                out[2].append(np.add.reduceat(times * (found == best[at // n_b]), starts).astype("<u4").tobytes())
                out[3].append(np.add.reduceat(times * found, starts).astype("<i8").tobytes())
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["chunk", "docs", "n_best", "sums"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n_best, sums = None, np.zeros(CHUNK_DOCS, np.int64), np.zeros(CHUNK_DOCS, np.int64)

        def close() -> pa.RecordBatch:
            found = np.flatnonzero(sums)  # every link has a count of 1 at least
            columns = [np.full(len(found), key, np.int64), found.astype(np.int32), n_best[found], sums[found]]
            n_best[:], sums[:] = 0, 0
            return pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["chunk", "idx", "n_best", "count_sum"])

        for batch in batches:
            for chunk, docs, some, total in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                if chunk != key:
                    if key is not None:
                        yield close()
                    key = chunk
                docs = np.frombuffer(docs.as_buffer(), "<u2")  # no document twice in a block
                n_best[docs] += np.frombuffer(some.as_buffer(), "<u4")
                sums[docs] += np.frombuffer(total.as_buffer(), "<i8")
        if key is not None:
            yield close()

    scored = dealt.mapInArrow(score, "chunk long, docs binary, n_best binary, sums binary")
    return scored.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(gather, "chunk long, idx int, n_best long, count_sum long")


def pair_table(counts: DataFrame, n_b: int, stripes: int = STRIPES) -> DataFrame:
    """(a, b, n_docs, best) of every linked pair of ids, from the table of count_pairs; best: no partner of a is linked in more documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, at, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                at, n = np.frombuffer(at.as_buffer(), "<u4").astype(np.int64), np.frombuffer(n.as_buffer(), "<i8")
                starts = np.flatnonzero(np.append(True, at[1:] // n_b != at[:-1] // n_b))
                best = np.repeat(np.maximum.reduceat(n, starts), np.diff(np.append(starts, len(n))))
                yield pa.RecordBatch.from_arrays([pa.array(at // n_b * stripes + stripe), pa.array(at % n_b), pa.array(n), pa.array(n == best)], ["a", "b", "n_docs", "best"])

    return counts.select("stripe", "pair_cells", "pair_counts").mapInArrow(run, "a long, b long, n_docs long, best boolean")


def align_tokenizers(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", stripes: int = STRIPES, task_cells: int = TASK_CELLS, task_links: int = TASK_LINKS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    n_best counts the links whose pair stands in most documents of all pairs of its first id; count_sum adds up the
    numbers of documents that hold the linked pairs. A tokenizer is a byte-level file or a sentencepiece model (``.model``).
    """
    for path in (first, second):
        if not os.path.exists(path):
            raise FileNotFoundError(path)
    of = words(first, second, stripes).of
    encoded = encode_links(docs, first, second, id_col, text_col, stripes)
    scores = score_links(encoded, count_pairs(encoded, of.cells, task_cells), of.cells, of.n_b, task_links)
    found = encoded.where(F.col("kind") == _DOCUMENT).select("chunk", "idx", "id", *_NUMBERS)
    joined = found.join(scores, ["chunk", "idx"], "left")
    return joined.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
