"""Benchmark decontamination by greedy string tiling.

Shared-token seeds join documents and benchmark items: rolling Karp-Rabin hashes of ``least_match`` words of
each item are a table, which is joined to those of the documents; of a document only the runs move that a bitmap of
fixed size, filled with the benchmark's hashes, does not exclude. Each joined pair is tiled: the longest
non-overlapping matches are marked repeatedly; a document is contaminated by an item if the marked share of the
item's words reaches the threshold. As tiles may stand in any order, reordered passages are caught.

Equal texts are tiled once. Neither side is broadcast or collected, so the benchmark may have any size; a text
moves once to meet its items, which stream past it one at a time.

Words: lower-cased runs of a-z, digits and code points from U+0080.

Defined results: null or empty texts are clean with coverage 0; null ids and repeated rows are kept; items without
words are never found; items shorter than a match are found whole; of items of one id the best counts; items of null
id count, but are not listed; of tiles of one length the earliest in item, then document, is marked first; an empty
benchmark leaves all clean; an empty table gives an empty table. Only the ids and texts are read;
`drop_contaminated` carries all other columns, whatever their names and types. Repetitive long texts cost time
and memory in proportion to the number of maximal matches; tiling ends once an item is marked whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hashing import WordHashes, rolling
from ._shared import bitmap_of, materialize, may_hit, release
from .license_scan import words_of

#: Seed pairs of a document and an item that are looked at together.
PAIRS_AT_ONCE = 1 << 20
_hashes = WordHashes()


def split_words(text: str | None) -> list[bytes]:
    return words_of((text or "").lower())


class Tiler:
    """A benchmark item, ready to be tiled with documents."""

    def __init__(self, text: str | None, least_match: int = 5):
        words = split_words(text)
        self.word: dict[bytes, int] = {}
        self.ids = np.array([self.word.setdefault(w, len(self.word) + 1) for w in words], np.int64)
        self.n = min(least_match, len(self.ids))
        hashes = rolling(self.ids, self.n) if self.n else np.empty(0, np.uint64)
        self.at = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.at]

    def _matches(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        """Rows (shift, first item place, last seed's item place) of the maximal matches, in parts of the document."""
        n = self.n
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        starts = np.flatnonzero(known[n:] - known[:-n] == n)
        h = rolling(ids, n)[starts]
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        hit = np.flatnonzero(high > low)
        starts, low, k = starts[hit], low[hit], (high - low)[hit]
        total = np.cumsum(k)
        cut = 0
        while cut < len(starts):
            end = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + PAIRS_AT_ONCE, "right")))
            m = k[cut:end]
            d = np.repeat(starts[cut:end], m)
            t = self.at[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[cut:end], m)]
            for i in range(n):  # hashes may collide
                same = ids[d + i] == self.ids[t + i]
                d, t = d[same], t[same]
            order = np.lexsort((t, d - t))
            shift, t = (d - t)[order], t[order]
            first = np.flatnonzero(np.r_[True, (np.diff(shift) != 0) | (np.diff(t) != 1)]) if len(t) else np.empty(0, np.int64)
            last = np.r_[first[1:], len(t)][: len(first)] - 1
            yield np.stack([shift[first], t[first], t[last]], axis=1)
            cut = end

    def coverage(self, words: list[bytes]) -> tuple[float, int]:
        """(share of the item's words that tiles mark, number of tiles) in a document."""
        n = self.n
        if not n or len(words) < n:
            return 0.0, 0
        ids = np.fromiter(map(self.word.get, words, [0] * len(words)), np.int64, len(words))
        parts = list(self._matches(ids))
        runs = np.concatenate(parts) if parts else np.empty((0, 3), np.int64)
        if len(parts) > 1:  # matches that go on in the next part
            runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
            joins = np.r_[False, (np.diff(runs[:, 0]) == 0) & (runs[1:, 1] == runs[:-1, 2] + 1)]
            first = np.flatnonzero(~joins)
            runs = np.stack([runs[first, 0], runs[first, 1], runs[np.r_[first[1:], len(runs)] - 1, 2]], axis=1)
        heap = [(-(last - t + n), t, t + shift) for shift, t, last in runs.tolist()]
        heapq.heapify(heap)
        in_item, in_doc, tiles, marked = np.zeros(len(self.ids), bool), np.zeros(len(ids), bool), 0, 0
        while heap and marked < len(self.ids):
            size, t, d = heapq.heappop(heap)
            size = -size
            taken = in_item[t : t + size] | in_doc[d : d + size]
            if not taken.any():
                in_item[t : t + size] = in_doc[d : d + size] = True
                tiles += 1
                marked += size
                continue
            edges = np.flatnonzero(np.diff(np.r_[True, taken, True]))
            for a, b in edges.reshape(-1, 2).tolist():  # what is left free of it
                if b - a >= n:
                    heapq.heappush(heap, (a - b, t + a, d + a))
        return marked / len(self.ids), tiles


def _item_seeds(least_match: int):
    """(item, n, h) of every run of an item."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = split_words(text.as_py())
                n = min(least_match, len(words))
                h = np.unique(rolling(_hashes.of(words), n)) if n else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(h), pa.int64()), pa.array([n] * len(h), pa.int32()), pa.array(h.view(np.int64), pa.int64())], ["item", "n", "h"])
        _hashes.clear()

    return seeds


def _hits(lengths: list[int], bitmap):
    """(key, text, hashes of the runs that the benchmark may hold) of the texts with any."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, found = [], [], []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                t = text.as_py()
                ids = _hashes.of(split_words(t))
                h = np.concatenate([rolling(ids, n) for n in lengths]).view(np.int64)
                h = np.unique(h[bitmap.hit(h)])
                if len(h):
                    keys.append(key.as_py())
                    texts.append(t)
                    found.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.int64()))], ["key", "text", "hits"])
        _hashes.clear()

    return hits


@lru_cache(maxsize=512)
def _tiler(text: str, least_match: int) -> Tiler:
    return Tiler(text, least_match)


def _tiled(threshold: float, least_match: int):
    """Rows (key, kind, name, text) in that order, a document (kind 0) before its items (kind 1): (key, coverage, n_tiles, items)."""

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, best = None, [], {}

        def done() -> pa.RecordBatch:
            items = sorted(name for name, (share, _) in best.items() if name is not None and share >= threshold)
            row = [[key], [max(share for share, _ in best.values())], [sum(n for _, n in best.values())], [items]]
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["key", "coverage", "n_tiles", "items"])

        for batch in batches:
            for k, kind, name, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if kind == 0:
                    if best:
                        yield done()
                    key, words, best = k, split_words(text), {}
                else:
                    best[name] = max(best.get(name, (0.0, 0)), _tiler(text, least_match).coverage(words))
        if best:
            yield done()
        _tiler.cache_clear()

    return tile


def _found(texts: DataFrame, benchmark: DataFrame, threshold: float, least_match: int, item_col: str, item_text_col: str) -> DataFrame:
    """(key, coverage, n_tiles, items) of the texts (key, text) that share a run of words with any item."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("name"), F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).alias("text")).distinct()
    items = materialize(items.select(F.monotonically_increasing_id().alias("item"), "name", "text"), "items")
    seeds = materialize(items.select("item", "text").mapInArrow(_item_seeds(least_match), "item long, n int, h long"), "seeds")
    lengths = sorted(r["n"] for r in seeds.select("n").distinct().collect())  # least_match numbers at most
    if not lengths:
        return texts.sparkSession.createDataFrame([], "key string, coverage double, n_tiles long, items array<bigint>")
    hits = texts.mapInArrow(_hits(lengths, bitmap_of(seeds, "h")), "key string, text string, hits array<bigint>")
    texts = materialize(hits.dropDuplicates(["key"]), "candidates")
    pairs = texts.select("key", F.explode("hits").alias("h")).join(seeds.select("h", "item").hint("merge"), "h").select("key", "item").distinct()
    paired = pairs.join(items.hint("merge"), "item").select("key", F.lit(1).alias("kind"), "name", "text")
    alone = texts.select("key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("name"), "text")
    dealt = alone.unionByName(paired).repartition("key").sortWithinPartitions("key", "kind", "name")
    tiled = materialize(dealt.mapInArrow(_tiled(threshold, least_match), "key string, coverage double, n_tiles long, items array<bigint>"), "tiled")
    release(items, seeds, texts)
    return tiled


def _key(text_col: str):
    return F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least_match: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, contaminated, coverage, n_tiles, items) of every document; items: the ids of those that reach the threshold."""
    texts = docs.select(_key(text_col).alias("key"), F.col(f"`{text_col}`").alias("text"))
    found = _found(texts, benchmark, threshold, least_match, item_col, item_text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _key(text_col).alias("key")).join(found.hint("merge"), "key", "left")
    none = F.array().cast("array<bigint>")
    coverage = F.coalesce("coverage", F.lit(0.0))
    return rows.select(F.col("id").alias(id_col), (coverage >= threshold).alias("contaminated"), coverage.alias("coverage"), F.coalesce("n_tiles", F.lit(0)).cast("long").alias("n_tiles"), F.coalesce("items", none).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least_match: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows whose text reaches the threshold for no item. Rows that a bitmap of the contaminated texts excludes do not move."""
    texts = docs.select(_key(text_col).alias("key"), F.col(f"`{text_col}`").alias("text"))
    found = _found(texts, benchmark, threshold, least_match, item_col, item_text_col).where(F.col("coverage") >= threshold)
    found = found.select("key", F.xxhash64("key").alias("h"))
    whole = docs.select(_key(text_col).alias("key"), F.struct("*").alias("row"))
    may = may_hit(bitmap_of(found, "h"))(F.xxhash64("key"))
    clean = whole.where(~may).select("row")
    checked = whole.where(may).join(found.select("key").hint("merge"), "key", "left_anti").select("row")
    return clean.unionByName(checked).select("row.*")
