"""MinHash near-duplicate detection with an LSH forest.

Documents with equal shingle sets (by a digest of 128 bits) form a class. Each class has ``TREES`` labels, sequences of
minhashes; the labels of a tree are sorted, and neighbours that share a prefix of a
least depth are candidates. Candidates that an estimate from the signatures cannot exclude
are confirmed on full shingle sets; links give components.

Sorted neighbours alone yield a number of candidates linear in the rows, however many copies there
are, but rows that share a passage may stand between two copies in every order. So each group of rows
that share a prefix of the least depth, unless its neighbours are already in one region, has all
its pairs compared by size and estimate, in blocks of bounded size; a spanning forest of the pairs kept
is enough, as it and the neighbours connect rows to regions. In each region whose rows are not all in
one component, every row outside its largest component is intersected with all rows of the region by an
inverted index of their shingles, in blocks bounded by rows and by bytes. That is exact, and yields one link per
row and component, confirmed like the others, so no group of copies is expanded into all pairs and no cap drops a
link. Least depth, estimate and the smallest set
that can have a partner follow from the threshold, a whole percentage from 50 to 100; others are rejected.
What remains is the forest's own chance to miss (1e-6 at most at the threshold): two sets of similarity
0.8 share no prefix of 3 in any of 20 trees with probability 6e-7, and the estimate excludes a true pair
with probability 6e-6. The price is time: a prefix group of rows that are alike but not linked costs the square of
its rows in comparisons of 120 bytes, and those of them that the estimate keeps together the square in intersections.

Texts move only where they have a likely pair: a bitmap of fixed size of those rows' hashes, combined on the
executors, is held against every row before the exchange (a hash in common costs a needless move, never a result).
Joins are sort-merge joins at every size, so the plan of a small table is the plan of a large one.

Words: A-Z is lower-cased, words are runs of characters other than U+0020 and U+0009 to U+000D. A
document with fewer words than a shingle has its whole word sequence as its only shingle.

Defined results: null or wordless texts have an empty set, are linked with nothing and kept; repeated
rows are one class and all get the class's component; the component is named by the smallest id in it
(null if all are null); an empty table gives an empty table. Only the id and the text are read; `one_of_each_group`
carries all other columns, whatever their names and types, and of repeated rows keeps the first by their JSON.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._hashing import WordHashes, mixed, rolling
from ._shared import bitmap_of, materialize, may_hit, release
from .graph import connected_components

TREES, DEPTH = 20, 6
HASHES = TREES * DEPTH
_MULTIPLIERS = mixed(np.arange(1, HASHES + 1)) | np.uint64(1)
#: Rows of a region, and bytes of their texts, that one task intersects with as many others at a time.
REGION_BLOCK, REGION_BYTES = 2000, 16 << 20
#: Rows of a prefix group in one block; each pair of blocks is compared by one task.
GROUP_BLOCK = 4000


def _fitted(threshold: float) -> tuple[int, int, float]:
    """(least depth, smallest set with a partner, least estimate) for a threshold."""
    percent = round(threshold * 100)
    if abs(threshold * 100 - percent) > 1e-9 or not 50 <= percent <= 100:
        raise ValueError(f"the threshold is {threshold}; whole percentages from 0.5 to 1 are served")
    depth = max(d for d in (1, 2, 3) if (1 - threshold**d) ** TREES <= 1e-6)
    smallest = -(-percent // (100 - percent)) if percent < 100 else 1 << 62  # n of n + 1 shingles is the most that n can reach
    return depth, smallest, threshold - 4.5 * (threshold * (1 - threshold) / HASHES) ** 0.5


_hashes = WordHashes()


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = split_words(text)
    if not words:
        return np.empty(0, np.uint64)
    ids = _hashes.of(words)
    if len(ids) < n:
        return mixed(rolling(ids, len(ids)) + np.uint64(len(ids)))
    return np.unique(mixed(rolling(ids, n)))


def shingle_set(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves."""
    words = split_words(text)
    return {tuple(words)} if 0 < len(words) < n else set(zip(*[words[k:] for k in range(n)], strict=False))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minhashes of a set, 32 bits each."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(out, (hashes[at : at + 256, None] * _MULTIPLIERS).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _features(shingle: int):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, labels = [], [], []
            for text in batch.column(2):
                h = shingle_hashes(text.as_py(), shingle)
                sizes.append(len(h))
                names.append(blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                labels.append(signature(h).astype(">u4").tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(labels, pa.binary())], ["id", "tkey", "n", "name", "labels"])
        _hashes.clear()  # workers live on, and their memory is shared with later stages

    return features


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree key, rest of the label, node) in sorted order: adds the next node of the same key, and marks the partition's ends.

    Rows alone with their key are left out, but for the ends, whose neighbours may be in other partitions.
    """
    names = ["key", "rest", "node", "next", "part", "end"]
    before = part = None
    alone, opened = True, False

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    out: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            part = row[3]
            if before is not None:
                same = before[0] == row[0]
                if same or not alone or not opened:
                    out.append((*before[:3], row[2] if same else None, part, 0 if opened else -1))
                alone, opened = not same, True
            before = row
        if len(out) > 50_000:
            yield pack(out)
            out = []
    if before is not None:
        out.append((*before[:3], None, part, 1 if opened else 2))
        yield pack(out)


def _estimated(least: float, threshold: float):
    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (4, 5))
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            keep = ((x == y).mean(axis=1) >= least) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return estimate


def _forest_of(nodes: np.ndarray, n: np.ndarray, sketches: np.ndarray, least: float, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that neither size nor estimate excludes, of all pairs of the rows."""
    order = np.argsort(n, kind="stable")
    nodes, n, words = nodes[order], n[order], np.ascontiguousarray(sketches[order])
    links: list[tuple[int, int]] = []
    while len(nodes):
        queue = [(nodes[0], n[0], words[0])]
        nodes, n, words = nodes[1:], n[1:], words[1:]
        while queue and len(nodes):
            node, size, sketch = queue.pop()
            low, high = np.searchsorted(n, threshold * size - 1e-9, "left"), np.searchsorted(n, (size + 1e-9) / threshold, "right")
            equal = (words[low:high] == sketch).view(np.uint64).sum(axis=1)  # at most 15 in each byte
            near = np.flatnonzero(((equal * np.uint64(0x0101010101010101)) >> np.uint64(56)) / HASHES >= least) + low
            if len(near):
                links += [(int(node), int(x)) for x in nodes[near]]
                queue += zip(nodes[near], n[near], words[near], strict=True)
                rest = np.ones(len(nodes), bool)
                rest[near] = False
                nodes, n, words = nodes[rest], n[rest], words[rest]
    return links


def _grouped(least: float, threshold: float):
    """Spanning forests of groups; rows (key, block, block, node, n, sketch) in the order of the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[list[tuple]]:
            key, rows = None, []
            for batch in batches:
                for *at, node, n, sketch in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                    if at != key:
                        yield rows
                        key, rows = at, []
                    rows.append((node, n, sketch))
            yield rows

        for rows in groups():
            if len(rows) > 1:
                nodes, n, sketches = zip(*rows, strict=True)
                found = _forest_of(np.array(nodes, np.int64), np.array(n, np.int64), np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, HASHES), least, threshold)
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _confirmed(shingle: int, threshold: float):
    percent = round(threshold * 100)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, set()
        for batch in batches:
            rows = []
            for a, b, s, t in zip(*[batch.column(k) for k in range(4)], strict=True):
                b = b.as_py()
                if b != held:
                    held, mine = b, shingle_set(t.as_py(), shingle)
                a, other = a.as_py(), shingle_set(s.as_py(), shingle)
                common = len(mine & other)
                rows.append((a, b, 100 * common >= percent * (len(mine) + len(other) - common)))
            if rows:
                x, y, z = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(z, pa.bool_())], ["a", "b", "linked"])

    return confirm


def _region_links(shingle: int, threshold: float):
    """One link per query row and component of a block's members, by intersection with all members."""
    percent = round(threshold * 100)

    def links(members: list[tuple], queries: list[tuple]) -> Iterator[tuple[int, int]]:
        sets = [shingle_hashes(text, shingle) for _, _, text in members]
        sizes = np.array([len(h) for h in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        comps = np.array([c for _, c, _ in members])
        for node, comp, text in queries:
            mine = shingle_hashes(text, shingle)
            low, high = np.searchsorted(every, mine, "left"), np.searchsorted(every, mine, "right")
            n = high - low
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            common = np.bincount(owner[at], minlength=len(sets))
            near = np.flatnonzero((100 * common >= percent * (len(mine) + sizes - common)) & (comps != comp))
            for k in near[np.unique(comps[near], return_index=True)[1]]:
                yield node, members[k][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[list[tuple], list[tuple]]]:
            key, sides = None, ([], [])
            for batch in batches:
                for *at, query, node, comp, text in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
                    if at != key:
                        yield sides
                        key, sides = at, ([], [])
                    sides[query].append((node, comp, text))
            yield sides

        for members, queries in blocks():
            found = list(links(members, queries)) if members and queries else []
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    return _near_duplicates(docs, id_col, text_col, shingle, threshold).drop("tkey")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows that stay, one of each component, with all their columns; texts without words stay."""
    names = ["by_id", "no_id", "by_text"]  # never null, so join and window share one exchange
    key = lambda x, t: [F.xxhash64(x).alias("by_id"), x.isNull().alias("no_id"), t.alias("by_text")]
    kept = _near_duplicates(docs, id_col, text_col, shingle, threshold).where("kept")
    kept = kept.select(*key(F.col(f"`{id_col}`"), F.col("tkey"))).distinct()
    # rows move whole in one column, so no name of theirs can clash
    whole = docs.select(*key(F.col(f"`{id_col}`").cast("long"), F.xxhash64(f"`{text_col}`")), F.struct("*").alias("row"))
    chosen = whole.join(kept.hint("merge"), names, "left_semi")
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    repeats = Window.partitionBy(*names).orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    return chosen.withColumn("place", F.row_number().over(repeats)).where("place = 1").select("row.*")


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float) -> DataFrame:
    depth, smallest, _ = _fitted(threshold)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(f"`{text_col}`").alias("tkey"), F.col(f"`{text_col}`").alias("text"))
    rows = materialize(source.mapInArrow(_features(shingle), "id long, tkey long, n long, name binary, labels binary"), "features")
    reps = rows.where("name IS NOT NULL").groupBy("name").agg(F.min(F.struct("id", "tkey", "n", "labels")).alias("r"), F.min("id").alias("least_id"))
    low_bytes = F.concat(*[F.substring("labels", 4 * k + 4, 1) for k in range(HASHES)])
    # a number of its own for each class; it is fixed once the table is written
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("node"), "name", "least_id", "r.id", "r.tkey", "r.n", "r.labels").withColumn("sketch", low_bytes), "classes")
    trees = reps.where(F.col("n") >= smallest).select("node", "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    at = F.col("tree") * (4 * DEPTH)
    trees = trees.select(F.xxhash64("tree", F.substring("labels", at + 1, F.lit(4 * depth))).alias("key"), F.substring("labels", at + 4 * depth + 1, F.lit(4 * (DEPTH - depth))).alias("rest"), "node")
    sorted_trees = trees.repartitionByRange("key", "rest", "node").sortWithinPartitions("key", "rest", "node").select("key", "rest", "node", F.spark_partition_id().alias("part"))
    members = materialize(sorted_trees.mapInArrow(_neighbours, "key long, rest binary, node long, next long, part int, end int"), "members")
    pairs = members.where("next IS NOT NULL").select("node", "next").unionByName(_over_ends(members)).select(F.least("node", "next").alias("a"), F.greatest("node", "next").alias("b")).distinct()
    likely = _likely_pairs(pairs, reps, threshold)
    in_groups = _pairs_in_groups(members, connected_components(likely), reps, threshold)
    near = likely.unionByName(in_groups)
    texts = _texts_of(near, reps, source)
    links = _confirmed_links(likely, texts, shingle, threshold)
    missed = _links_in_regions(connected_components(near), connected_components(links), texts, shingle, threshold)
    more = _confirmed_links(missed, texts, shingle, threshold)
    components = connected_components(links.unionByName(more))
    found = reps.select("node", "name", "least_id").join(components.hint("merge"), "node", "left").select("name", "least_id", F.coalesce("root", "node").alias("root"))
    least = found.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialize(found.join(least.hint("merge"), "root").select("name", "component_id"), "components")
    out = rows.select("id", "tkey", "n", "name").join(named.hint("merge"), "name", "left")
    release(reps, members, likely, in_groups, texts, links, missed, more)
    component = F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "tkey")


def _over_ends(members: DataFrame) -> DataFrame:
    """The neighbours that a partition border separates; the driver gets two rows per partition."""
    ends = sorted(members.where("end <> 0").select("part", "end", "key", "node").collect())
    return members.sparkSession.createDataFrame([(x["node"], y["node"]) for x, y in zip(ends, ends[1:], strict=False) if x["part"] != y["part"] and x["key"] == y["key"]], "node long, next long")


def _likely_pairs(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs that the estimate from the signatures does not exclude."""
    side = lambda x: reps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return materialize(both.mapInArrow(_estimated(_fitted(threshold)[2], threshold), "a long, b long"), "likely")


def _pairs_in_groups(members: DataFrame, regions: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs that connect all rows of a prefix group that the estimate keeps together, where neighbours did not.

    A group of two has its only pair among the neighbours; one of a single region has nothing to connect.
    """
    placed = members.select("key", "node").join(regions.hint("merge"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("region"))
    open_groups = placed.groupBy("key").agg(F.count("*").alias("rows"), F.min("region").alias("low"), F.max("region").alias("high")).where("rows > 2 AND low <> high")
    open_groups = open_groups.select("key", F.ceil(F.col("rows") / GROUP_BLOCK).alias("k"))
    rows = members.select("key", "node").join(open_groups.hint("merge"), "key").join(reps.select("node", "n", "sketch").hint("merge"), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).where("k = 1 OR own <> other")
    dealt = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n", "sketch").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return materialize(dealt.mapInArrow(_grouped(_fitted(threshold)[2], threshold), "a long, b long"), "near")


def _texts_of(likely: DataFrame, reps: DataFrame, source: DataFrame) -> DataFrame:
    """(node, text) of the nodes with a likely pair."""
    needed = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    wanted = needed.join(reps.select("node", "id", "tkey").hint("merge"), "node").select("node", F.col("id").alias("r_id"), F.col("tkey").alias("r_tkey"), F.xxhash64("id", "tkey").alias("h"))
    wanted = materialize(wanted, "wanted")
    candidates = source.where(may_hit(bitmap_of(wanted, "h"))(F.xxhash64("id", "tkey")))
    texts = candidates.join(wanted.drop("h").hint("merge"), F.col("id").eqNullSafe(F.col("r_id")) & (F.col("tkey") == F.col("r_tkey"))).select("node", "text")
    texts = materialize(texts.dropDuplicates(["node"]), "texts")
    release(wanted)
    return texts


def _confirmed_links(likely: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t_{x}")).hint("merge")
    both = likely.join(side("a"), "a").join(side("b"), "b")
    checked = both.select("a", "b", "t_a", "t_b").mapInArrow(_confirmed(shingle, threshold), "a long, b long, linked boolean")
    return materialize(checked.where("linked").select("a", "b"), "links")


def _links_in_regions(regions: DataFrame, components: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The links between components of a region that its sorted neighbours missed."""
    placed = regions.withColumnRenamed("root", "region").join(components.hint("merge"), "node", "left").select("node", "region", F.coalesce("root", "node").alias("comp"))
    placed = placed.join(texts.select("node", F.octet_length("text").alias("bytes")).hint("merge"), "node")
    parts = placed.groupBy("region", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    open_regions = parts.groupBy("region").agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "comp", "bytes")).alias("largest")).where("rows > largest.n")
    blocks = lambda rows, size: F.ceil(F.greatest(rows / REGION_BLOCK, size / REGION_BYTES, F.lit(1.0)))
    open_regions = open_regions.select("region", F.col("largest.comp").alias("main"), blocks(F.col("rows") - F.col("largest.n"), F.col("bytes") - F.col("largest.bytes")).alias("i"), blocks(F.col("rows"), F.col("bytes")).alias("j"))
    rows = placed.drop("bytes").join(open_regions.hint("merge"), "region").join(texts.hint("merge"), "node")
    every, own = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1)), lambda k: F.pmod(F.xxhash64("node"), F.col(k))
    members = rows.select("region", every("i").alias("bi"), own("j").alias("bj"), F.lit(0).alias("query"), "node", "comp", "text")
    queries = rows.where("comp <> main").select("region", own("i").alias("bi"), every("j").alias("bj"), F.lit(1).alias("query"), "node", "comp", "text")
    dealt = members.unionByName(queries).repartition("region", "bi", "bj").sortWithinPartitions("region", "bi", "bj")
    return materialize(dealt.mapInArrow(_region_links(shingle, threshold), "a long, b long"), "missed")
