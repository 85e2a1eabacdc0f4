"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions only.

Each paragraph is hashed to a wide vector and the vectors are summed lane by lane modulo a power of
two, so the sum does not depend on the order of paragraphs, and adding or subtracting a paragraph's
vector inserts or deletes it. The vector has two parts:

* 8 lanes of 32 bits from the paragraph's SHA-256, summed modulo 2^32: equality of multisets;
* 64 lanes counting the hash bits of the paragraph's sentences (and their number): a linear sketch
  whose signed difference estimates how many sentences two documents do not share, for ``likeness``.

Defined results: a null text counts as empty; the empty text is one empty paragraph; equal texts
have equal fingerprints; repeated rows each get a row; an empty table gives an empty table. Rows are
ordered by descending id, null ids last, ties by descending text. Only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES, BITS = 8, 64
MODULUS = 1 << 32
SENTENCE_END = "[.!?\\n]+"


def _bind(value: str, name: str, use: str) -> str:
    """SQL of use with name standing for value, computed once: higher-order functions don't share subexpressions."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _sum(values: str, of: str) -> str:
    return f"aggregate({values}, 0L, (total, h) -> total + {of})"


def _paragraph_lanes(text: str) -> str:
    lanes = ", ".join(f"{_sum('hs', f'cast(conv(substring(h, {1 + 8 * i}, 8), 16, 10) AS BIGINT)')} & {MODULUS - 1}" for i in range(LANES))
    return _bind(f"transform(split({text}, '\\n', -1), p -> sha2(cast(p AS BINARY), 256))", "hs", f"array({lanes})")


def _sentence_lanes(text: str) -> str:
    """The number of sentences, then how many of their hashes have bit i set, for each i."""
    sentences = f"filter(split({text}, '{SENTENCE_END}', -1), s -> s <> '')"
    halves = ", ".join(f"transform(hs, h -> cast(conv(substring(h, {at}, 8), 16, 10) AS BIGINT))" for at in (1, 9))
    lanes = ", ".join(_sum(f"hh[{i // 32}]", f"(shiftright(h, {i % 32}) & 1L)") for i in range(BITS))
    return _bind(f"transform({sentences}, s -> substring(sha2(cast(s AS BINARY), 256), 1, 16))", "hs", _bind(f"array({halves})", "hh", f"array(cast(size(hh[0]) AS BIGINT), {lanes})"))


def with_vector(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint of a text column as columns name_p and name_s, both array<long>.

    Two columns rather than a struct, as the optimizer would compute a struct anew for each use of a field.
    """
    whole = f"coalesce({text}, '')"
    return rows.withColumns({f"{name}_p": F.expr(_paragraph_lanes(whole)), f"{name}_s": F.expr(_sentence_lanes(whole))})


def vector(name: str) -> dict[str, Column]:
    return {part: F.col(f"{name}_{part}") for part in "ps"}


def combine(a: dict[str, Column], b: dict[str, Column], sign: int = 1) -> dict[str, Column]:
    """Fingerprint of a's paragraphs with b's inserted (sign 1) or deleted (sign -1)."""
    add = lambda x, y: x + y * F.lit(sign)
    return {"p": F.zip_with(a["p"], b["p"], lambda x, y: F.pmod(add(x, y), F.lit(MODULUS))), "s": F.zip_with(a["s"], b["s"], add)}


def render(v: dict[str, Column]) -> Column:
    """Lanes as fixed-width hexadecimal, then the sentence counts."""
    lanes = F.array_join(F.transform(v["p"], lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")
    return F.concat(lanes, F.lit(":"), F.array_join(F.transform(v["s"], lambda x: x.cast("string")), ","))


def likeness(a: str, b: str) -> Column:
    """Estimated share of common sentences of the fingerprints named a and b, 0 to 1; 1 for equal ones."""
    signed = ", ".join(f"transform(slice({v}_s, 2, {BITS}), x -> 2 * x - {v}_s[0])" for v in (a, b))
    dot, squares = _sum("zip_with(xy[0], xy[1], (p, q) -> p * q)", "h"), f"{_sum('xy[0]', 'h * h')} + {_sum('xy[1]', 'h * h')}"
    share = "CASE WHEN d[1] - d[0] <= 0 THEN 0D ELSE greatest(0D, least(1D, d[0] / greatest(d[1] - d[0], 1L))) END"
    return F.expr(f"CASE WHEN {a}_p = {b}_p THEN 1D ELSE {_bind(f'array({signed})', 'xy', _bind(f'array({dot}, {squares})', 'd', share))} END")


def _with_block(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """Adds ``block``: 0 for the largest ids. Two-level search, so its cost grows with the root of the number of blocks."""
    down = sorted(set(bounds), reverse=True)
    step = max(1, int(len(down) ** 0.5))
    literal = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<bigint>")
    above = lambda xs: F.size(F.filter(xs, lambda b: F.coalesce(F.col("id") < b, F.lit(True))))
    coarse = above(literal(down[step - 1 :: step])) * step
    return rows.withColumn("block", coarse + above(F.slice(literal(down), coarse + 1, step)) if down else F.lit(0))


def with_next(rows: DataFrame, derive, rows_per_block: int = 4_000, max_blocks: int = 1 << 14) -> DataFrame:
    """Joins each row of (id long, text) and the columns that derive adds to the next row in descending id order, the last to the first.

    The ids are cut at quantiles into blocks that are sorted on their own; each block's first row also
    stands at the end of the block before it, so no row is moved twice. A block holds rows_per_block rows,
    or more where there would be over max_blocks of them, as their bounds stand in the plan. Rows of one id, null
    included, share a block, as ids are meant to tell rows apart.
    """
    n = rows.count()
    blocks = min(n // rows_per_block + 1, max_blocks)
    bounds = rows.agg(F.percentile_approx("id", [i / blocks for i in range(1, blocks)], max(10_000, 20 * blocks))).first()[0] if blocks > 1 else []
    placed = _with_block(rows, bounds or [])
    heads = placed.groupBy("block").agg(F.max("id").alias("id"))
    first = heads.agg(F.min("block")).first()[0]
    before = Window.orderBy("block")  # a row per block
    heads = heads.select("id", F.col("block").alias("own"), F.coalesce(F.lag("block").over(before), F.max("block").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("block"))
    ends = rows.select(F.col("id").alias("own_id"), "text").join(F.broadcast(heads), F.col("own_id").eqNullSafe(heads["id"]))  # max_blocks rows at most
    both = derive(placed.select("id", "text", "block", F.lit(False).alias("end")).unionByName(ends.select("id", "text", "block", F.lit(True).alias("end"))))
    other = [c for c in both.columns if c not in ("id", "block", "end")]
    order = Window.partitionBy("block").orderBy("end", F.col("id").desc_nulls_last(), F.col("text").desc_nulls_last())
    assert first is not None or n == 0
    return both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in other]).where(~F.col("end")).drop("block", "end")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_block: int = 4_000) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the
    next document's (or all it has).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.char_length("text")
    paired = with_next(rows, lambda r: with_vector(r, "text", "v"), rows_per_block)
    edited = paired.withColumn("edited", F.concat(F.left("text", n - F.floor(n / 2).cast("int")), F.left("next_text", F.floor(n / 2).cast("int"))))
    done = with_vector(edited, "edited", "e")
    return done.select(
        F.col("id").alias(id_col), n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), render(vector("v")).alias("fingerprint"), render(vector("e")).alias("edited_fingerprint"),
        likeness("v", "e").alias("near_edited"), likeness("v", "next_v").alias("near_next"),
    )
