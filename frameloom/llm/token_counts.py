"""Token counts by section and field, from one encoding of the whole document.

The fields of a document are joined with the separator and encoded once. Each token's span in the
text follows from the byte lengths of the tokens before it; spans are interval-joined to sections
(each ends behind a separator) and to fields. A token that crosses a boundary goes to the part that
holds most of its code points, the earliest of equals; a code point counts if any of its bytes lies in
the token, so part of a character counts as that character.

Defined results: null fields are empty; a document without text has one section of no tokens; null
ids and repeated rows are kept; an empty table gives an empty table. Only the id and the fields are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CachedEncoder, encoder


def token_bytes(enc: CachedEncoder) -> np.ndarray:
    """The number of bytes of each id's token (a byte-level token has a character per byte, an added one stands for its own text)."""
    if not hasattr(enc, "_token_bytes"):
        if not enc.known:
            raise ValueError("the tokens of this file are not byte-level, so their lengths in a text are not known from their ids")
        out = np.zeros(enc.vocab_size, np.int64)
        for token, i in enc.tokenizer.get_vocab().items():
            out[i] = len(token)
        for i, token in enc.tokenizer.get_added_tokens_decoder().items():
            if token.lstrip or token.rstrip:
                raise ValueError(f"the added token {token.content} takes in white space, so its length is not known from its id")
            out[i] = len(token.content.encode())
        enc._token_bytes = out
    return enc._token_bytes


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, buffer: np.ndarray) -> tuple[np.ndarray, int]:
    """(tokens of each part, number of tokens that cross a bound); bounds: first bytes of the parts after the first."""
    first, last = np.searchsorted(bounds, starts, "right"), np.searchsorted(bounds, ends - 1, "right")
    crossing = np.flatnonzero(first != last)
    for t in crossing:
        s, e = int(starts[t]), int(ends[t])
        while s > 0 and buffer[s] & 0xC0 == 0x80:  # back to the character that the token starts in
            s -= 1
        points = np.flatnonzero(buffer[s:e] & 0xC0 != 0x80) + s
        parts = np.searchsorted(bounds, points, "right")
        first[t] = int(np.bincount(parts - parts[0]).argmax()) + int(parts[0])
    return np.bincount(first, minlength=len(bounds) + 1), len(crossing)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), separator: str = "\n") -> DataFrame:
    """(id, n_tokens, n_sections, n_crossing, section_tokens, field_tokens) of every document; both lists sum to n_tokens."""
    sep = separator.encode()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        lengths = token_bytes(enc)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row in zip(*[batch.column(1 + k).to_pylist() for k in range(len(fields))], strict=True):
                parts = [(x or "").encode() for x in row]
                whole = sep.join(parts)
                buffer = np.frombuffer(whole, np.uint8)
                ends = np.cumsum(lengths[enc.encode(whole.decode())])
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                if len(sep) == 1:
                    bounds = np.flatnonzero(buffer == sep[0]) + 1
                else:
                    at, bounds = whole.find(sep), []
                    while at >= 0:
                        bounds.append(at + len(sep))
                        at = whole.find(sep, at + len(sep))
                    bounds = np.array(bounds, np.int64)
                bounds = bounds[bounds < len(whole)]
                sections, crossing = attribute(starts, ends, bounds, buffer)
                by_field, _ = attribute(starts, ends, np.cumsum([len(p) + len(sep) for p in parts[:-1]], dtype=np.int64), buffer)
                for column, value in zip(out, (len(ends), len(sections), crossing, sections, by_field), strict=True):
                    column.append(value)
            long, longs = pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(out, (long, long, long, longs, longs), strict=True)]], [id_col, "n_tokens", "n_sections", "n_crossing", "section_tokens", "field_tokens"])
        enc.forget()

    rows = docs.select(F.col(id_col), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)])
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_tokens long, n_sections long, n_crossing long, section_tokens array<bigint>, field_tokens array<bigint>")
