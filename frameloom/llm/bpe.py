"""Byte-level BPE through the tokenizers library, with a bounded cache of words.

The library's pre-tokenizer always starts a new piece at a single space between two non-space
characters and around a single newline between two, and merges never cross pieces. So a text is cut
there, and the ids of each distinct word are asked from the library once. Texts that hold the string of
an added token, which the library finds before it splits, are left to the library whole, and so are all
texts where the file has a normalizer, another pre-tokenizer or a model whose pieces depend on their neighbours.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
#: Chunks of these characters alone are split into pieces here, as the library would; all others are left to the library.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_LETTERS, _OTHERS = "A-Za-zÀ-ÖØ-öø-ÿ", r"\s0-9A-Za-zÀ-ÖØ-öø-ÿ"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_OTHERS}]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


_MARKS = frozenset(".,;:!?")
_WORD = re.compile(f"[{_LETTERS}]+")


def _shown(piece: str) -> str:
    """A piece in the vocabulary's characters."""
    return piece.encode().decode("latin-1").translate(_BYTE_LETTERS)


class _UnsafeError(Exception):
    """A chunk that has white space at its ends: the text cannot be cut there."""


class _Cache(dict):
    """Values of a function in two generations of bounded size."""

    def __init__(self, of, limit: int):
        super().__init__()
        self.of, self.limit, self.old = of, limit, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.of(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


def _splits_as_assumed(settings: dict) -> bool:
    """Whether a tokenizer file asks for byte-level BPE as the cuts above assume it."""
    split, model = settings.get("pre_tokenizer") or {}, settings["model"]
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    return not settings.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and model.get("type") == "BPE" and plain


class CachedEncoder:
    """Encodes whole texts as the library does by default (special tokens not added, but found where a text holds their strings)."""

    def __init__(self, path: str, max_cached: int = 300_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.known = _splits_as_assumed(json.loads(self.tokenizer.to_str()))
        self.vocab_size = self.tokenizer.get_vocab_size()
        self._tokenize = self.tokenizer.model.tokenize
        self._split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self._pieces = _Cache(self._piece, max_cached)
        self._words = _Cache(self._behind_space, max_cached)
        self._bytes = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values(), default=-1))]
        self._newline = self._ids("\n") if self.known else b""

    def forget(self) -> None:
        """Empties the caches: workers live on, and later stages may need their memory."""
        for cache in (self._pieces, self._words):
            cache.clear()
            cache.old = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece in the vocabulary's characters."""
        known = self._bytes
        return b"".join([known[t.id] for t in self._tokenize(piece)])

    def _ids(self, chunk: str) -> bytes:
        """Ids of a chunk that may begin with a space."""
        if _PLAIN.fullmatch(chunk, 1 if chunk[0] == " " else 0):
            pieces = [_shown(p) for p in _PIECES.findall(chunk)]
        else:
            pieces = [p for p, _ in self._split(chunk)]
        return b"".join(map(self._pieces.__getitem__, pieces))

    def _behind_space(self, chunk: str) -> bytes:
        """Ids of a word that stood behind a space, or of a newline and the word behind it."""
        if chunk.isascii():  # a word of letters, or one with a mark behind it
            if chunk.isalpha():
                return self._piece("Ġ" + chunk)  # kept by this cache alone
            if chunk[-1:] in _MARKS and chunk[:-1].isalpha():
                return self._words[chunk[:-1]] + self._pieces[chunk[-1]]
        elif _WORD.fullmatch(chunk):
            return self._piece("Ġ" + _shown(chunk))
        elif chunk[-1] in _MARKS and _WORD.fullmatch(chunk, 0, len(chunk) - 1):
            return self._words[chunk[:-1]] + self._pieces[chunk[-1]]
        word = chunk[1:] if chunk.startswith("\n") else chunk
        if not word or word[0].isspace() or word[-1].isspace():
            raise _UnsafeError
        return self._newline + self._ids(word) if chunk.startswith("\n") else self._ids(" " + word)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not text:
            return np.empty(0, "<u4")
        if not self.known or self._added(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        first, *chunks = text.replace("\n", " \n").split(" ")
        if first and not first[0].isspace() and not first[-1].isspace():
            try:
                return np.frombuffer(self._ids(first) + b"".join(map(self._words.__getitem__, chunks)), "<u4")
            except _UnsafeError:
                pass
        return np.frombuffer(b"".join(map(self._ids, _SAFE_CUT.split(text))), "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder:
    """One encoder per worker process and vocabulary file."""
    return CachedEncoder(path)
