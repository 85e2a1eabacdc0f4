"""PII surrogates: keyed, type-consistent replacements that keep format, script and gender.

Detected entities are replaced by a keyed permutation of the strings of their own format: digits stay
digits of their script, letters stay letters of the same case and script (vowels vowels in names, whose last letter, the
carrier of gender, stays as it is), separators stay. Given names of the lists below become others of the same list,
so of the same gender and script; an IBAN keeps its country and gets valid check digits; a secret keeps its
form (hexadecimal, a known prefix). A permutation maps different entities of a format
to different surrogates and the same entity always to the same one, so distinctness and coreference
hold over the whole corpus without a table of entities. Collision checks: a surrogate never equals
its entity (the permutation has no fixed point); results that a type does not allow (a card number whose
checksum is valid where the entity's is not, an address octet above 255) are walked over; and where two
entities of a text would share a surrogate, the later one walks on to the next free one. Addresses of
equal numbers, as 10.0.0.1 and 10.0.0.01, are one entity and share theirs.

Types: email, ip, phone, card (13 to 19 digits, as a mistyped card number is one, too), ssn, iban, secret, name. A name is any
number of words behind a title, or behind a given name of the lists:
initials, words that begin with a capital or with a letter of a script without case, and particles (von,
de la) between them, which stay. Its words are replaced one by one, and so is every other mention of one
of them in the same document that begins with a capital, so all mentions agree. Defined results: null stays
null and has no entities, an empty text stays empty; the time for an entity is linear in its length beyond
NUMBER_PLACES letters; of overlapping finds the earliest, then the longest, wins; null ids and
repeated rows are kept; an empty table gives an empty table. Only the id and the text are read. Decimal digits of every
script count as digits, so one number has surrogates of equal digits in each script.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to this many changeable characters, an entity is permuted as one number.
NUMBER_PLACES = 32
_DIGITS = "0123456789"
_HEX = "0123456789abcdef"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Letters that may stand for each other in names: vowels and consonants of a script.
_NAME_CLASSES = [
    "aeiou", "bcdfghjklmnprstvwz", "xqy", "àáâãäåèéêëìíîïòóôõöùúûü", "çñý",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "аеиоуэюя", "бвгджзклмнпрстфхцчшщ",
]
# Common given names by gender and script, no name in two lists. They name a person without a title.
GIVEN_NAMES = [
    "james john robert michael william david richard joseph thomas charles daniel matthew anthony steven andrew paul joshua kenneth kevin brian george edward jürgen wolfgang klaus günter stefan andreas matthias hans karl friedrich pierre jean jacques michel françois philippe julien antoine josé juan carlos luis antonio manuel miguel javier fernando diego".split(),
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret sandra ashley emily donna michelle carol amanda ursula monika petra sabine renate helga gisela ingrid brigitte katharina marie anne françoise catherine sylvie nathalie isabelle claire sophie camille maría carmen josefa isabel dolores pilar teresa lucía elena rosa".split(),
    "иван пётр сергей алексей андрей дмитрий николай михаил владимир александр павел юрий виктор олег игорь".split(),
    "мария анна елена ольга наталья екатерина татьяна ирина светлана людмила галина надежда вера юлия оксана".split(),
    "γιώργος γιάννης κώστας δημήτρης νίκος παναγιώτης βασίλης χρήστος".split(),
    "μαρία ελένη κατερίνα βασιλική σοφία αγγελική γεωργία ιωάννα".split(),
]
_GIVEN_LIST = {name: names for names in GIVEN_NAMES for name in names}


def _characters(*sets: tuple[str, ...]) -> Iterator[str]:
    """The characters of each set of categories, as ranges of a regular expression's set."""
    kinds = list(map(unicodedata.category, map(chr, range(0x80, sys.maxunicode + 1))))
    for categories in sets:
        out: list[list[int]] = []
        for c, kind in enumerate(kinds, 0x80):
            if kind in categories:
                if out and out[-1][1] == c - 1:
                    out[-1][1] = c
                else:
                    out.append([c, c])
        yield "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


def _places(pattern: str) -> Callable[[str], list[int]]:
    """A function of a text: where the pattern matches. One that begins with a set or with letters is searched much faster."""
    compiled = re.compile(pattern)
    return lambda text: [m.start() for m in compiled.finditer(text)]


def _any_of(words: Iterable[str]) -> str:
    """A pattern of these words, by their first letters."""
    rests: dict[str, list[str]] = {}
    for w in sorted(words):
        rests.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in rests.items())


_FIRST_KINDS = ("Lu", "Lt", "Lo")
_FIRST, _MARKS = _characters(_FIRST_KINDS, ("Mn", "Mc"))
_FIRST = "A-Z" + _FIRST
_GAP = r"[ \t\u00a0\u3000]+"
#: A word of a name; an 's behind it is not part of it.
_JOINERS = "'’-"
_REST = rf"(?:[\w{_MARKS}]|[{_JOINERS}](?!s\b)(?=\w))*+"
_WORD = rf"[{_FIRST}]{_REST}"
_INITIAL = rf"[{_FIRST}][{_MARKS}]*\."
_PARTICLES = rf"(?:(?:von|vom|van|der|den|de|del|della|di|da|do|dos|das|du|la|le|las|los|zu|zum|zur|ten|ter|af|av|bin|ibn|al|el|y|e){_GAP}){{0,3}}"
_TITLES = "Mr Mrs Ms Miss Dr Prof Herr Herrn Frau Señora Señor Sra Sr Madame Monsieur Mme".split()
_TITLE_STARTS = _places(rf"(?:{_any_of({*_TITLES, *(t.upper() for t in _TITLES)})})(?=[.\r\n \t\u00a0\u3000])")
_TITLES = "|".join(_TITLES + sorted({t.upper() for t in _TITLES}))
_PART = rf"(?!(?:{_TITLES})\b)(?:{_INITIAL}|{_WORD})"
_NAME = rf"{_PARTICLES}{_PART}(?:(?:(?<=\.)(?:{_GAP})?|{_GAP}){_PARTICLES}{_PART})*"
_GIVEN = sorted({form for name in _GIVEN_LIST for form in (name.capitalize(), name.upper())})
_GIVEN_STARTS = _places(rf"(?:{_any_of(_GIVEN)})(?=[- \t\u00a0\u3000])")
_GIVEN = "|".join(_GIVEN)
_ANY_WORD = re.compile(rf"[{_FIRST}](?<![\w{_MARKS}].){_REST}")
_IN_WORD = re.compile(rf"[\w{_MARKS}{_JOINERS}]")
#: Characters that may begin a word of a name, by the first character they fold to where it is another; none is above U+1FFFF.
_UNFOLDED: dict[str, str] = {}
for _ch in map(chr, range(0x20000)):
    if (_low := _ch.casefold()[0]) != _ch and unicodedata.category(_ch) in _FIRST_KINDS:
        _UNFOLDED[_low] = _UNFOLDED.get(_low, "") + _ch
_USER_CHARACTER = re.compile(r"[\w.+%-]")


def _user_starts(text: str) -> list[int]:
    """Where the run of characters of a user's name that ends before an @ begins."""
    out, at = [], text.find("@")
    while at >= 0:
        start = at
        while start and _USER_CHARACTER.match(text, start - 1):
            start -= 1
        out.append(start)
        at = text.find("@", at + 1)
    return out


#: Where a number may begin: +, ( or the first digit of a run.
_NUMBER_STARTS = _places(r"[+(\d](?<!\d\d)")
#: Type, what a text needs, places where alone the pattern can match, pattern.
PATTERNS: list[tuple[str, str, Callable[[str], bool], Callable[[str], list[int]], re.Pattern]] = [
    ("email", "", lambda t: "@" in t, _user_starts, re.compile(r"(?<![\w.+%-])[\w.+%-]++@[\w-]+(?:\.[\w-]+)+")),
    ("secret", "", lambda t: "=" in t or ":" in t, _places(r"[pP](?=[aAwW])|[tT](?=[oO])|[sSſ](?=[eE])|[aA](?=[pPcC])"), re.compile(r"(?i:password|passwd|pwd|token|secret|api[_ -]?key|access[_ -]?key)[\"']?\s*[=:]\s*[\"']?([^\s\"']{6,})")),
    ("secret", "1", lambda t: True, _places(r"[0-9a-fAg](?<!\w.)(?=[0-9a-fKh][0-9a-fIpousr])"), re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|[0-9a-f]{32,64})\b")),
    ("iban", "1", lambda t: True, _places(r"[A-Z](?<!\w.)(?=[A-Z]\d\d)"), re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", "1", lambda t: "." in t, _NUMBER_STARTS, re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")),
    ("phone", "1", lambda t: True, _NUMBER_STARTS, re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\w)")),
    ("ssn", "1", lambda t: "-" in t, _NUMBER_STARTS, re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", "1", lambda t: True, _NUMBER_STARTS, re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("name", "", lambda t: True, _TITLE_STARTS, re.compile(rf"\b(?:{_TITLES})\b\.?(?:{_GAP}|[ \t]*\r?\n[ \t]*)({_NAME})")),
    ("name", "", lambda t: True, _GIVEN_STARTS, re.compile(rf"(?<![\w{_MARKS}])((?:{_GIVEN})(?:(?:-(?:{_GIVEN}))?{_GAP}{_PARTICLES}{_PART})+)(?![\w{_MARKS}])")),
]
#: The digits beyond ASCII begin at U+0660.
_OTHER_DIGIT = re.compile(r"[\u0660-\U0010ffff](?<=\d)")


def _has_digit(text: str) -> bool:
    return any(map(text.__contains__, _DIGITS)) or not text.isascii() and bool(_OTHER_DIGIT.search(text))


def _matches(pattern: re.Pattern, text: str, places: list[int]) -> Iterator[re.Match]:
    """What pattern.finditer finds, where the pattern can only match at the places."""
    end = 0
    for place in places:
        if place >= end and (m := pattern.match(text, place)):
            end = m.end()
            yield m


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text, without overlaps."""
    found, digit, known = [], _has_digit(text), {}
    for kind, needs, may, places, pattern in PATTERNS:
        if needs and not digit or not may(text):
            continue
        if places not in known:
            known[places] = places(text)
        found += [(*m.span(pattern.groups), kind) for m in _matches(pattern, text, known[places])]
    found += _mentions(text, [text[a:b] for a, b, kind in found if kind == "name"])
    found.sort(key=lambda f: (f[0], -f[1]))
    out: list[tuple[int, int, str]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def _cased(text: str) -> bool:
    return text.lower() != text.upper()


@lru_cache(maxsize=10_000)
def _firsts(folded: str) -> Callable[[str], list[int]]:
    """A function of a text: places of the characters that may begin a word of a name and become one of these by case folding."""
    found = [c for f in folded for c in _UNFOLDED.get(f, "") + (f if unicodedata.category(f) in _FIRST_KINDS else "")]
    return _places(f"[{re.escape(''.join(found))}]") if found else lambda text: []


def _words_from(text: str, places: list[int]) -> Iterator[re.Match]:
    """Those matches of _ANY_WORD.finditer that begin at the places; each character is passed twice at most."""
    end = 0
    for place in places:
        at = place
        if place < end or place and text[place - 1] not in _JOINERS and _IN_WORD.match(text, place - 1):
            continue  # in a word
        while at > end and _IN_WORD.match(text, at - 1):  # a word that begins earlier may reach over the place
            at -= 1
        while at <= place:
            m = _ANY_WORD.match(text, at)
            if m and at == place:
                yield m
            at = m.end() if m else at + 1
        end = at


def _mentions(text: str, names: list[str]) -> Iterator[tuple[int, int, str]]:
    """All places of the words of names; initials are too short to tell."""
    words = {w for name in names for w in _ANY_WORD.findall(name) if len(w) > 1}
    cased = {w.casefold() for w in words if _cased(w)}
    if cased:
        firsts = "".join(sorted({w[0] for w in cased}))
        yield from ((*m.span(), "name") for m in _words_from(text, _firsts(firsts)(text)) if m[0].casefold() in cased)
    if len(cased) < len(words):  # scripts without case often have no spaces either
        others = sorted((w for w in words if not _cased(w)), key=lambda w: (-len(w), w))
        yield from ((*m.span(), "name") for m in re.finditer("|".join(map(re.escape, others)), text))


@lru_cache(maxsize=100_000)
def _alike(letter: str) -> str:
    """Letters of the same script, kind and block of 128 that are in no class of names; none if case would be lost."""

    def kind(ch: str) -> tuple:
        upper = ch.upper()
        return unicodedata.category(ch), unicodedata.name(ch, "").split(" ")[0], len(upper) == 1 and upper.lower() == ch

    if len(letter) != 1 or not letter.isalpha() or not (wanted := kind(letter))[2]:
        return ""
    block = ord(letter) & ~127
    return "".join(ch for ch in map(chr, range(block, block + 128)) if kind(ch) == wanted and not any(ch in c for c in _NAME_CLASSES))


def _identity(kind: str, text: str) -> object:
    """What makes two strings one entity: the numbers of an address, else the string."""
    return tuple(map(int, text.split("."))) if kind == "ip" else text


def _ascii_digit(ch: str) -> str:
    """The ASCII digit of a decimal digit of any script; other characters stay."""
    return ch if ch.isascii() or not ch.isdecimal() else chr(48 + unicodedata.decimal(ch))


def luhn_digit(digits: str) -> int:
    """The check digit behind these digits."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _has_given(word: str) -> bool:
    return any(part in _GIVEN_LIST for part in word.lower().split("-"))


def iban_check(country: str, account: str) -> str:
    """The two check digits of an account number."""
    return f"{98 - int(''.join(str(int(ch, 36)) for ch in account + country + '00')) % 97:02d}"


def secret_form(text: str) -> tuple[str, int, list[str]]:
    """(form, length of its prefix, classes of the characters behind it) of a secret; a surrogate has its secret's form."""
    known = re.match(r"AKIA|gh[pousr]_", text)
    if known:
        return known[0], known.end(), [_DIGITS, _LOWER]
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) and not text.isdecimal():
        return "hex" if text == text.lower() else "HEX", 0, [_HEX]
    return "any", 0, [_DIGITS, _LOWER]


def _side(size: int) -> int:
    """The longer side of a rectangle of at least size places: the root's ceiling, for large sizes the next power of two."""
    return isqrt(size - 1) + 1 if size <= 1 << 40 else 1 << ((size - 1).bit_length() + 1) // 2


class Surrogates:
    """Keyed replacements; the same key gives the same ones."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.of = lru_cache(maxsize=100_000)(self._of)

    def _round(self, tag: bytes, value: int, size: int) -> int:
        width = (size.bit_length() + 7) // 8 + 8
        data = tag + value.to_bytes((max(1, value.bit_length()) + 7) // 8, "little")
        stream = hashlib.blake2b(data + b"\0", key=self.key, digest_size=64).digest()
        for i in range(1, width // 64 + 1):
            stream += hashlib.blake2b(data + bytes([i]), key=self.key, digest_size=64).digest()
        return int.from_bytes(stream[:width], "little") % size

    def _feistel(self, tag: bytes, value: int, a: int, b: int, forward: bool) -> int:
        """A keyed permutation of [0, a * b)."""
        left, right = divmod(value, b)
        for r in range(8) if forward else range(7, -1, -1):
            if r % 2 == 0:
                shift = self._round(tag + bytes([r]), right, a)
                left = (left + (shift if forward else -shift)) % a
            else:
                shift = self._round(tag + bytes([r]), left, b)
                right = (right + (shift if forward else -shift)) % b
        return left * b + right

    def permute(self, tag: str, value: int, size: int) -> int:
        """A keyed permutation of [0, size) without a fixed point (if size > 1)."""
        if size < 2:
            return value
        b = _side(size)
        a, name = -(-size // b), tag.encode() + size.to_bytes((size.bit_length() + 7) // 8, "little")

        def walk(v: int, forward: bool) -> int:
            v = self._feistel(name, v, a, b, forward)
            while v >= size:
                v = self._feistel(name, v, a, b, forward)
            return v

        return walk((walk(value, True) + 1) % size, False)

    def _wide(self, tag: bytes, values: list[int], sizes: list[int]) -> list[int]:
        """A keyed permutation of strings of any length, in time linear in it: a Feistel network over the halves' characters."""
        half = len(values) // 2
        v, size = np.array(values, np.int64), np.array(sizes, np.int64)
        sides = (slice(0, half), slice(half, None))
        for r in range(8):
            mine, other = sides[r % 2], sides[1 - r % 2]
            seed = self.key + tag + bytes([r]) + v[other].astype("<u4").tobytes()
            stream = np.frombuffer(hashlib.shake_256(seed).digest(4 * len(v[mine])), "<u4")
            v[mine] = (v[mine] + stream) % size[mine]
        return v.tolist()

    def mapped(self, tag: str, text: str, classes: list[str], fixed: frozenset[int] = frozenset()) -> str:
        """Permutes the strings that have text's characters of the classes replaced by others of the same class and case."""
        places = []
        for i, ch in enumerate(text):
            if i in fixed:
                continue
            low = ch.lower()
            for c in [*classes, _alike(low)] if tag == "name" else classes:
                if low in c:
                    places.append((i, c, low != ch))
                    break
        kept = list(text)
        for i, _, _ in places:
            kept[i] = "\0"
        kept = "".join(kept)
        kept = kept.lower() if tag == "name" else kept  # SMITH as Smith
        tag += kept + "|".join(c for _, c, _ in places)
        values, sizes = [c.index(text[i].lower()) for i, c, _ in places], [len(c) for _, c, _ in places]
        if len(places) > NUMBER_PLACES:
            values = self._wide(hashlib.blake2b(tag.encode(), digest_size=16).digest(), values, sizes)
        else:
            value, size = 0, 1
            for v, n in zip(values, sizes, strict=True):
                value, size = value * n + v, size * n
            value = self.permute(tag, value, size)
            for k in range(len(sizes) - 1, -1, -1):
                value, values[k] = divmod(value, sizes[k])
        out = list(text)
        for v, (i, c, upper) in zip(values, places, strict=True):
            out[i] = c[v].upper() if upper else c[v]
        return "".join(out)

    def _walked(self, text: str, step: Callable[[str], str], allowed: Callable[[str], bool]) -> str:
        """step again until the result is allowed: step restricted to the allowed strings, of which text is one."""
        new = step(text)
        while not allowed(new):
            new = step(new)
        return new

    def _word_of_name(self, word: str) -> str:
        if "-" in word and _has_given(word):
            return "-".join(map(self._word_of_name, word.split("-")))
        low = word.lower()
        names = _GIVEN_LIST.get(low)
        if names:
            new = names[self.permute("given " + names[0], names.index(low), len(names))]
            return new.upper() if word == word.upper() and len(word) > 1 else new.capitalize()
        fixed = frozenset([len(word) - 1]) if len(word) > 2 and _cased(word[-1]) else frozenset()
        return self._walked(word, lambda w: self.mapped("name", w, _NAME_CLASSES, fixed), lambda w: not _has_given(w))

    def _iban(self, text: str) -> str:
        country, check, account = text[:2], text[2:4], text[4:]
        if iban_check(country, account) == check:
            new = self.mapped("iban" + country, account, [_DIGITS, _LOWER])
            return country + iban_check(country, new) + new
        step = lambda x: self.mapped("number" + country, x, [_DIGITS, _LOWER])
        return country + self._walked(check + account, step, lambda x: iban_check(country, x[2:]) != x[:2])

    def _of(self, kind: str, text: str) -> str:
        """Digits of other scripts are replaced as those of ASCII would be, and stand in their own script again."""
        plain = "".join(_ascii_digit(ch) for ch in text) if kind != "name" and not text.isascii() else text
        new = self._plain(kind, plain)
        if plain == text:
            return new
        zeros = [ord(ch) - unicodedata.decimal(ch) if ch != p else 0 for ch, p in zip(text, plain, strict=True)]
        if kind == "ip":  # its octets may have other lengths
            zeros = [next(filter(None, zeros))] * len(new)
        return "".join(chr(zero + ord(ch) - 48) if zero and ch in _DIGITS else ch for zero, ch in zip(zeros, new, strict=True))

    def _plain(self, kind: str, text: str) -> str:
        if kind == "email":
            user, _, domain = text.rpartition("@")
            *labels, top = domain.split(".")
            return self.mapped("user", user, [_DIGITS, _LOWER, *_NAME_CLASSES[3:]]) + "@" + ".".join([self.mapped("domain", x, [_DIGITS, _LOWER]) for x in labels] + [top])
        if kind == "ip":
            value = int.from_bytes(bytes(map(int, text.split("."))), "big")
            return ".".join(map(str, self.permute("ip", value, 1 << 32).to_bytes(4, "big")))
        if kind == "iban":
            rest = iter(self._iban(text.replace(" ", "")))
            return "".join(ch if ch == " " else next(rest) for ch in text)
        digits = "".join(ch for ch in text if ch in _DIGITS)
        if kind in ("phone", "card", "ssn"):
            keep = len(re.match(r"\+(\d{1,3})(?=\D)|", text)[1] or "") if kind == "phone" else 0
            if kind == "card" and luhn_digit(digits[:-1]) == int(digits[-1]):
                new = self.mapped("card", digits[:-1], [_DIGITS])
                new += str(luhn_digit(new))
            elif kind == "card":
                new = self._walked(digits, lambda d: self.mapped("number", d, [_DIGITS]), lambda d: luhn_digit(d[:-1]) != int(d[-1]))
            else:
                new = digits[:keep] + self.mapped(kind + digits[:keep], digits[keep:], [_DIGITS])
            rest = iter(new)
            return "".join(next(rest) if ch in _DIGITS else ch for ch in text)
        if kind == "name":
            return _ANY_WORD.sub(lambda m: self._word_of_name(m[0]), text)
        # all secrets share one set of strings, cut into forms that are mapped to themselves
        form, prefix, classes = secret_form(text)
        step = lambda x: self.mapped("secret" + form, x, classes, frozenset(range(prefix)))
        return self._walked(text, (lambda x: step(x.lower()).upper()) if form == "HEX" else step, lambda x: secret_form(x)[0] == form)

    def replace(self, text: str) -> tuple[str, list[dict]]:
        """The text with its entities replaced, and the replacements by code point of the old text."""
        parts, at, spans = [], 0, []
        seen: dict[tuple[str, str], object] = {}
        for start, end, kind in find_entities(text):
            old = text[start:end]
            who, new = _identity(kind, old), self.of(kind, old)
            while new == old or seen.setdefault((kind, new), who) != who:
                before, new = new, self.of(kind, new)
                if new == before:  # nothing in it can be replaced
                    break
            parts += [text[at:start], new]
            spans.append({"start": start, "end": end, "type": kind, "surrogate": new})
            at = end
        return "".join([*parts, text[at:]]), spans


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_entities, entities) of every document; entities: array<struct<start,end,type,surrogate>>."""
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            texts, spans = [], []
            for text in batch.column(1):
                t = text.as_py()
                new, found = (None, []) if t is None else surrogates.replace(t)
                texts.append(new)
                spans.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kinds)], [id_col, text_col, "n_entities", "entities"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string, n_entities long, entities array<struct<start:bigint,end:bigint,type:string,surrogate:string>>")
