"""Language identification of mixed-language text.

Script ranges narrow the candidate languages of each word: those that do not use its script are removed. A
Viterbi pass over per-word scores with a switching penalty then labels spans. The document's language is the one
with the most letters; its score is the share of those letters, less the more the closer the runner-up is per word:
share * (1 - exp(-margin)), margin being how much better the language scores a word of its spans, in nats.

Defined results: a null, empty or letterless text gives ``und``, score 0 and no spans; a null id is
kept; repeated rows are labelled one by one; with no labelled row every text is ``und``; an empty
table gives an empty table. Ties go to the language first in code-point order. Columns other than
the id and the text are neither read nor returned, so their names cannot clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Score of a language that does not use a word's script: no text is long enough to outweigh it.
REMOVED = -1e6

# First code points of script ranges (Unicode blocks), joined where a script spans several.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0xFFE0, "other"), (0x20000, "han"),
]
_STARTS, _NAMES = [s for s, _ in SCRIPTS], [n for _, n in SCRIPTS]


def script_of(word: str) -> str:
    """The script of a word's first letter."""
    return _NAMES[bisect_right(_STARTS, ord(word[0])) - 1]


def grams(word: str) -> list[str]:
    """Trigrams of the lower-cased word with its ends marked."""
    w = f"^{word.lower()}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


@dataclass
class LanguageModel:
    """Trigram log-likelihoods by language, and the languages that use each script."""

    languages: list[str]
    gram_row: dict[str, int]
    weights: np.ndarray  # a row per trigram: log-likelihood less that of the row's best language
    by_script: dict[str, list[int]]
    switch_penalty: float = 10.0
    clip: float = 12.0
    max_cached_words: int = 400_000
    _row: dict[str, int] = field(default_factory=dict, repr=False)
    _scores: np.ndarray | None = field(default=None, repr=False)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row per word: score of each language, 0 for the best one; rows of unseen words are added to a bounded cache."""
        have_row = self._row
        new = {w for w in set(words) if w not in have_row}  # a set less a dict's keys would visit the whole dict
        if new:
            if len(self._row) + len(new) > self.max_cached_words:
                self._row, self._scores, new = {}, None, set(words)
            fresh, n = sorted(new), len(self._row)
            self._row.update(zip(fresh, range(n, n + len(fresh)), strict=True))
            have = self._scores if self._scores is not None else np.empty((0, len(self.languages)), np.float32)
            if n + len(fresh) > len(have):
                have = np.concatenate([have[:n], np.empty((max(len(fresh), n), len(self.languages)), np.float32)])
            have[n : n + len(fresh)] = self._score(fresh)
            self._scores = have
        rows = np.fromiter(map(self._row.__getitem__, words), np.int64, len(words))
        return self._scores[rows]

    def _score(self, words: list[str]) -> np.ndarray:
        unknown, get = len(self.weights) - 1, self.gram_row.get
        flat: list[int] = []
        starts = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            starts[i] = len(flat)
            flat += [get(g, unknown) for g in grams(w)]
        out = np.add.reduceat(self.weights[np.array(flat, np.int64)], starts, axis=0)
        removed = np.zeros(out.shape, bool)
        ascii_words = np.fromiter(map(str.isascii, words), bool, len(words))
        for script, rows in [("latin", ascii_words), *((script_of(words[i]), [i]) for i in np.flatnonzero(~ascii_words))]:
            allowed = self.by_script.get(script)
            if allowed is None:
                out[rows] = 0  # a script that no learned language uses tells nothing
            elif len(allowed) < len(self.languages):
                others = np.ones(len(self.languages), bool)
                others[allowed] = False
                removed[rows] = others
        out[removed] = -np.inf
        out -= out.max(axis=1, keepdims=True)
        return np.where(removed, np.float32(REMOVED), np.maximum(out, -self.clip))

    def path(self, scores: np.ndarray) -> np.ndarray | int:
        """The best language of every word: one number if it is the same for all.

        Take the best single language, and what a run of words gains in another. Let no run gain more
        than the penalty, nor a run from the start and one to the end together. A path that keeps the
        best language somewhere switches at least once for each run in another; one that never does
        switches once less, but begins and ends with such runs. Neither gains more than it pays, so
        the single language is the exact optimum and no pass is needed.
        """
        best = int(scores.sum(axis=0, dtype=np.float64).argmax())
        gain = np.vstack([np.zeros((1, scores.shape[1])), np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)])
        low = np.minimum.accumulate(gain)
        if (gain - low).max() <= self.switch_penalty and gain.max() + (gain[-1] - low[-1]).max() <= self.switch_penalty:
            return best
        return self._viterbi(scores)

    def _viterbi(self, scores: np.ndarray) -> np.ndarray:
        penalty, k = self.switch_penalty, len(self.languages)
        value, back, tops = [0.0] * k, [], []
        for row in scores.tolist():
            top = max(value)
            at = value.index(top)
            cut = top - penalty
            back.append([v >= cut for v in value])
            tops.append(at)
            value = [(v if v >= cut else cut) + s for v, s in zip(value, row, strict=True)]
        out, now = np.empty(len(scores), np.int64), value.index(max(value))
        for i in range(len(scores) - 1, -1, -1):
            out[i] = now
            if not back[i][now]:
                now = tops[i]
        return out

    def _sure(self, scores: np.ndarray, best: int) -> float:
        """1 - exp(-mean margin of a language over the runner-up) on these words."""
        total = np.maximum(scores, -self.clip).sum(axis=0, dtype=np.float64)
        margin = (total[best] - np.delete(total, best).max()) / len(scores) if len(total) > 1 else self.clip
        return float(-np.expm1(-max(margin, 0.0)))

    def label(self, text: str | None) -> tuple[str, float, list[dict]]:
        """(language, score, spans by code point) of a text."""
        words = WORD.findall(text) if text and self.languages else []
        if text and self.languages and not text.isascii():
            words = [w for w in words if any(map(str.isalpha, w))]
        if not words:
            return UNKNOWN, 0.0, []
        scores = self.word_scores(words)
        path = self.path(scores)
        if isinstance(path, int):
            first = WORD.search(text).start()
            return self.languages[path], self._sure(scores, path), [{"start": first, "end": text.rfind(words[-1]) + len(words[-1]), "lang": self.languages[path]}]
        letters = np.bincount(path, np.fromiter(map(len, words), np.int64, len(words)), len(self.languages))
        where = [m.span() for m in WORD.finditer(text) if any(map(str.isalpha, m[0]))]
        cuts = np.flatnonzero(np.diff(path)) + 1
        runs = zip([0, *cuts], [*cuts, len(words)], strict=True)
        best = int(letters.argmax())
        return self.languages[best], float(letters[best] / letters.sum()) * self._sure(scores[path == best], best), [{"start": where[a][0], "end": where[b - 1][1], "lang": self.languages[int(path[a])]} for a, b in runs]


def fit_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 400, min_count: int = 2, **options) -> LanguageModel:
    """Learns trigram weights from labelled rows.

    rows_per_language: the most texts that are expected to be sampled of each language (the documented bound of
    this fit); texts are drawn by their hash, so reruns learn alike, and copies of a text count once.
    """
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    unit = F.pmod(F.xxhash64("t"), F.lit(1 << 20))
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        keep = keep | ((F.col("l") == lang) & (unit < min(1 << 20, max(1, round((1 << 20) * rows_per_language / n)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        scripts: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch["t"].to_pylist(), batch["l"].to_pylist(), strict=True):
                words = Counter(WORD.findall(text))
                mine, by = seen.setdefault(lang, Counter()), scripts.setdefault(lang, Counter())
                for w, n in words.items():
                    by[script_of(w)] += n * len(w)
                    for g in grams(w):
                        mine[g] += n
        flat = [(lang, "g", g, n) for lang, c in seen.items() for g, n in c.items()] + [(lang, "s", s, n) for lang, c in scripts.items() for s, n in c.items()]
        for at in range(0, len(flat), 20_000):
            cols = list(zip(*flat[at : at + 20_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], ["lang", "kind", "item", "n"])

    parts = rows.where(keep).dropDuplicates(["l", "t"]).mapInArrow(count, "lang string, kind string, item string, n long")
    found = parts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).where(f"kind = 's' OR n >= {int(min_count)}").collect() if counts else []
    return build_model([tuple(r) for r in found], sorted(counts), **options)


def build_model(counts: list[tuple[str, str, str, int]], languages: list[str], smoothing: float = 0.2, least_script_share: float = 0.005, **options) -> LanguageModel:
    """counts: (language, 'g' for a trigram or 's' for a script, item, count)."""
    gram_row = {g: i for i, g in enumerate(sorted({item for _, kind, item, _ in counts if kind == "g"}))}
    at = {lang: i for i, lang in enumerate(languages)}
    n = np.zeros((len(gram_row), max(1, len(languages))))
    letters: dict[str, Counter] = {}
    for lang, kind, item, count in counts:
        if kind == "g":
            n[gram_row[item], at[lang]] = count
        else:
            letters.setdefault(lang, Counter())[item] = count
    logs = np.log((n + smoothing) / (n.sum(axis=0) + smoothing * max(1, len(gram_row))))
    weights = np.vstack([logs - logs.max(axis=1, keepdims=True), np.zeros((1, n.shape[1]))]).astype(np.float32)
    by_script: dict[str, list[int]] = {}
    for lang, c in letters.items():
        for script, k in c.items():
            if k >= least_script_share * sum(c.values()):
                by_script.setdefault(script, []).append(at[lang])
    return LanguageModel(languages, gram_row, weights, {s: sorted(v) for s, v in by_script.items()}, **options)


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, spans) of every whole text; spans cover it from the first to the last word of each run."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, spans = [], [], []
            for text in batch.column(1):
                lang, score, found = model.label(text.as_py())
                langs.append(lang)
                scores.append(score)
                spans.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)], [id_col, "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(label, f"`{id_col}` {kind}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text is of a learned language, which replaces lang_col; all other columns stay as they are.

    No column is added, so none can clash; each text is labelled once. Null, empty and letterless texts go.
    """
    text_at, lang_at, columns = docs.columns.index(text_col), docs.columns.index(lang_col), docs.columns

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([model.label(text.as_py())[0] for text in batch.column(text_at)], pa.string())
            arrays = [found if k == lang_at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, columns).filter(pc.not_equal(found, UNKNOWN))

    return docs.mapInArrow(label, T.StructType([T.StructField(lang_col, T.StringType()) if k == lang_at else f for k, f in enumerate(docs.schema.fields)]))
