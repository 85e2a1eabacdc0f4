"""Token alignment against plain loops over the libraries' own tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frameloom.llm import alignment
from frameloom.llm.queries import PIECES, TOKENIZER, queries

SF = "/root/testdata/sf0.001"
_A = Tokenizer.from_file(TOKENIZER)
_A.encode_special_tokens = True
_B = sentencepiece.SentencePieceProcessor(model_file=PIECES)
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _tokens(text):
    if not text:
        return [], []
    a = [(i, bytes(_BYTE[c] for c in _A.id_to_token(i))) for i in _A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(_B.id_to_piece(i)[3:-1], 16)]) if _B.is_byte(i) else _B.id_to_piece(i).replace("▁", " ").encode()) for i in _B.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(t for _, t in a) == b"".join(t for _, t in b) == whole else ([], [])


def _brute(docs):
    """{key: row} of [(key, text)]."""
    found, counts = {}, Counter()
    for key, text in docs:
        a, b = _tokens(text)
        links, groups, i, j, at_a, at_b, held = [], [], 0, 0, 0, 0, ([], [])
        spans = [[], []]
        for k, side in enumerate((a, b)):
            at = 0
            for token, raw in side:
                spans[k].append((at, at + len(raw), token))
                at += len(raw)
        for s, e, x in spans[0]:
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    links.append((x, spans[1][j][2]))
                j += 1
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        start = 0
        for end in ends:
            groups.append(",".join(str(x) for s, e, x in spans[0] if start < e <= end) + "|" + ",".join(str(x) for s, e, x in spans[1] if start < e <= end)) if len(a) < 3000 else None
            start = end
        found[key] = (len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "", len(a) < 3000)
        counts.update(set(links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return {k: (na, nb, ng, len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), h, whole) for k, (na, nb, ng, ls, h, whole) in found.items()}, counts, best


def _same(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        *numbers, digest, whole = want[r["doc_id"]]
        assert [r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] == numbers, r
        assert not whole or r["groups_sha256"] == digest


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    _same(queries()["op13_alignment"](spark, SF).collect(), _brute(docs)[0])


HARD = ["", "a", "  two  spaces ", "tab\tand\nline\r\n", "▁mark", "Grüße 東京 🎉🎉", "<|endoftext|> is <s> text </s> <0x41>", "x" * 5_000, "العربية हिन्दी ١٢٣", "\x00\x01", "ﬁ ﬂ", "a" * 7 + " " * 9, "ab " * 3_000]


def test_hard_texts_in_small_stripes_and_parts(spark, monkeypatch):
    docs = [(i, t) for i, t in enumerate(HARD + HARD[1:4])] + [(100, None)] + [(200 + i, "the cat sat on the mat") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_a", F.lit("clash")).withColumn("chunk", F.lit(1))
    want, counts, best = _brute(docs)
    for partitions, cells, links in ((1, 1 << 25, 1 << 24), (7, 40, 100)):
        _same(alignment.align_tokenizers(df.repartition(partitions), TOKENIZER, PIECES, stripes=50, task_cells=cells, task_links=links).collect(), want)
    of = alignment.words(TOKENIZER, PIECES, 50).of
    table = alignment.pair_table(alignment.count_pairs(alignment.encode_links(df, TOKENIZER, PIECES, "doc_id", "text", 50), of.cells), of.n_b, 50).collect()
    assert {(r["a"], r["b"]): r["n_docs"] for r in table} == dict(counts)
    assert all(r["best"] == (r["n_docs"] == best[r["a"]]) for r in table)


def test_null_and_repeated_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (1, None), (1, "one")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_a"], r["n_links"]) for r in alignment.align_tokenizers(df, TOKENIZER, PIECES).collect())
    assert got[:2] == [(0, 2, 2), (0, 2, 2)] and got[2:] == [(1, 0, 0), (1, 1, 1)]
    assert alignment.align_tokenizers(df.where("false"), TOKENIZER, PIECES).count() == 0
    with pytest.raises(FileNotFoundError):
        alignment.align_tokenizers(df, TOKENIZER, "/nowhere.model")


def test_many_chunks_and_small_counts(spark, monkeypatch):
    of = alignment.Sides(TOKENIZER, PIECES, 197)
    pairs = alignment.PairCounts(of.bits)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 3)
    rng, want = np.random.default_rng(1), Counter()
    for _ in range(20):
        keys, n = np.unique(rng.integers(0, 4 << of.bits, 5), return_counts=True)
        pairs.add(keys, n)
        want.update(dict(zip(keys.tolist(), n.tolist())))
    got = Counter()
    for s, cells, n, _ in pairs.flush():
        got.update(dict(zip((np.frombuffer(cells, "<u4").astype(np.int64) + (s << of.bits)).tolist(), np.frombuffer(n, "<i8").tolist())))
    assert got == want and not pairs.parts
