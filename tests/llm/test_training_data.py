"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on hard rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameloom.llm import chat_format, decontaminate, fingerprints, graph, language_id, license_scan, mixing, near_dedup, queries, surrogates, token_counts, token_files
from frameloom.llm.bpe import CachedEncoder
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, score double"
HARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\n ", "en", "a"), (4, "one two three", "en", None), (4, "one two three", "en", None), (5, "a b c d e f g", None, "b"),
    (6, "a b c d e f g", "de", "b"), (7, "  double  spaces \n\n and\ttabs\r\n", "en", "b"), (8, "word " * 20_000, "en", "c"), (None, "null id text here", "en", "c"), (9, "emoji 🙂 é 中文 текст ²", "fr", "d"),
    (10, "x" * 5000, "en", "d"), (-3, "negative id", "en", "d"),
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "extra", 0.5) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def hard(spark):
    return docs(spark, HARD)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


# 1 language identification


def test_language_of_held_out_documents(spark, real):
    got = queries.op1_language_id(spark, SF).join(real.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == real.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_spans_of_mixed_text_and_hard_rows(spark, real, hard):
    model = language_id.fit_language_model(real)
    by = {r["lang"]: r["t"] for r in real.where("length(text) > 400 AND length(text) < 3000").groupBy("lang").agg(F.min("text").alias("t")).collect()}
    text = by["en"][:300] + ". " + by["de"][:300]
    lang, score, spans = model.label(text)
    assert {s["lang"] for s in spans} == {"en", "de"} and abs(spans[0]["end"] - 300) < 40 and score < 1
    got = {r["doc_id"]: r for r in language_id.identify_languages(hard, model).collect()}
    assert len(got) == len({i for i, *_ in HARD})
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[1]["spans"] == []
    nothing = language_id.fit_language_model(hard.where("false"))
    assert {r["lang_pred"] for r in language_id.identify_languages(hard, nothing).collect()} == {"und"}
    assert language_id.identify_languages(hard.where("false"), model).count() == 0


def test_path_equals_full_viterbi():
    rng = np.random.default_rng(0)
    model = language_id.LanguageModel(list("abc"), {}, np.zeros((1, 3), np.float32), {})
    for _ in range(200):
        scores = -rng.exponential(4, (rng.integers(1, 40), 3)).astype(np.float32)
        scores -= scores.max(axis=1, keepdims=True)
        total = lambda p: sum(float(scores[i, k]) for i, k in enumerate(p)) - model.switch_penalty * sum(a != b for a, b in zip(p, p[1:]))
        path = model.path(scores)
        path = [path] * len(scores) if isinstance(path, int) else list(path)
        assert abs(total(path) - total(list(model._viterbi(scores)))) < 1e-3


def test_path_equals_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    model = language_id.LanguageModel(list("abc"), {}, np.zeros((1, 3), np.float32), {}, switch_penalty=4.0)
    for _ in range(120):
        scores = -rng.exponential(3, (rng.integers(1, 7), 3)).astype(np.float32)
        scores -= scores.max(axis=1, keepdims=True)
        scores[rng.random(scores.shape) < 0.05] = language_id.REMOVED
        total = lambda p: sum(float(scores[i, k]) for i, k in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(map(total, itertools.product(range(3), repeat=len(scores))))
        path = model.path(scores)
        assert abs(total([path] * len(scores) if isinstance(path, int) else list(path)) - best) < 1e-3 * max(1, abs(best) / 1e4)


def test_scores_tell_sure_from_unsure(spark, real):
    model = language_id.fit_language_model(real)
    sure, unsure = model.label("the weather and the question that they have with this")[1], model.label("zzq")[1]
    assert 0 <= unsure < sure <= 1
    copies = real.where("lang = 'en'").limit(1).select("text", "lang").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("n")
    assert language_id.fit_language_model(copies).languages == ["en"]


def test_identified_rows_keep_their_columns(spark, real):
    model = language_id.fit_language_model(real)
    df = spark.createDataFrame([(1, "the cat and the dog are with you", "xx"), (2, None, "xx"), (3, "12 34", "xx")], "doc_id long, text string, lang string").selectExpr("*", "map('k', 1) AS lang_pred", "1 AS __lang_pred", "2 AS score")
    out = language_id.keep_identified(df, model)
    assert out.columns == df.columns and [(r["doc_id"], r["lang"], r["lang_pred"]) for r in out.collect()] == [(1, "en", {"k": 1})]


def test_scripts_narrow_languages():
    counts = [("ru", "g", "^да", 5), ("ru", "g", "да$", 5), ("ru", "s", "cyrillic", 50), ("en", "g", "^ye", 5), ("en", "s", "latin", 50)]
    model = language_id.build_model(counts, ["en", "ru"])
    assert model.label("да нет")[0] == "ru" and model.label("yes")[0] == "en"
    assert [s["lang"] for s in model.label("да нет yes да")[2]] == ["ru", "en", "ru"]  # no penalty outweighs a script


# 2 fingerprints


def test_fingerprints_are_homomorphic(spark):
    rows = spark.createDataFrame([("a\nb c. d", "e\nf", "f\ne\nb c. d\na", "a\nb c. d\ne\nf")], "x string, y string, both string, same string")
    for name in ("x", "y", "both", "same"):
        rows = fingerprints.with_vector(rows, name, name)
    v = {n: fingerprints.vector(n) for n in ("x", "y", "both", "same")}
    added, removed = fingerprints.combine(v["x"], v["y"]), fingerprints.combine(v["same"], v["y"], -1)
    r = rows.select(fingerprints.render(added).alias("added"), fingerprints.render(v["both"]).alias("both"), fingerprints.render(removed).alias("removed"), fingerprints.render(v["x"]).alias("x"), fingerprints.likeness("both", "same").alias("like")).first()
    assert r["added"] == r["both"] and r["removed"] == r["x"] and r["like"] == 1.0


def test_edited_texts_of_hard_rows(spark, hard):
    for per_block in (4_000, 3):
        got = fingerprints.fingerprint_documents(hard, rows_per_block=per_block).collect()
        order = sorted(HARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
        want = Counter()
        for (i, t, *_), (_, u, *_) in zip(order, order[1:] + order[:1]):
            t, u = t or "", u or ""
            want[i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()] += 1
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.fingerprint_documents(hard.where("false")).count() == 0
    assert fingerprints.fingerprint_documents(hard.where("doc_id = 5")).first()["near_next"] == 1.0


# 3 chat formatting


def test_events_fold_into_messages(spark):
    events = [
        ("c", "m1", 1, "message", "user", "hi"), ("c", "m2", 2, "message", "assistant", ""), ("c", "m2", 3, "delta", None, "Hel"), ("c", "m2", 4, "delta", None, "lo"),
        ("c", "m3", 5, "message", "user", "more"), ("c", "m2", 6, "regenerate", None, None), ("c", "m2", 7, "delta", None, "Bye"), ("c", "m4", 8, "message", "user", "next"),
        ("c", "m1", 9, "edit", None, "hey"), ("c", "m5", 10, "message", "user", "x"), ("c", "m5", 11, "delete", None, None), (None, "m", 1, "message", None, None), ("d", "q", 2, "delta", "assistant", "lone"),
    ]
    df = spark.createDataFrame(events, "conv_id string, message_id string, seq long, kind string, role string, text string")
    got = {r["conv_id"]: [(m["role"], m["text"]) for m in r["messages"]] for r in chat_format.reconstruct(df).collect()}
    assert got == {"c": [("user", "hey"), ("assistant", "Bye"), ("user", "next")], None: [("", "")], "d": [("assistant", "lone")]}
    assert chat_format.reconstruct(df.where("false")).count() == 0


def _fold(events):
    """Messages of one conversation, event by event: [(seq, part, role, text)]."""
    by, cuts = defaultdict(list), []
    first = lambda x: (x is not None, x or 0)
    for m, seq, part, kind, role, text in sorted(events, key=lambda e: (first(e[1]), e[2], e[3], e[4] or "", e[5] or "")):
        done, text = by[m], text or ""
        if kind == "message" or not done:
            done.append([(first(seq), part), seq, role or "", "" if kind in ("regenerate", "delete") else text, kind != "delete"])
        else:
            last = done[-1]
            last[3] = {"delta": last[3] + text, "edit": text, "regenerate": ""}.get(kind, last[3])
            last[4] = kind != "delete"
        if kind == "regenerate":
            cuts.append((done[0][0], (first(seq), part)))
    left = [m for done in by.values() for m in done if m[4] and not any(a < m[0] < b for a, b in cuts)]
    return [(m[1], m[2], m[3]) for m in sorted(left, key=lambda m: (m[0], m[2], m[3]))]


def test_random_event_logs_fold_as_a_loop_does(spark):
    rng = random.Random(6)
    rows = []
    for c in range(60):
        for _ in range(rng.randint(1, 25)):
            rows.append((rng.choice([c, None]) if c == 7 else c, rng.randint(0, 4), rng.choice([None, *range(12)]), rng.randint(0, 2), rng.choice(["message", "delta", "delta", "edit", "regenerate", "delete"]), rng.choice(["user", "assistant", None]), rng.choice(["x", "yy", "", None])))
    df = spark.createDataFrame(rows, "conv_id long, message_id long, seq long, part long, kind string, role string, text string").selectExpr("*", "map('k', 1) AS c", "1 AS es", "2 AS ms")
    got = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in chat_format.reconstruct(df, part="part").collect()}
    want = defaultdict(list)
    for c, *event in rows:
        want[c].append(event)
    assert got == {c: _fold(events) for c, events in want.items()}


def test_spans_of_many_turns(spark):
    df = spark.range(3).selectExpr("id AS conv_id", "transform(sequence(1, CAST(id * 700 + 1 AS INT)), i -> named_struct('seq', CAST(i AS BIGINT), 'role', IF(i % 3 = 0, 'assistant', 'user'), 'text', repeat('é<turn', i % 5))) AS messages")
    out = chat_format.render(df.unionByName(spark.sql("SELECT 9L AS conv_id, CAST(array() AS array<struct<seq:bigint,role:string,text:string>>) AS messages")))
    for r in out.select("conv_id", "formatted", chat_format.masked_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        n = r["conv_id"] * 700 + 1 if r["conv_id"] < 9 else 0
        assert r["loss"] == ["é<turn" * (i % 5) for i in range(1, n + 1) if i % 3 == 0] and r["formatted"].count("</turn>\n") == n


def test_event_log_of_conversations_leaves_them(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "word " * 300), (1, 1, "assistant", "word " * 300), (1, None, None, None), (1, 2, "assistant", None), (None, 5, "assistant", "é🙂" * 250), (1, -3, "user", "")]
    events = queries.chat_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["kind"] for r in events.select("kind").collect()} == {"message", "delta", "edit", "regenerate"}
    got = {r["conv_id"]: [(m["seq"], m["role"], m["text"]) for m in r["messages"]] for r in chat_format.reconstruct(events, part="part").collect()}
    want = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        want[c].append((turn, role or "", text or ""))
    assert got == want


def test_formatting_round_trips_any_text(spark):
    pieces = ["<turn>", "</turn>\n", "\\", "\\\\", "<\\turn", "%0A", "\n", "é🙂", "</turn", "a", "<", "", "\\n"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "od<d\n%role"]), "".join(rng.choices(pieces, k=rng.randint(0, 8)))) for c in range(60) for t in range(rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("conv_id", "turn AS message_id", "turn AS seq", "'message' AS kind", "role", "text")
    out = chat_format.render(chat_format.reconstruct(df)).select("conv_id", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.masked_texts(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    want = defaultdict(list)
    for c, _, role, text in rows:
        want[c].append((role, text))
    for r in out.collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == want[r["conv_id"]]
        assert r["loss"] == [t for role, t in want[r["conv_id"]] if role == "assistant"]


# 4 PII surrogates


def test_surrogates_keep_format_distinctness_and_coreference(spark, hard):
    text = "Mail ann.b@mail3.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111 and 5927243074273351, host 10.0.0.7, again ann.b@mail3.example.com; Mrs Maria Lopez, Frau Greta. token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" ssn 123-45-6789"
    s = surrogates.Surrogates(b"k")
    new, spans = s.replace(text)
    assert Counter(x["type"] for x in spans) == {"email": 2, "phone": 1, "card": 2, "ip": 1, "name": 2, "secret": 1, "ssn": 1}
    for x in spans:
        old = text[x["start"] : x["end"]]
        assert old not in new and re.sub(r"\d", "0", re.sub(r"[^\W\d_]", "a", old)) == re.sub(r"\d", "0", re.sub(r"[^\W\d_]", "a", x["surrogate"])) or x["type"] in ("ip", "secret")
    assert new.count(spans[0]["surrogate"]) == 2 and surrogates.Surrogates(b"k").replace(text)[0] == new != surrogates.Surrogates(b"other").replace(text)[0]
    names = [x["surrogate"] for x in spans if x["type"] == "name"]
    assert all(n.endswith(e) for n, e in zip(names, ("z", "a"))) and names[0].split()[0].endswith("a")
    got = {r["doc_id"]: r for r in surrogates.replace_pii(hard, b"k").collect()}
    assert got[1]["text"] is None and got[4]["text"] == "one two three" and got[9]["n_entities"] == 0
    assert surrogates.replace_pii(hard.where("false"), b"k").count() == 0


@pytest.mark.parametrize(
    ("text", "hidden"),
    [
        ("Dr. John Fitzgerald Kennedy spoke", "John Fitzgerald Kennedy"), ("ask Mr. J. Smith now", "J. Smith"), ("Mrs. Łucja Nowak came", "Łucja Nowak"), ("to MR. SMITH today", "SMITH"),
        ("Prof. J.R.R. Tolkien wrote", "J.R.R. Tolkien"), ("Frau von der Leyen sagt", "Leyen"), ("Dr. 王小明 spoke", "王小明"), ("Mr. Արամ Խաչատրյան", "Արամ Խաչատրյան"), ("Dr. आरती here", "आरती"), ("Herr Dr. Max Weber ging", "Max Weber"), ("Mr. and Mrs. Smith came", "Smith"),
    ],
)
def test_whole_names_are_found(text, hidden):
    new, spans = surrogates.Surrogates(b"k").replace(text)
    assert [s["type"] for s in spans] == ["name"] and text[spans[0]["start"] : spans[0]["end"]].endswith(hidden)
    assert not any(w in new for w in re.findall(r"\w{2,}", hidden)) and re.sub(r"\w", "", new) == re.sub(r"\w", "", text)


def test_mentions_of_a_name_agree():
    s = surrogates.Surrogates(b"k")
    new, spans = s.replace("Smith wrote. Mr. John Smith came. Smith said SMITH and Smith's smith saw Smithson. Dr. 王明 said. 王明 left.")
    name = spans[0]["surrogate"]
    assert len(spans) == 7 and spans[1]["surrogate"].endswith(" " + name)
    assert re.findall(r"\w+", new)[:13] == [name, "wrote", "Mr", spans[1]["surrogate"].split()[0], name, "came", name, "said", name.upper(), "and", name, "s", "smith"]
    assert "Smithson" in new and "王明" not in new and new.count(spans[-1]["surrogate"]) == 2
    assert [x["type"] for x in s.replace("Mr. Smith and Mrs. Jones")[1]] == ["name", "name"]
    assert len({s.of("name", w) for w in ("Łucja", "Lucja", "Žofia", "Żofia", "Zofia")}) == 5


def test_equal_addresses_and_shared_surrogates_do_not_end_the_run(spark):
    got = surrogates.replace_pii(docs(spark, [(1, "host 10.0.0.1 or 10.0.0.01, not 10.0.0.2", None, None)]), b"k").first()
    a, b, c = [x["surrogate"] for x in got["entities"]]
    assert a == b != c and not {a, c} & {"10.0.0.1", "10.0.0.2"}
    s, inner = surrogates.Surrogates(b"k"), surrogates.Surrogates(b"k").of
    s.of = lambda kind, t: "token11" if t in ("secret1", "secret2") else inner(kind, t)
    new, spans = s.replace("token=secret1 token=secret2 token=secret1")
    x, y, z = [e["surrogate"] for e in spans]
    assert x == z == "token11" != y and y not in ("secret1", "secret2")


@pytest.mark.parametrize(
    ("text", "hidden"),
    [("yesterday John Smith said", "John Smith"), ("что Иван Петров сказал", "Иван Петров"), ("here MARIA LOPEZ signed", "MARIA LOPEZ"), ("with Jean-Pierre de la Cour there", "Jean-Pierre de la Cour"), ("by Γιώργος Παπαδόπουλος there", "Γιώργος Παπαδόπουλος")],
)
def test_names_without_titles_get_names_of_their_list(text, hidden):
    new, spans = surrogates.Surrogates(b"k").replace(text.replace("MARIA", "MARY"))
    hidden = hidden.replace("MARIA", "MARY")
    assert [s["type"] for s in spans] == ["name"] and spans[0]["end"] - spans[0]["start"] == len(hidden)
    first, other = re.match(r"\w+", hidden)[0], re.match(r"\w+", spans[0]["surrogate"])[0]
    mine = next(names for names in surrogates.GIVEN_NAMES if first.lower() in names)
    assert other.lower() in mine and other != first and other.isupper() == first.isupper()
    every = [n for names in surrogates.GIVEN_NAMES for n in names]
    assert len(every) == len(set(every)) and not any(n in surrogates.Surrogates(b"k").replace("The Mark On it. John is here. Rose And thorn")[0] for n in ["Jon"])


def test_surrogates_of_every_short_secret_are_distinct():
    s = surrogates.Surrogates(b"k")
    texts = ["".join(x) for x in itertools.product("ab12Z", repeat=4)] + ["".join(x) for x in itertools.product("0123456789abcdef", repeat=3)] + ["AKIA" + x for x in "AB01"]
    image = [s.of("secret", t) for t in texts]
    assert len(set(image)) == len(set(texts)) and all(surrogates.secret_form(a)[0] == surrogates.secret_form(b)[0] for a, b in zip(texts, image))


def test_ibans_keep_country_and_validity():
    s, rng = surrogates.Surrogates(b"k"), random.Random(4)
    assert surrogates.iban_check("DE", "370400440532013000") == "89"
    seen = {}
    for k in range(200):
        account = "".join(rng.choices("0123456789", k=18))
        text = "DE" + (surrogates.iban_check("DE", account) if k % 2 else f"{rng.randrange(100):02d}") + account
        new = s.of("iban", text)
        valid = lambda t: surrogates.iban_check(t[:2], t[4:]) == t[2:4]
        assert new[:2] == "DE" and valid(new) == valid(text) and seen.setdefault(new, text) == text
        spaced = " ".join(text[i : i + 4] for i in range(0, len(text), 4))
        assert s.of("iban", spaced).replace(" ", "") == new


def test_long_entities_and_wide_permutations():
    s = surrogates.Surrogates(b"k")
    for sizes in ([2, 3, 2], [3, 2, 2, 2], [5, 4]):
        every = [list(x) for x in itertools.product(*map(range, sizes))]
        image = [tuple(s._wide(b"t", x, sizes)) for x in every]
        assert sorted(image) == sorted(map(tuple, every))
    for n in (33, 4_000, 300_000):
        text = "token=" + "".join(random.Random(n).choices("abcXYZ019", k=n))
        new, spans = s.replace(text)
        assert len(new) == len(text) and new != text and [x["type"] for x in spans] == ["secret"]
        assert [(a.isdigit(), a.isupper()) for a in text[6:]] == [(a.isdigit(), a.isupper()) for a in new[6:]]


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_permutation_is_a_bijection_without_fixed_points(size):
    s = surrogates.Surrogates(b"key")
    image = [s.permute("t", v, size) for v in range(size)]
    assert sorted(image) == list(range(size)) and all(v != w for v, w in enumerate(image))


def test_cards_keep_checksum_validity():
    s, rng = surrogates.Surrogates(b"key"), random.Random(0)
    seen = {}
    for _ in range(300):
        digits = "".join(rng.choices("0123456789", k=16))
        if rng.random() < 0.5:
            digits = digits[:-1] + str(surrogates.luhn_digit(digits[:-1]))
        valid = lambda d: surrogates.luhn_digit(d[:-1]) == int(d[-1])
        new = s.of("card", digits)
        assert valid(new) == valid(digits) and new != digits and seen.setdefault(new, digits) == digits


# 5 token files, 7 token counts


def test_cached_encoder_equals_the_library(real):
    enc = CachedEncoder(queries.TOKENIZER)
    texts = [r["text"] for r in real.select("text").collect()] + [t for _, t, *_ in HARD if t] + ["<|endoftext|> a", "don't  we'll\n's", " lead", "trail \n", "a\n b", "x\n\n\ny", "a b  c\x1cd"]
    for t in texts:
        assert enc.encode(t).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t[:80]


def test_encoder_of_another_kind_is_left_to_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    enc, plain = CachedEncoder(path), Tokenizer.from_file(path)
    for t in ("Hello  World\n it's <|endoftext|> É", "", "a b\tc"):
        assert enc.encode(t).tolist() == (plain.encode(t, add_special_tokens=False).ids if t else [])
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.token_bytes(enc)


def test_encoder_equals_an_unmodified_tokenizer(real):
    from tokenizers import Tokenizer

    enc, plain = CachedEncoder(queries.TOKENIZER, 500), Tokenizer.from_file(queries.TOKENIZER)
    rng = random.Random(13)
    pieces = ["<|endoftext|>", "<|endof", "a", " ", "  ", "\n", "\n\n", "\t", "word", "Word.", "é", "中", "🙂", "'s", "12", "...", "\u00a0", "²"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(3000)] + [r["text"] or "" for r in real.select("text").collect()]
    for t in texts:
        assert enc.encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t[:80]


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (5, 3), (1000, 300), (4001, 70_000), (200_000, 17_000_000)):
        ids = (rng.pareto(1, n) * 3).astype(np.int64) % top if top > 3 else rng.integers(0, top, n)
        raw = b"".join(token_files.encode_block(ids.astype("<u4")))
        k, r, c, d = np.frombuffer(raw[:16], "<u4").tolist()
        body = raw[16:]
        table, control, data = np.frombuffer(body[: 4 * r], "<u4"), np.frombuffer(body[4 * r : 4 * r + c], np.uint8), np.frombuffer(body[4 * r + c :], np.uint8)
        assert len(data) == d and token_files.decode_block(table, control, data, k).tolist() == ids.tolist()


def test_token_files_keep_words_for_later_tasks(spark):
    def held(batches):
        from frameloom.llm.bpe import encoder

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encoder(queries.TOKENIZER)._words)], pa.int64())], ["n"])

    def most() -> int:
        return spark.range(0, 400, 1, 8).mapInArrow(held, "n long").agg({"n": "max"}).first()[0]

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = token_files.token_files(docs, queries.TOKENIZER, shards=4).collect()
    assert sorted(queries.op5_token_files(spark, SF).collect()) == sorted(plain)
    assert most() > 0
    assert sorted(token_files.token_files(docs, queries.TOKENIZER, shards=4, keep_words=True).collect()) == sorted(plain)


def test_token_files_of_real_and_hard_rows(spark, real, hard):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.TOKENIZER)
    t.encode_special_tokens = True
    for df in (real, hard):
        rows = sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want, start = Counter(), 0
        for name, text in rows:
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            want[name, start, len(ids), zlib.crc32(ids.tobytes())] += 1
            start += len(ids)
        got = token_files.token_files(df, queries.TOKENIZER, shards=5, block_ids=5000)
        assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()) == want
    assert token_files.token_files(hard.where("false"), queries.TOKENIZER).count() == 0


def test_section_tokens_equal_offsets(spark, real, hard):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.TOKENIZER)
    t.encode_special_tokens = True
    for df in (real, hard):
        got = token_counts.count_tokens(df, queries.TOKENIZER).collect()
        texts = defaultdict(list)
        for r in df.collect():
            texts[r["doc_id"]].append(r["text"] or "")
        assert len(got) == df.count()
        for r in got:
            text = texts[r["doc_id"]][0]
            starts = [0] + [m.end() for m in re.finditer("\n", text) if m.end() < len(text)]
            want = [0] * len(starts)
            for a, b in t.encode(text, add_special_tokens=False).offsets:
                share = Counter(max(k for k, s in enumerate(starts) if s <= p) for p in range(a, b))
                want[min(share, key=lambda k: (-share[k], k))] += 1
            assert r["section_tokens"] == want and sum(r["field_tokens"]) == r["n_tokens"] == sum(want)
    two = token_counts.count_tokens(hard, queries.TOKENIZER, fields=("extra", "text")).collect()
    assert all(len(r["field_tokens"]) == 2 and sum(r["field_tokens"]) == r["n_tokens"] for r in two)


def test_added_token_strings_are_found_as_by_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.TOKENIZER)  # as it is loaded
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|><|endoftext|>\ny z", " lead<|endoftext|>é\n", "<|endoftext| >", "none here"]
    df = docs(spark, [(i, x, None, None) for i, x in enumerate(texts)])
    files = {r["doc_id"]: r for r in token_files.token_files(df, queries.TOKENIZER).collect()}
    counts = {r["doc_id"]: r for r in token_counts.count_tokens(df, queries.TOKENIZER).collect()}
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for i, x in enumerate(texts):
        found = t.encode(x, add_special_tokens=False)
        ids = np.array([*found.ids, 2], "<u4")
        assert CachedEncoder(queries.TOKENIZER).encode(x).tolist() == found.ids
        assert (files[i]["n_tokens"], files[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
        bounds = [0] + [m.end() for m in re.finditer("\n", x) if m.end() < len(x)]
        want = [0] * len(bounds)
        for a, b in found.offsets:
            share = Counter(max(k for k, s in enumerate(bounds) if s <= p) for p in range(a, b))
            want[min(share, key=lambda k: (-share[k], k))] += 1
        assert counts[i]["section_tokens"] == want and counts[i]["n_tokens"] == len(found.ids)


# 6 licence scans


def _base_places(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in license_scan.BASE_PHRASES.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    return len(ws), sorted(found)


def _noisy_notices():
    """Notices with words lost, changed or added, alone and two to a text."""
    rng = random.Random(8)
    rows = []
    for i, (_, notice, _) in enumerate(license_scan.TEMPLATES * 4):
        words = [w for w in notice.split() if rng.random() > 0.05]
        words = [w if rng.random() > 0.03 else "changed" for w in words]
        other = rng.choice(license_scan.TEMPLATES)[1].split() if i % 3 == 0 else []
        rows.append((100 + i, " ".join(["before", *words, *["filler"] * rng.randint(0, 3), *other]), None, None))
    return rows


def _licences(text, index):
    """Every template at every offset of a text, word by word."""
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    labels = {label for p, label in license_scan.BASE_PHRASES.items() if any(words[i : i + len(p.split())] == p.encode().split() for i in range(len(words)))}
    score = float(bool(labels))
    for label, notice, phrase in license_scan.TEMPLATES:
        ranked = sorted(set(notice.encode().split()), key=index.rank.__getitem__)
        notice, phrase = notice.encode().split(), phrase.encode().split()
        rare = [w for w in ranked if w in words][:4]
        starts = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        at = next(i for i in range(len(notice)) if notice[i : i + len(phrase)] == phrase)
        for start in starts:
            there = [(w, words[start - at + i]) for i, w in enumerate(notice) if 0 <= start - at + i < len(words)]
            if sum(a == b and a in rare for a, b in there) >= 2:
                labels.add(label)
                score = max(score, sum(a == b for a, b in there) / len(notice))
    return ",".join(sorted(labels)), score


def test_licence_scan_equals_brute_force(spark, real, hard):
    more = docs(spark, [(20, "x All rights reserved, all RIGHTS reserved cc by cc by", None, None), (21, "Licensed under the Apache License, Version 2.0.", None, None), (22, "apache licence only license", None, None), (23, "Released under the MIT License. Licensed under CC BY-NC 4.0.", None, None), (24, "the GNU General Public License, version 3", None, None), *_noisy_notices()])
    for df in (real, hard, more):
        index = license_scan.fit_license_index(df)
        got = license_scan.scan_licenses(df, index).collect()
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        assert len(got) == df.count()
        for r in got:
            n, found = _base_places(texts[r["doc_id"]])
            places = [i for i, _ in found]
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(found), min(places, default=None), max(places, default=None))
            assert r["base_labels"] == ",".join(sorted({x for _, x in found})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
            assert (r["labels"], r["score"]) == _licences(texts[r["doc_id"]], index), r["doc_id"]
    labels = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(more, license_scan.fit_license_index(more)).collect() if r["doc_id"] < 100}
    assert labels == {20: "cc-by,reserved", 21: "apache-2.0", 22: "", 23: "cc-by,cc-by-nc-4.0,mit", 24: "gpl,gpl-3.0"}
    assert license_scan.scan_licenses(hard.where("false"), license_scan.fit_license_index(hard.where("false"))).count() == 0


# 8 near-duplicates


def _components(rows, n, percent=80):
    sets = [near_dedup.shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return Counter((name, len(sets[i]), least.get(find(i)) if sets[i] else name) for i, (name, _) in enumerate(rows))


def test_near_duplicates_equal_brute_force(spark, hard):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [(r[0], r[1]) for r in HARD], 100
    for _ in range(25):
        base = rng.choices(vocab, k=rng.randint(5, 120))
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((i, " ".join(copy)))
            i += 1
    rng.shuffle(rows)
    df = docs(spark, [(a, b, None, None) for a, b in rows])
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, shingle=4).collect())
    assert got == _components(rows, 4)
    kept = near_dedup.one_of_each_group(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({name: 1 for name, _, root in _components(rows, 5) if name == root})
    assert near_dedup.near_duplicates(hard.where("false")).count() == 0


def test_copies_among_many_rows_that_share_their_passage(spark, monkeypatch):
    rng = random.Random(11)
    fresh = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    passage = fresh(303)
    copy = [f"x{k}" if k % 37 == 20 else w for k, w in enumerate(passage)]
    rows = [(1, " ".join(passage)), (2, " ".join(copy))] + [(i, " ".join(passage + fresh(150))) for i in range(3, 2003)]
    a, b = (near_dedup.shingle_set(t, 4) for _, t in rows[:2])
    assert 0.8 <= len(a & b) / len(a | b) < 0.81
    monkeypatch.setattr(near_dedup, "GROUP_BLOCK", 150)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, [(i, t, None, None) for i, t in rows]), shingle=4).collect()}
    assert got == {1: 1, 2: 1, **{i: i for i in range(3, 2003)}}


def test_thresholds_below_the_registered_one(spark):
    rng = random.Random(6)
    rows = [(1, "a b c d e"), (2, "a b c d e f"), (3, "p q r s t u"), (4, "x p q r s t"), (5, "k l m n"), (6, "k l m n o")]
    for i in range(10, 60, 2):
        base = [f"v{i}_{k}" for k in range(rng.randint(4, 60))]
        rows += [(i, " ".join(base)), (i + 1, " ".join(w if rng.random() > 0.07 else w + "x" for w in base))]
    df = docs(spark, [(a, b, None, None) for a, b in rows])
    for percent in (50, 65):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, shingle=4, threshold=percent / 100).collect())
        assert got == _components(rows, 4, percent)
    for threshold in (0.3, 0.805, 1.1):
        with pytest.raises(ValueError, match="threshold"):
            near_dedup.near_duplicates(df, threshold=threshold)
    assert near_dedup._fitted(0.8)[:2] == (3, 4) and near_dedup._fitted(0.75)[:2] == (2, 3) and near_dedup._fitted(0.5)[:2] == (1, 1)


def test_regions_in_many_blocks(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.035 else f"y{rng.randrange(10**6)}" for w in base)) for i in range(90)]
    monkeypatch.setattr(near_dedup, "REGION_BLOCK", 7)
    monkeypatch.setattr(near_dedup, "REGION_BYTES", 4000)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, [(i, t, None, None) for i, t in rows]), shingle=4).collect())
    assert got == _components(rows, 4)


def test_near_duplicates_with_few_or_clashing_columns(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "k l m n o p"), (None, None)]
    bare = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, "a b c d e f"), (3, None), (None, "k l m n o p"), (None, None)]
    assert Counter(map(tuple, near_dedup.one_of_each_group(bare).collect())) == Counter(want)
    clashing = bare.selectExpr("*", "map('k', doc_id) AS place", "1 AS by_id", "2 AS no_id", "3 AS by_text", "4 AS node", "5 AS row", "6 AS tkey", "7 AS component_id", "8 AS kept", "9 AS labels")
    out = near_dedup.one_of_each_group(clashing)
    assert out.columns == clashing.columns and Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(want)
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(clashing).collect())
    assert got == Counter([(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (None, None, True), (None, None, True)])


def test_forest_connects_as_all_pairs_do():
    rng = np.random.default_rng(4)
    sketches = np.repeat(rng.integers(0, 256, (12, near_dedup.HASHES), np.uint8), 8, axis=0)
    for row in sketches:
        row[rng.random(len(row)) < rng.choice([0.1, 0.2, 0.3])] = rng.integers(256)
    nodes, n = rng.permutation(96) * 5, rng.integers(40, 70, 96)
    pairs = [(i, j) for i in range(96) for j in range(i) if (sketches[i] == sketches[j]).mean() >= 0.64 and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) - 1e-9]

    def parts(links):
        root = {int(x): int(x) for x in nodes}
        for x, y in links:
            low, high = sorted((root[x], root[y]))
            root = {k: low if r == high else r for k, r in root.items()}
        return root

    found = near_dedup._forest_of(nodes, n, sketches, 0.64, 0.8)
    assert parts(found) == parts((int(nodes[i]), int(nodes[j])) for i, j in pairs) and len(found) == 96 - len(set(parts(found).values()))


def test_components_of_links_with_nulls_and_repeats(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (None, 3), (4, None), (7, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.connected_components(links).collect()} == {1: 1, 2: 1}
    assert graph.connected_components(links.where("false")).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in graph.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


# 9 mixing


def test_targets_fill_by_weight_under_the_cap():
    sizes = {"a": 10, "b": 1000, "c": 1000, None: 5}
    t = mixing.mix_targets(sizes)
    assert abs(sum(t.values()) - sum(sizes.values())) < 1e-9 and all(t[s] <= 3 * n for s, n in sizes.items()) and t["a"] == 30 and t[None] == 15
    assert abs(t["c"] / t["b"] - 1.5) < 1e-9


def test_splitting_tree_is_exact_and_repeats():
    draws = np.array([100, 3, 0, 57])
    out = mixing.split_draws(draws, 7, 1)
    assert (out.sum(axis=0) == draws).all() and (out >= 0).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 1
    assert (out == mixing.split_draws(draws, 7, 1)).all()


def test_mix_takes_whole_documents_near_the_targets(spark, real, hard):
    plan = mixing.plan_mix(real, shards=8).collect()
    taken = Counter(r["doc_id"] for r in mixing.mix(real, shards=8).collect())
    assert {r["doc_id"]: len(r["draws"]) for r in plan if r["draws"]} == dict(taken) and max(taken.values()) <= 3
    by, largest = Counter(), Counter()
    for r in plan:
        by[r["source"]] += r["size"] * len(r["draws"])
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(by[r["source"]] - r["target"]) <= largest[r["source"]] for r in plan)
    assert sorted(map(str, mixing.plan_mix(real, shards=8).collect())) == sorted(map(str, plan))
    rows, n = mixing.deal(real, shards=8)
    dealt = rows.select("row.doc_id", "row.source", "draw.*").collect()
    assert n == 8 and Counter((r["doc_id"], r["pass"], r["shard"], r["place"]) for r in dealt) == Counter((r["doc_id"], *d) for r in plan for d in r["draws"])
    shards = [[r["doc_id"] for r in part] for part in mixing.mix(real, shards=8).rdd.glom().collect()]
    want = defaultdict(list)
    for r in sorted(dealt, key=lambda r: r["place"]):
        want[r["shard"]].append(r["doc_id"])
    assert shards == [want[k] for k in range(8)]
    again = mixing.plan_mix(hard).collect()
    assert len(again) == len(HARD) and mixing.mix(hard).columns == hard.columns
    assert mixing.plan_mix(hard.where("false")).count() == 0 and mixing.mix(hard.where("false")).count() == 0


def test_mix_keeps_sources_and_clashing_columns_apart(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (1, "a b c", "y"), (2, None, None), (None, "d e", None), (3, "f g h i", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 AS draws", "map('a', 1) AS line", "1 AS place", "2 AS number", "3 AS drawn", "4 AS row", "5 AS draw", "6 AS key", "8 AS size", "9 AS bucket")
    for seed in range(4):
        want = Counter()
        for r in mixing.plan_mix(df, seed=seed).collect():
            want[r["doc_id"], r["source"]] += len(r["draws"])
        out = mixing.mix(df, seed=seed)
        assert out.columns == df.columns and Counter((r["doc_id"], r["source"]) for r in out.collect()) == +want
    bare = df.select("doc_id", "text", "source")
    assert mixing.mix(bare).columns == bare.columns


# 10 decontamination


def _tiles(doc, item, n):
    """Greedy string tiling as published, without hashes."""
    n, used, marked, tiles = min(n, len(item)), [False] * len(doc), [False] * len(item), 0
    while item:
        best = (0, 0, 0)
        for t in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while t + k < len(item) and d + k < len(doc) and item[t + k] == doc[d + k] and not marked[t + k] and not used[d + k]:
                    k += 1
                if k > best[0]:
                    best = (k, t, d)
        k, t, d = best
        if k < n:
            break
        marked[t : t + k], used[d : d + k], tiles = [True] * k, [True] * k, tiles + 1
    return sum(marked) / max(1, len(item)), tiles


def test_tiling_equals_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        vocab = [f"v{i}" for i in range(rng.choice([3, 8, 30]))]
        item = rng.choices(vocab, k=rng.randint(1, 25))
        doc = rng.choices(vocab, k=rng.randint(0, 20))
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(len(item))
            doc[rng.randint(0, len(doc)) :] = item[a : a + rng.randint(1, 12)] + rng.choices(vocab, k=2)
        for at_once in (1 << 20, 3):
            decontaminate.PAIRS_AT_ONCE = at_once
            got = decontaminate.Tiler(" ".join(item), 4).coverage(decontaminate.split_words(" ".join(doc)))
            share, n_tiles = _tiles(doc, item, 4)
            assert abs(got[0] - share) < 1e-9 and got[1] == n_tiles
    decontaminate.PAIRS_AT_ONCE = 1 << 20


def test_bitmaps_never_miss(spark):
    from frameloom.llm import _shared

    rows = spark.range(3000).select(F.xxhash64("id").alias("h"))
    bitmap = _shared.bitmap_of(rows, "h")
    held = np.array([r["h"] for r in rows.collect()])
    others = np.array([r["h"] for r in spark.range(10**6, 10**6 + 20_000).select(F.xxhash64("id").alias("h")).collect()])
    assert bitmap.hit(held).all() and bitmap.hit(others).mean() < 0.001 and len(bitmap.hit(held[:0])) == 0
    assert rows.where(_shared.may_hit(bitmap)(F.col("h"))).count() == 3000


def test_repetitive_texts_are_tiled_in_bounded_time():
    tiler = decontaminate.Tiler("word " * 300)
    assert tiler.coverage([b"word"] * 200_000) == (1.0, 1) and tiler.coverage([b"word"] * 299) == (299 / 300, 1)
    assert decontaminate.Tiler("a b " * 100).coverage(b"a b b a ".split() * 5_000)[0] == 0.0


def test_contamination_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i % 25 if i else None, " ".join(rng.choices([f"v{k}" for k in range(60)], k=rng.randint(1, 40)))) for i in range(30)]
    rows = []
    for i in range(120):
        words = rng.choices([f"v{k}" for k in range(60)], k=rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)[1].split()
            a = rng.randrange(len(item))
            words[rng.randint(0, len(words)) :] = item[a : a + rng.randint(1, 25)]
        rows += [(i, " ".join(words))] * rng.choice([1, 1, 2])
    want = Counter()
    for i, text in rows:
        best = {}
        for name, item in items:
            share, n = _tiles(text.split(), item.split(), 5)
            if n:
                best[name] = max(best.get(name, (0.0, 0)), (share, n))
        found = tuple(sorted(n for n, (share, _) in best.items() if n is not None and share >= 0.5))
        top = max([share for share, _ in best.values()], default=0.0)
        want[i, top >= 0.5, round(top, 9), sum(n for _, n in best.values()), found] += 1
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).selectExpr("*", "1 AS key", "map('a', 1) AS row", "2 AS coverage", "3 AS bit", "4 AS items")
    got = decontaminate.find_contamination(df, bench).collect()
    assert Counter((r["doc_id"], r["contaminated"], round(r["coverage"], 9), r["n_tiles"], tuple(r["items"])) for r in got) == want
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for (i, bad, *_), n in want.items() for _ in range(n) if not bad)


def test_reordered_passages_are_caught_and_clean_rows_left(spark, hard):
    item = " ".join(f"term{i}" for i in range(30))
    words = item.split()
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short one")], "item_id long, text string")
    df = docs(spark, [(1, "x y " + " ".join(words[20:] + words[:10] + ["z"] + words[10:20]), None, None), (2, " ".join(words[:12]), None, None), (3, item.upper() + " tail", None, None), (4, "a short one", None, None)])
    got = {r["doc_id"]: (r["contaminated"], r["items"], round(r["coverage"], 3)) for r in decontaminate.find_contamination(df, bench).collect()}
    assert got == {1: (True, [1], 1.0), 2: (False, [], 0.4), 3: (True, [1], 1.0), 4: (True, [4], 1.0)}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()] == [2]
    assert not any(r["contaminated"] for r in decontaminate.find_contamination(hard, bench).collect())
    assert decontaminate.find_contamination(hard, bench.where("false")).count() == len(HARD) and decontaminate.find_contamination(hard.where("false"), bench).count() == 0


# pipeline


def test_pipeline_stages_on_hard_rows(spark, hard, real):
    import corpus_pipeline as pipe

    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(1).collect()]
    rows = docs(spark, [*HARD, (50, bench[0], "en", "a"), (51, "the thing " + " ".join(f"en{i}" for i in range(60)), "en", "b"), (52, "the thing " + " ".join(f"en{i}" for i in range(60)) + " x", "en", "b")]).drop("extra", "score")
    kept = pipe.identify_language(spark, rows, SF)
    assert kept.columns == rows.columns and {r["doc_id"] for r in rows.collect()} - {r["doc_id"] for r in kept.collect()} == {1, 2, 3}
    once = pipe.drop_near_duplicates(spark, kept, SF)
    assert Counter(r["doc_id"] for r in once.collect()) == {4: 1, 5: 1, 7: 1, 8: 1, None: 1, 9: 1, 10: 1, -3: 1, 50: 1, 51: 1}
    clean = pipe.drop_contaminated(spark, once, SF)
    assert {r["doc_id"] for r in once.collect()} - {r["doc_id"] for r in clean.collect()} == {50}
    mixed = pipe.mix_sources(spark, clean, SF)
    assert mixed.columns == rows.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    assert pipe.write_tokens(spark, mixed, SF).count() == mixed.count()
    assert [n for n, _ in pipe.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_output"]
