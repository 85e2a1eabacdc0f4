"""The queries of this subpackage: each applies one operator to its whole table; SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat_format, decontaminate, fingerprints, language_id, license_scan, mixing, near_dedup, sharding, surrogates, token_counts, token_files, whitening
from ._shared import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PII_KEY_SETTING, PII_TEST_KEY = "spark.frameloom.pii.key", "frameloom surrogate key"  # a deployment sets a key of its own
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = 40
CHAT_PROBE = "\\### Assistant: </turn> ok"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from documents that are not held out; a null id is held out; no letters give ``und`` and score 0."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_language_model(docs.where(~held_out))
    found = language_id.identify_languages(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text; null texts are empty; ties of ids go by descending text."""
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def chat_events(rows: DataFrame) -> DataFrame:
    """An event log that leaves these rows (conv_id, turn, role, text).

    An assistant's turn is streamed: it opens empty, gets a delta, is followed by a message that its regeneration
    drops, and gets its text as deltas. Another turn opens with a draft and is edited. Each row is a message of its own.
    """
    text = F.coalesce("text", F.lit(""))
    of = lambda late, part, kind, value, role=None: F.struct(F.lit(late).alias("late"), part.cast("long").alias("part"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), value.alias("text"))
    at = lambda k: F.lit(k)
    start = [of(False, at(0), "message", F.lit(""), F.col("role")), of(False, at(1), "delta", F.lit("first try")), of(True, at(2), "message", F.lit("what then?"), F.lit("user")), of(False, at(3), "regenerate", F.lit(""))]
    pieces = F.transform(F.regexp_extract_all(text, F.lit("(?s).{1,200}"), F.lit(0)), lambda piece, k: of(False, k + 4, "delta", piece))
    edited = [of(False, at(0), "message", F.lit("draft"), F.col("role")), of(False, at(1), "edit", text)]
    log = F.when(F.col("role") == "assistant", F.concat(F.array(*start), pieces)).otherwise(F.array(*edited))
    events = rows.withColumn("row", F.monotonically_increasing_id()).select("conv_id", "turn", "row", F.inline(log))
    return events.select("conv_id", F.struct("row", "late").alias("message_id"), F.col("turn").alias("seq"), "part", "kind", "role", "text")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows written as an event log, folded back, rendered and read back from the output.

    Null roles and texts are empty; null turns come first, ties in order of role and text; repeated rows are turns of
    their own; a null conversation id is a conversation; an empty table leaves the added conversation.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHAT_PROBE).alias("text"))
    out = chat_format.render(chat_format.reconstruct(chat_events(rows.unionByName(probe)), part="part"))
    turns, texts = chat_format.parse(F.col("formatted")), chat_format.masked_texts(F.col("formatted"), F.col("loss_spans"))
    read = out.select("conv_id", turns.alias("turns"), F.array_join(texts, "").alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data and secrets replaced; a null text stays null, repeated rows stay, no rows give none."""
    key = spark.conf.get(PII_KEY_SETTING, PII_TEST_KEY).encode()
    return surrogates.replace_pii(table(spark, sf_dir, "documents"), key)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all texts, read back; null texts are the end id alone, null ids come first, ties in text order."""
    return token_files.token_files(table(spark, sf_dir, "documents"), TOKENIZER, keep_words=True)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every text; null texts have no words, labels are empty and the score 0."""
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan_licenses(docs, license_scan.fit_license_index(docs)).drop("matches")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by section; a null text has one section without tokens."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document by four-word shingles, as the contract says (the pipeline's stage takes five); texts without words are alone, repeated rows together."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the shards of the splitting tree hold of each document, added up over their slots.

    A null text has size 0, a null source is the last one, repeated rows are dealt one by one, no rows give none.
    """
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(plan).select("doc_id", "size", "source_size", "target", "taken")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold benchmark items; null texts are clean, repeated rows judged alike, an empty benchmark finds nothing."""
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40 and slot, by the law ``rows``; null texts have size 16, null ids come first in the order that is shuffled."""
    dealt = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finite embedding in whitened coordinates of the four leading components of the distinct vectors; no variance gives no rows."""
    return whitening.whitened_embeddings(table(spark, sf_dir, "embeddings"), 4)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers overlap in every text; null and empty texts, and those not given back byte by byte, have none."""
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_fingerprints, op3_chat_format, op4_pii_surrogates, op5_token_files, op6_license_scan, op7_token_counts, op8_near_dedup, op9_mixing, op10_decontamination, op11_sharding, op12_whitening, op13_alignment, pipeline]
    return {f.__name__: f for f in found}


_OP2_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nt FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text DESC)),
e AS (SELECT doc_id, rn, text, length(text) AS n_chars, left(text, length(text) - length(text) // 2) || left(nt, length(text) // 2) AS edited FROM n),
t AS (SELECT rn, 'v' AS kind, text AS t FROM e UNION ALL SELECT rn, 'e', edited FROM e),
h AS (SELECT rn, kind, list_transform(string_split(t, chr(10)), lambda p: sha256(p)) AS ps, list_transform(list_filter(string_split_regex(t, '[.!?\n]+'), lambda s: s <> ''), lambda s: sha256(s)) AS ss FROM t),
f AS (SELECT rn, kind, list_transform(range(8), lambda i: list_sum(list_transform(ps, lambda h: CAST('0x' || substr(h, CAST(1 + 8 * i AS BIGINT), 8) AS BIGINT))) % 4294967296) AS p, len(ss) AS n,
  list_transform(range(64), lambda i: CAST(coalesce(list_sum(list_transform(ss, lambda h: (CAST('0x' || substr(h, CASE WHEN i < 32 THEN 1 ELSE 9 END, 8) AS BIGINT) >> (i % 32)) & 1)), 0) AS BIGINT)) AS s FROM h),
r AS (SELECT *, array_to_string(list_transform(p, lambda x: format('{:08x}', CAST(x AS BIGINT))), '') || ':' || n || ',' || array_to_string(s, ',') AS text, list_transform(s, lambda x: 2 * x - n) AS x FROM f),
j AS (SELECT e.*, v.p AS vp, v.x AS vx, v.text AS fingerprint, ed.p AS ep, ed.x AS ex, ed.text AS edited_fingerprint, np.p AS np, np.x AS nx
  FROM e JOIN r v ON v.rn = e.rn AND v.kind = 'v' JOIN r ed ON ed.rn = e.rn AND ed.kind = 'e' JOIN r np ON np.kind = 'v' AND np.rn = e.rn % (SELECT count(*) FROM e) + 1)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint, @NEAR:e@ AS near_edited, @NEAR:n@ AS near_next FROM j"""
for _k in "en":
    _dot, _squares = f"list_sum(list_transform(range(1, 65), lambda i: vx[i] * {_k}x[i]))", f"list_sum(list_transform(range(1, 65), lambda i: vx[i] * vx[i] + {_k}x[i] * {_k}x[i]))"
    _OP2_SQL = _OP2_SQL.replace(f"@NEAR:{_k}@", f"CASE WHEN vp = {_k}p THEN 1.0::DOUBLE WHEN {_squares} - {_dot} <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0, least(1.0, CAST({_dot} AS DOUBLE) / CAST({_squares} - {_dot} AS DOUBLE)))::DOUBLE END")

_OP3_SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '</turn', '<\/turn'), '<turn', '<\turn')) + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')) + 15 AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

_OP8_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, rn, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
u AS (SELECT rn, len(s) AS n, unnest(s) AS x FROM g),
l AS (SELECT a.rn AS a, b.rn AS b FROM u a JOIN u b ON a.x = b.x AND a.rn <> b.rn GROUP BY a.rn, b.rn HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r(a, b) AS (SELECT rn, rn FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, c.component_id, g.doc_id = c.component_id AS kept FROM g JOIN (SELECT r.a, min(d.doc_id) AS component_id FROM r JOIN d ON d.rn = r.b GROUP BY r.a) c ON c.a = g.rn"""

_OP9_SQL = r"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source),
w AS (SELECT *, (pos - 1) % 3 + 1 AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * n / CAST(w AS DOUBLE), pos) AS k FROM w),
p AS (SELECT *, CAST(sum(n) OVER () - coalesce(sum(3 * n) OVER b, 0) AS BIGINT) AS rest, CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS heft FROM o WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, bool_and(3 * n * heft < w * rest) OVER (ORDER BY k) AS capped FROM p),
t AS (SELECT source, n, CASE WHEN capped THEN CAST(3 * n AS DOUBLE) ELSE CAST(w * (SELECT min_by(rest, k) FROM c WHERE NOT capped) AS DOUBLE) / (SELECT min_by(heft, k) FROM c WHERE NOT capped) END AS target FROM c),
q AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS whole FROM t),
m AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2 AS middle FROM d)
SELECT doc_id, size, n AS source_size, target, CAST(size * (whole + CASE WHEN n > 0 AND middle < (target - whole * n) / n * n THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m JOIN q ON m.source IS NOT DISTINCT FROM q.source"""


def oracle_sql() -> dict[str, str]:
    return {"op2_fingerprints": _OP2_SQL, "op3_chat_format": _OP3_SQL, "op8_near_dedup": _OP8_SQL, "op9_mixing": _OP9_SQL}
