"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

An event log is partitioned by conversation and sorted by sequence; streamed deltas, edits and
regenerations are folded into final messages, which are rendered with a template whose control
strings are escaped reversibly inside texts.

Events (kind): ``message`` opens a message with a text; ``delta`` appends to the current version;
``edit`` replaces it; ``regenerate`` empties it and drops every message that was opened after it and
before this event; ``delete`` removes it. An unknown or null kind counts as ``message``. Events of
one message id are folded in (seq, part, kind, role, text) order, so ties and repeated rows have a defined
result: a repeated ``message`` event is a further message. A delta, edit or regenerate before any
``message`` opens the message; an event behind a ``delete`` brings it back. Null sequence numbers come first; null roles
and texts count as empty; null conversation ids form one conversation; a conversation of which nothing is left has no
messages and an empty text; an empty log gives an empty table. Only the named columns are read, and extra
columns may have any names. Folding and cutting take time linear in the events but for their sorts, spans n ** 1.5 for
n messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<turn>", "\n", "</turn>\n"


def escape(text: Column) -> Column:
    """Breaks the control strings in a text with a backslash; backslashes are doubled first."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("</turn"), F.lit("<\\/turn")), F.lit("<turn"), F.lit("<\\turn"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """Percent-encodes what could end or imitate the role line."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once: higher-order functions do not share subexpressions."""
    return F.transform(F.array(value), use)[0]


def _messages(events: Column) -> Column:
    """array<struct<seq,part,role,text,live>> that the sorted events of one message id leave, in time linear in them."""
    starts = F.filter(F.sequence(F.lit(0), F.size(events) - 1), lambda i: (i == 0) | (F.get(events, i)["kind"] == "message"))

    def message(es: Column) -> Column:
        resets = F.filter(F.sequence(F.lit(0), F.size(es) - 1), lambda i: (i == 0) | F.get(es, i)["kind"].isin("edit", "regenerate"))
        texts = _bound(F.element_at(resets, -1), lambda cut: F.transform(F.slice(es, cut + 1, F.size(es) - cut), lambda e: F.when(e["kind"].isin("delete", "regenerate"), "").otherwise(e["text"])))
        return F.struct(es[0]["seq"].alias("seq"), es[0]["part"].alias("part"), es[0]["role"].alias("role"), F.array_join(texts, "").alias("text"), (F.element_at(es, -1)["kind"] != "delete").alias("live"))

    def cut_up(at: Column) -> Column:
        return F.transform(at, lambda s, k: _bound(F.slice(events, s + 1, F.coalesce(F.get(at, k + 1), F.size(events)) - s), message))

    return _bound(starts, cut_up)


def reconstruct(events: DataFrame, conv: str = "conv_id", message: str = "message_id", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text", part: str | None = None) -> DataFrame:
    """(conv, messages array<struct<seq,role,text>>) after the fold, in order of opening.

    ``part`` orders events of one sequence number, if given. Events are gathered and folded per message first; only
    finished messages meet per conversation, where one sorted pass over them and the regenerations, which carry
    the latest place that any regeneration before covers, tells which were dropped.
    """
    known = F.when(F.col(kind).isin("delta", "edit", "regenerate", "delete"), F.col(kind)).otherwise("message")
    place = F.lit(0).cast("long") if part is None else F.col(part).cast("long")
    event = F.struct(F.col(seq).cast("long").alias("seq"), place.alias("part"), known.alias("kind"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    by_message = events.select(F.col(conv).alias("c"), F.col(message).alias("m"), event.alias("e")).groupBy("c", "m").agg(F.sort_array(F.collect_list("e")).alias("es"))
    none = F.lit(None).cast("struct<seq:bigint,part:bigint>")
    opened = F.transform(_messages(F.col("es")), lambda m: F.struct(m["seq"].alias("seq"), m["part"].alias("part"), F.lit(False).alias("cut"), m["role"].alias("role"), m["text"].alias("text"), m["live"].alias("live"), none.alias("until")))
    first, empty = F.col("es")[0], F.lit("")
    cuts = F.transform(F.filter("es", lambda e: e["kind"] == "regenerate"), lambda r: F.struct(first["seq"].alias("seq"), first["part"].alias("part"), F.lit(True).alias("cut"), empty.alias("role"), empty.alias("text"), F.lit(False).alias("live"), F.struct(r["seq"].alias("seq"), r["part"].alias("part")).alias("until")))
    rows = by_message.select("c", F.inline(F.concat(opened, cuts)))
    before = Window.partitionBy("c").orderBy("seq", "part", "cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("covered", F.max("until").over(before))
    kept = F.col("live") & ~F.coalesce(F.col("covered") > F.struct("seq", "part"), F.lit(False))
    whole = rows.groupBy("c").agg(F.sort_array(F.collect_list(F.when(kept, F.struct("seq", "part", "role", "text")))).alias("ms"))
    return whole.select(F.col("c").alias(conv), F.transform("ms", lambda m: m.dropFields("part")).alias("messages"))


def render(conversations: DataFrame, conv: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """(conv, formatted, loss_spans) — spans of the loss mask in code points of the formatted text, end exclusive."""
    pieces = F.transform(
        "messages",
        lambda m: F.struct(F.concat(F.lit(OPEN), escape_role(m["role"]), F.lit(MIDDLE)).alias("head"), escape(m["text"]).alias("body"), (m["role"] == loss_role).alias("loss")),
    )
    rows = conversations.select(F.col(conv).alias("c"), pieces.alias("ps"))
    sized = F.transform("ps", lambda p: F.struct(F.char_length(p["head"]).cast("long").alias("head"), F.char_length(p["body"]).cast("long").alias("body"), p["loss"].alias("loss")))
    formatted = F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    rows = rows.select("c", formatted.alias("formatted"), sized.alias("sizes"))
    return rows.select(F.col("c").alias(conv), "formatted", _spans(F.col("sizes")).alias("loss_spans"))


def _spans(sizes: Column) -> Column:
    """array<struct<start,end>> of the pieces under the loss mask, from array<struct<head,body,loss>>.

    Running sums are taken within chunks of about the root of the number of pieces, and over the chunks' totals, as an
    array that is grown piece by piece is copied each time.
    """
    long, none = F.lit(0).cast("long"), F.array().cast("array<struct<start:bigint,end:bigint>>")
    size = lambda p: p["head"] + p["body"] + len(CLOSE)

    def step(done: Column, p: Column) -> Column:
        begin = done["at"] + p["head"]
        span = F.array(F.struct(begin.alias("start"), (begin + p["body"]).alias("end")))
        return F.struct((done["at"] + size(p)).alias("at"), F.when(p["loss"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    def chunked(c: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / c).cast("int")), lambda k: F.slice(sizes, k * c + 1, c))
        return _bound(chunks, with_starts)

    def with_starts(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda ch: F.aggregate(ch, long, lambda t, p: t + size(p)))
        starts = F.aggregate(totals, F.array(long), lambda at, t: F.concat(at, F.array(F.element_at(at, -1) + t)))
        return _bound(starts, lambda at: F.flatten(F.transform(chunks, lambda ch, k: F.aggregate(ch, F.struct(F.get(at, k).alias("at"), none.alias("spans")), step, lambda d: d["spans"]))))

    return F.when(F.size(sizes) == 0, none).otherwise(_bound(F.ceil(F.sqrt(F.size(sizes))).cast("int"), chunked))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted text."""
    parts = F.filter(F.split(formatted, CLOSE, -1), lambda p: p.startswith(OPEN))

    def turn(p: Column) -> Column:
        line = F.instr(p, MIDDLE)
        role = F.substring(p, F.lit(len(OPEN) + 1), line - len(OPEN) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(p, line + 1, F.char_length(p))).alias("text"))

    return F.transform(parts, turn)


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
