"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log holds events of conversations. Each event names its conversation, its place in the sequence, and the message it
works on. A fold over a message's events in sequence gives its final text:

* ``message``, ``edit`` and ``regenerate`` set the text (and the role, where they carry one), dropping what was there;
* ``delta`` appends to it.

Messages are then rendered in the order of their first event. Long conversations are cut into chunks of messages, each
folded and rendered by itself, so that a task holds chunks and not whole conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template: a turn is OPEN, role, MIDDLE, text, CLOSE. ESCAPES keeps its signs out of roles and texts, reversibly.
OPEN, MIDDLE, CLOSE = "<s>[INST role=", "]", "</s>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("]", "&#93;"))
CHUNK = 64


def escape(text: Column) -> Column:
    for sign, code in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for sign, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, seq, msg, role, text`` of events ``conv_id, seq, msg, kind, role, text``.

    ``seq`` is the sequence of the message's first event, by which messages are ordered (ties: by ``msg``). Events of a
    message with equal ``seq`` are taken in the order of kind, role and text; repeated events count as often as they
    occur (an edit repeated changes nothing, a delta repeated appends twice). A null text counts as empty, a null kind as
    ``message``, a null role as none given (finally empty). Null identifiers form groups of their own. Other columns are
    ignored. A message with deltas only starts from an empty text. Without events there are no messages; texts may be of any
    length, as one value of a row.
    """
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    rows = events.select(
        "conv_id", "seq", "msg", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"), (kind != "delta").alias("sets")
    )
    message = Window.partitionBy("conv_id", "msg")
    # one order for all: events before the last one that sets the text can no longer show
    order = message.orderBy("seq", "kind", F.col("role").asc_nulls_first(), "text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = message.orderBy("seq", "kind", F.col("role").asc_nulls_first(), "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        rows.withColumn("era", F.sum(F.col("sets").cast("int")).over(running))
        .withColumn("last_era", F.max("era").over(message))
        .withColumn("at", F.row_number().over(message.orderBy("seq", "kind", F.col("role").asc_nulls_first(), "text")))
        .withColumn("first_seq", F.min("seq").over(message))
        .withColumn("last_role", F.last("role", ignorenulls=True).over(order))
        .where("era = last_era")
    )
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    return rows.groupBy("conv_id", "msg").agg(
        F.first("first_seq").alias("seq"),
        F.coalesce(F.first("last_role"), F.lit("")).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame, chunk_col: Column | None = None, trained_role: str = "assistant") -> DataFrame:
    """Chunks ``conv_id, chunk, n_turns, formatted, loss`` of ``messages``; ``loss`` lists spans of ``formatted``.

    A conversation's text is its chunks' ``formatted`` in order. A span (``start``, ``length``, in code points) covers
    the text of one message of the role that is trained on. Order in a chunk: ``seq``, then ``msg``.
    """
    piece = F.struct("seq", "msg", "role", "text")
    chunk = F.floor(F.coalesce(F.col("seq"), F.lit(-1)) / CHUNK) if chunk_col is None else chunk_col
    grouped = messages.groupBy("conv_id", chunk.cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE))
    grouped = grouped.withColumn("parts", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body"))))
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.char_length(p["head"])
        length = F.char_length(p["body"])
        span = F.struct(begin.alias("start"), length.alias("length"))
        return F.struct(
            (begin + length + F.lit(len(CLOSE))).alias("at"),
            F.when(p["role"] == trained_role, F.concat(state["loss"], F.array(span))).otherwise(state["loss"]).alias("loss"),
        )

    return grouped.select(
        "conv_id",
        "chunk",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("parts", start, step, lambda s: s["loss"]).alias("loss"),
    )


def read_back(chunks: DataFrame) -> DataFrame:
    """Turns parsed from rendered chunks: ``conv_id, chunk, turns, trained, chars``, unescaped.

    ``turns`` lists (role, text) of each turn found in ``formatted``; ``trained`` lists the texts under the loss mask.
    """
    raw = F.filter(F.split("formatted", r"\Q" + CLOSE.strip() + r"\E\n"), lambda x: x != "")
    cut = lambda x: F.locate(MIDDLE, x)
    turn = lambda x: F.struct(
        unescape(F.substring(x, F.lit(len(OPEN) + 1), cut(x) - F.lit(len(OPEN) + 1))).alias("role"),
        unescape(F.substring(x, cut(x) + F.lit(len(MIDDLE)), F.char_length(x))).alias("text"),
    )
    return chunks.select(
        "conv_id",
        "chunk",
        F.transform(raw, turn).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("trained"),
        F.char_length("formatted").alias("chars"),
    )


def turn_events(rows: DataFrame) -> DataFrame:
    """Plain rows ``conv_id, turn, role, text`` as events: each row is a message, rows that repeat a turn included."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    twin = Window.partitionBy("conv_id", "turn").orderBy(role, text)
    return rows.select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.struct("turn", F.row_number().over(twin).alias("twin")).alias("msg"),
        F.lit("message").alias("kind"),
        role.alias("role"),
        text.alias("text"),
    )
