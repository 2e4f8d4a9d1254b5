"""Chat formatting from event logs, in DataFrame functions only.

An event log has one row per event of a conversation: `message` and `edit` set a message's text, `delta` appends a streamed
piece, `regenerate` clears a message and takes back what was said after it by then. Folding the log in the order of
`seq` gives the final messages; these are rendered with a template that marks turns and keeps control strings out of texts.

Rendering gathers a conversation into one row, as a training example is one string; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Replacements that keep markers out of texts, in order; undone in reverse order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"))
END = "<|end|>\n"


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of a log of (conv_id, seq, kind, message, role, text).

    Messages are placed by their number `message`. The text is all pieces from the last message, edit or regenerate event on,
    in order of `seq` (ties: kind, then text). A regenerate event takes back earlier events of later messages; a message
    without any event left is gone. The role is that of the earliest event left that names one. Null text is empty, null
    kinds count as `message`; an empty log has no messages.
    """
    e = events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "message", "role", F.coalesce("text", F.lit("")).alias("text"))
    per = Window.partitionBy("conv_id", "message")
    resets = F.max(F.when(F.col("kind") != "delta", F.struct("seq", "kind", "text"))).over(per)
    before = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("cut", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(before))
    e = e.filter("cut is null or seq > cut").withColumn("reset", resets)
    live = F.col("reset").isNull() | (F.struct("seq", "kind", "text") >= F.col("reset"))
    pieces = F.sort_array(F.collect_list(F.when(live & (F.col("kind") != "regenerate"), F.struct("seq", "kind", "text"))))
    return e.groupBy("conv_id", "message").agg(
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"),
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of messages (conv_id, message, role, text).

    `<|role|>\\n` + escaped text + `<|end|>\\n` per message. `loss_mask` has (turn, start, length) in code points of that turn's
    piece for each assistant text, empty ones included. Null roles and texts are rendered as empty.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit("<|"), role, F.lit("|>\n"))
    m = messages.select("conv_id", "message", head.alias("head"), text.alias("body"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"))
    turns = F.sort_array(F.collect_list(F.struct("message", "head", "body", "loss")))
    out = m.groupBy("conv_id").agg(turns.alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    mask = F.transform("turns", lambda t, i: F.when(t["loss"], F.struct(i.alias("turn"), F.length(t["head"]).alias("start"), F.length(t["body"]).alias("length"))))
    return out.select("conv_id", formatted.alias("formatted"), F.filter(mask, lambda x: x.isNotNull()).alias("loss_mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted_chars): what the rendered strings and masks say, unescaped."""
    pieces = F.split("formatted", r"<\|end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    r = rendered.withColumn("pieces", pieces)
    turn = lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, 3, 2**31 - 1), "|>\n", 1)).alias("role"),
        unescape(p.substr(F.locate("|>\n", p) + 3, F.length(p))).alias("text"),
    )
    loss = F.transform("loss_mask", lambda s: unescape(F.get("pieces", s["turn"]).substr(s["start"] + 1, s["length"])))
    return r.select("conv_id", F.transform("pieces", turn).alias("turns"), loss.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(back: DataFrame) -> DataFrame:
    """Counts and digests of what was read back."""
    hexed = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), hexed(told).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), hexed(loss).alias("loss_sha256"), "formatted_chars")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A log with one message event per row of (conv_id, turn, role, text), placed by turn, then role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    at = F.row_number().over(order)
    return c.select("conv_id", at.alias("seq"), F.lit("message").alias("kind"), at.alias("message"), "role", "text")
