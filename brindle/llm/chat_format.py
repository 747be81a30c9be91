r"""Chat formatting: fold an event log into final messages, then render each conversation.

DataFrame functions only.  An event has a conversation, a sequence number, a message id, a kind, a
role and a text.  Kinds: `message` and `edit` set a message's text, `regenerate` empties it, `delta`
appends to it.  The log is dealt by conversation and sorted by sequence; a message's final text is
what was appended since its last `message`, `edit` or `regenerate`; messages stand in the order of
their first events.

Template.  A turn is `### Role: text</turn>` and a line feed.  Inside roles and texts, `\` is
written `\\`, `</turn>` is written `\e` and `###` is written `\h`, so the control strings occur
only where the template puts them and every text is read back exactly.  Known roles are shown with
a capital; any other role is written after `\r`, with `:` as `\c`.

The loss mask covers the assistant's texts: per such turn its number and the start and end of the
text within the rendered turn, in code points.

Defined results.  A null text or role counts as empty, a null kind as `message`.  Events of equal
sequence are ordered by kind, role and text; events repeated in full are separate events.  An event
with a null message id is a message of its own.  Rows with a null conversation form one
conversation.  An empty log gives an empty result.  One conversation is one output row, so its
messages meet in one task: that is the size of the result itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>"
MARK = "###"
BREAK = END + "\n"
KNOWN_ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
SETTING_KINDS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    r"""Write `\`, `</turn>` and `###` so that no control string is left."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit(END), F.lit("\\e")), F.lit(MARK), F.lit("\\h"))


def unescape(text: Column) -> Column:
    r"""Read back `escape`: pairs of backslashes split the text, codes stand between them."""
    parts = F.transform(F.split(text, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\e"), F.lit(END)), F.lit("\\h"), F.lit(MARK)))
    return F.array_join(parts, "\\")


def _shown(role: Column) -> Column:
    other = F.concat(F.lit("\\r"), F.replace(escape(role), F.lit(":"), F.lit("\\c")))
    shown = other
    for name, title in KNOWN_ROLES.items():
        shown = F.when(role == name, F.lit(title)).otherwise(shown)
    return shown


def _role(shown: Column) -> Column:
    """Read back `_shown`."""
    parts = F.transform(F.split(F.substr(shown, F.lit(3)), r"\\\\"), lambda p: F.replace(p, F.lit("\\c"), F.lit(":")))
    role = unescape(F.array_join(parts, "\\\\"))
    for name, title in KNOWN_ROLES.items():
        role = F.when(shown == title, F.lit(name)).otherwise(role)
    return role


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of an event log: conv_id, place, role, text.

    `events` has conv_id, seq, message_id, kind, role and text.
    """
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    log = events.select("conv_id", "seq", "message_id", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_conversation = Window.partitionBy("conv_id").orderBy("seq", "kind", "role", "text")
    log = log.withColumn("at", F.row_number().over(by_conversation))
    own = F.when(F.col("message_id").isNull(), F.col("at"))
    parts = log.groupBy("conv_id", "message_id", own.alias("own")).agg(F.array_sort(F.collect_list(F.struct("at", "kind", "role", "text"))).alias("parts"))
    resets = F.transform("parts", lambda p, i: F.when(p["kind"].isin(*SETTING_KINDS), i + 1).otherwise(F.lit(1)))
    parts = parts.withColumn("live", F.slice("parts", F.array_max(resets), F.size("parts")))
    text = F.array_join(F.transform("live", lambda p: F.when(p["kind"] == "regenerate", F.lit("")).otherwise(p["text"])), "")
    return parts.select("conv_id", F.col("parts")[0]["at"].alias("place"), F.col("parts")[0]["role"].alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (turn, start, end)."""
    shown = _shown(F.col("role"))
    head = F.concat(F.lit(MARK + " "), shown, F.lit(": "))
    turns = messages.select("conv_id", "place", F.col("role").eqNullSafe("assistant").alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    piece = F.struct("place", F.concat("head", "body", F.lit(BREAK)).alias("turn"), F.when(F.col("loss"), F.struct(F.length("head").alias("start"), (F.length("head") + F.length("body")).alias("end"))).alias("span"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    spans = F.transform("pieces", lambda p, i: F.when(p["span"].isNotNull(), F.struct(i.alias("turn"), p["span"]["start"].alias("start"), p["span"]["end"].alias("end"))))
    return chats.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["turn"]), "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))


def format_chats(events: DataFrame) -> DataFrame:
    """Fold an event log and render it: conv_id, formatted, loss_spans."""
    return render(fold_events(events))


def read_back(chats: DataFrame) -> DataFrame:
    """From rendered conversations alone: conv_id, turns (role, text), loss_texts, formatted."""
    lines = F.split("formatted", BREAK)
    turns = chats.select("conv_id", "formatted", "loss_spans", F.slice(lines, F.lit(1), F.size(lines) - 1).alias("raw"))

    def turn(t: Column) -> Column:
        colon = F.position(F.lit(": "), t)
        shown = F.substr(t, F.lit(len(MARK) + 2), colon - len(MARK) - 2)
        return F.struct(_role(shown).alias("role"), unescape(F.substr(t, colon + 2)).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("raw")[s["turn"]], s["start"] + 1, s["end"] - s["start"])))
    return turns.select("conv_id", "formatted", F.transform("raw", turn).alias("turns"), masked.alias("loss_texts"))
