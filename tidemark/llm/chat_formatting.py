"""Chat formatting: fold an event log of conversations into final messages and render them; DataFrame functions only.

Events have conv_id, turn, seq, kind, role, text. Within a turn, in order of seq (ties: kind, role, text):

* ``message`` opens a further message of the turn with its text;
* ``delta`` appends its text to the open message (streaming);
* ``edit`` replaces the open message's text so far;
* ``regenerate`` empties it, so that the deltas after it start anew.

A turn whose first event is none of ``message`` opens one with that event's role. Null kinds are messages, null roles
and texts are empty, null turns come first, rows without conv_id form one conversation, repeated rows are events of
their own, an empty log gives no conversation, other columns are not read. A conversation's rendered text is one string:
its length is bounded by Spark's 2 GB a value.

Events are dealt by (conv_id, turn): a conversation that holds a third of all rows is folded in parallel, turn by turn,
and only its rendered turns meet in the row that is its result.

A rendered turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles a control string gets one more
backslash after its ``<`` (``<|im_end|>`` becomes ``<\\|im_end|>``), which reading back takes away again; in roles,
backslash and line feed are escaped first. ``loss_spans`` has, for every assistant turn, its place in the conversation
and the code points of its text within the rendered turn, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*\|im_(?:start|end)\|>)", r"<\\$1")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*\|im_(?:start|end)\|>)", r"<$1")


def escape_role(role: Column) -> Column:
    return escape_text(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # Cut at pairs of backslashes, from left to right; what is left of them between the cuts belongs to line feeds.
    between = F.transform(F.split(unescape_text(role), r"\\\\"), lambda part: F.replace(part, F.lit("\\n"), F.lit("\n")))
    return F.array_join(between, "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """One row a turn: conv_id, turn, messages array<struct<role, text>>."""
    event = F.struct(
        F.col("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = events.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(event)).alias("log"))

    def final(start: Column, i: Column) -> Column:
        after = F.coalesce(F.get("starts", i + 1), F.size("log"))
        own = F.slice("log", start + 1, after - start)
        reset = F.array_max(F.transform(own, lambda e, k: F.when(e["kind"] != "delta", k).otherwise(0)))
        texts = F.transform(F.slice(own, reset + 1, F.size(own)), lambda e: F.when(e["kind"] == "regenerate", "").otherwise(e["text"]))
        return F.struct(F.element_at(own, 1)["role"].alias("role"), F.array_join(texts, "").alias("text"))

    starts = F.array_compact(F.transform("log", lambda e, i: F.when((i == 0) | (e["kind"] == "message"), i)))
    return turns.withColumn("starts", starts).select("conv_id", "turn", F.transform("starts", final).alias("messages"))


def format_chats(events: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss_spans array<struct<turn, start, end>>."""

    def render(m: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape_role(m["role"]), F.lit("\n"))
        body = escape_text(m["text"])
        span = F.when(m["role"] == LOSS_ROLE, F.struct(F.length(head).alias("start"), (F.length(head) + F.length(body)).alias("end")))
        return F.struct(F.concat(head, body, F.lit(CLOSE + "\n")).alias("text"), span.alias("span"))

    rendered = fold_events(events).select("conv_id", "turn", F.transform("messages", render).alias("part"))
    chats = rendered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "part"))).alias("turns"))
    parts = chats.select("conv_id", F.flatten(F.col("turns.part")).alias("parts"))
    spans = F.array_compact(F.transform("parts", lambda p, i: F.when(p["span"].isNotNull(), F.struct(i.alias("turn"), p["span"]["start"].alias("start"), p["span"]["end"].alias("end")))))
    return parts.select("conv_id", F.size("parts").cast("long").alias("n_turns"), F.array_join(F.col("parts.text"), "").alias("formatted"), spans.alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """Read ``formatted`` back: conv_id, formatted, turns array<struct<role, text>>, loss_texts array<string>."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2147483647)

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, F.lit("\n"))
        # The piece is "role\ntext<|im_end|>\n"; the last len(CLOSE) + 1 characters belong to the template.
        text = F.substr(piece, cut + 1, F.length(piece) - cut - F.lit(len(CLOSE) + 1))
        return F.struct(unescape_role(F.substr(piece, F.lit(1), cut - 1)).alias("role"), unescape_text(text).alias("text"))

    def masked(span: Column) -> Column:
        rendered = F.concat(F.lit(OPEN), F.get("pieces", span["turn"]))
        return unescape_text(F.substr(rendered, span["start"] + 1, span["end"] - span["start"]))

    cut = chats.withColumn("pieces", pieces)
    return cut.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), F.transform("loss_spans", masked).alias("loss_texts"))


def chat_digests(chats: DataFrame) -> DataFrame:
    """What was read back, as counts and hashes."""
    texts = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read_chats(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(texts.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def messages_as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished messages (conv_id, turn, role, text) as an event log: one ``message`` a row."""
    return conversations.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")
