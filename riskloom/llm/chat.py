r"""Chat formatting from event logs.

A conversation is a log of events. ``reconstruct`` partitions the log by
conversation and message, sorts each message's events by sequence and folds them:
a delta appends its text, an edit replaces what is there, a regeneration starts
the message anew, a deletion removes it. ``render`` writes each conversation's
messages, by the sequence of their first event, in one string

    <|turn|>role<|text|>text<|end|>\n

and gives the loss mask: start and length, in code points, of what assistants
say. Control strings inside roles and texts (of this template and of other
common ones) get a backslash after their first character, after any backslashes
that stand there; taking one away restores the text. ``parse`` and ``loss_text``
read turns and masked text back. Only built-in functions are used.

A message's events are folded before conversations meet, so a long stream costs
its own message only; a conversation's string is one value by nature.

Results for odd input: null text and null role count as empty; events of one
sequence are ordered by kind and text; rows with a null conversation form one
conversation; repeated rows are repeated events; an empty log gives an empty
result. Columns besides those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: First character, backslashes and rest of a control string.
CONTROL = r"([<\[])(\\*)(\|[A-Za-z_]+\|>|/?s>|/?INST\]|</?SYS>>)"
ESCAPED = r"([<\[])(\\*)\\(\|[A-Za-z_]+\|>|/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, message, seq, role, text from conv_id, seq, message, kind, role, text."""
    rows = events.select("conv_id", "message", F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")).alias("e"))
    logs = rows.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list("e")).alias("log"))
    resets = F.filter("log", lambda e: e["kind"] != "delta")
    logs = logs.withColumn("reset", F.when(F.size(resets) > 0, F.element_at(resets, -1)["seq"]))
    live = F.filter("log", lambda e: F.col("reset").isNull() | (e["seq"] > F.col("reset")) | ((e["seq"] == F.col("reset")) & (e["kind"] == "edit")))
    logs = logs.filter(~F.exists("log", lambda e: (e["kind"] == "delete") & (e["seq"] == F.col("reset"))))
    return logs.select(
        "conv_id", "message", F.col("log")[0]["seq"].alias("seq"), F.col("log")[0]["role"].alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss (array of start, length) of each conversation."""
    body = escape(F.col("text"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    parts = messages.select("conv_id", "seq", "role", "text", "message", head.alias("head"), body.alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text", "message")
    parts = parts.withColumn("n", F.row_number().over(order)).withColumn("stop", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.when(
        (F.col("role") == loss_role) & (F.length("body") > 0),
        F.struct((F.col("stop") - len(END) - F.length("body")).alias("start"), F.length("body").cast("long").alias("length")),
    )
    turns = F.sort_array(F.collect_list(F.struct("n", F.concat("head", "body", F.lit(END)).alias("s"), span.alias("loss"))))
    out = parts.groupBy("conv_id").agg(turns.alias("t"))
    return out.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["s"]), "").alias("formatted"),
        F.array_compact(F.transform("t", lambda x: x["loss"])).alias("loss"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    cut = lambda x: F.split(F.substring(x, F.lit(1), F.length(x) - len(END)), r"<\|text\|>")
    return F.transform(F.transform(turns, cut), lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    part = lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))
    return F.array_join(F.transform(loss, part), "")


def turn_events(turns: DataFrame) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as a log: every row is one message's only delta."""
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.monotonically_increasing_id().alias("message"),
        F.lit("delta").alias("kind"), "role", "text",
    )


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of rendered conversations, read back from the strings."""
    read = chats.select("conv_id", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("said"), F.length("formatted").cast("long").alias("formatted_chars"))
    plain = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(plain, 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), "formatted_chars",
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z_]+\|>|/?s>|/?INST\]|</?SYS>>)', '\1\2\\\3', 'g') AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(body) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
