r"""Chat formatting with DataFrame operations only: prefix-target expansion.

Every assistant turn becomes an example of its own: the text of all turns before it and its own, with the loss on that
reply alone. A conversation that does not end with an assistant turn gets one more row without a target, so that the
examples hold every turn.

Template: ``<|start|>role\ntext<|end|>\n`` for each turn. Control strings inside a text (those of the template, and the
usual ``<s> </s> [INST] [/INST] <|...|>``) get a backslash after their first character, and one that already has
backslashes there gets one more; taking one away gives the text back. A role has its line ends and backslashes escaped
too, so that its header stays one line.

How it scales. Conversations are independent: one shuffle by conv_id gathers the turns of each, the examples are
generated row by row from that, and nothing holds two conversations. Examples repeat their context, which is what the
method asks for: their size grows with the square of a conversation's length, so cut conversations beyond the context
length of the model to be trained before formatting them.

Defined cases: null text and null role are empty; turns are in the order of ``turn`` (null first; ties by role, then
text); repeated rows are turns of their own; null conv_id is one conversation; an empty table gives no rows; columns
other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|start|>", "<|end|>\n"
TARGET = "assistant"
#: What a control string is, after its first character and any backslashes.
CONTROL = r"(/?s>|/?INST\]|\|[A-Za-z_]+\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # Doubled backslashes stand aside as a character that no role holds after the first step.
    aside = F.replace(F.replace(unescape(role), F.lit("\x00"), F.lit("\x00z")), F.lit("\\\\"), F.lit("\x00b"))
    return F.replace(F.replace(F.replace(aside, F.lit("\\n"), F.lit("\n")), F.lit("\x00b"), F.lit("\\")), F.lit("\x00z"), F.lit("\x00"))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), last (whether it holds the whole conversation), text, loss_start, loss_end.

    The loss covers the code points from loss_start to loss_end (exclusive); both are null in a row without a target.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").alias("conv_id"), F.struct(F.col("turn").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).alias("t"))
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    parts = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct((t["role"] == TARGET).alias("target"), head(t).alias("head"), escape(t["text"]).alias("body")))
    whole = turns.groupBy("conv_id").agg(parts.alias("parts")).withColumn("n", F.size("parts"))
    at = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at("parts", i + 1)["target"] | (i == F.col("n") - 1))
    rows = whole.select("conv_id", "n", "parts", F.posexplode(at).alias("example", "i"))
    own = F.element_at("parts", F.col("i") + 1)
    context = F.array_join(F.transform(F.slice("parts", 1, F.col("i")), lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    rows = rows.select("conv_id", "example", (F.col("i") == F.col("n") - 1).alias("last"), F.concat(context, own["head"]).alias("before"), own.alias("own"))
    start = F.when(F.col("own.target"), F.length("before").cast("long"))
    return rows.select("conv_id", "example", "last", F.concat("before", "own.body", F.lit(END)).alias("text"), start.alias("loss_start"), (start + F.length("own.body")).alias("loss_end"))


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    bodies = F.split(text, r"<\|end\|>\n", -1)
    inner = F.transform(F.slice(bodies, 1, F.size(bodies) - 1), lambda b: F.substring(b, len(START) + 1, F.length(b)))
    return F.transform(inner, lambda b: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substring(b, F.instr(b, "\n") + 1, F.length(b))).alias("text")))


def read_back(found: DataFrame) -> DataFrame:
    """One row per conversation with digests of what the examples hold, all parsed from their texts."""
    turns = F.when(F.col("last"), read_turns(F.col("text")))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))))
    rows = found.select("conv_id", "example", F.size(turns).alias("n"), F.sha2(said, 256).alias("sha"), loss.alias("loss"), F.length("text").alias("size"), "last")
    grouped = rows.groupBy("conv_id").agg(
        F.max(F.when(F.col("last"), F.col("n"))).cast("long").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
        F.sum("size").alias("formatted_chars"),
    )
    all_loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return grouped.select("conv_id", "n_turns", "turns_sha256", F.length(all_loss).cast("long").alias("loss_chars"), F.sha2(all_loss, 256).alias("loss_sha256"), "formatted_chars")
