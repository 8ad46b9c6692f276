"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only its reply is
trainable. One more example without a trainable part holds a conversation that does not end with a reply, so that no
turn is lost.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In texts and roles every ``<`` that stands before a
``|`` gets one more ``|`` (``<|`` becomes ``<||``), so no text can hold a marker; reading takes it away again. A line
break in a role is written as ``<|nl|>``.

Defined results: null texts and null roles are empty; turns sort by (turn, role, text), null turns first, and repeated
rows are repeated turns; a null conversation id is a conversation; an empty table gives no example. An example holds
its whole context, so a conversation has to fit into a row, and its output grows with the square of its turns: that is
the method's own definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|", "<||")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|\|", "<|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def prefix_targets(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per example: conv_id, example (position of its last turn), text, loss_start, loss_length.

    The span counts code points of ``text``; ``loss_length`` is 0 and ``trainable`` false for a context without reply.
    """
    rows = conversations.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    formatted = turns.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == "assistant").alias("replies"),
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END + "\n"))).alias("parts"),
    )
    each = formatted.select("conv_id", "parts", F.posexplode("replies").alias("i", "trainable")).where(
        F.col("trainable") | (F.col("i") == F.size("parts") - 1)
    )
    context = F.array_join(F.slice("parts", F.lit(1), F.col("i")), "")
    before = F.length(context) + len(START + "assistant\n")
    own = F.length(F.get("parts", F.col("i"))) - len(START + "assistant\n" + END + "\n")
    return each.select(
        "conv_id",
        F.col("i").cast("long").alias("example"),
        F.concat(context, F.get("parts", F.col("i"))).alias("text"),
        "trainable",
        F.when(F.col("trainable"), before).otherwise(0).cast("long").alias("loss_start"),
        F.when(F.col("trainable"), own).otherwise(0).cast("long").alias("loss_length"),
    )


def read_turns(text: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    pieces = F.split(text, r"<\|im_end\|>\n", -1)
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            unescape_role(F.regexp_extract(p, r"^<\|im_start\|>([^\n]*)\n", 1)).alias("role"),
            unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )


def read_loss(text: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask of an example."""
    return unescape(F.substr(text, (start + 1).cast("int"), length.cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold, read back from them."""
    read = examples.select(
        "conv_id", "example", "text", "trainable", read_loss(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("loss")
    )
    whole = read.groupBy("conv_id").agg(
        read_turns(F.max_by("text", "example")).alias("turns"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("trainable"), F.struct("example", "loss")))), lambda x: x["loss"]
            ),
            "",
        ).alias("loss"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
