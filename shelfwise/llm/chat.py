"""Chat formatting by prefix-target expansion (native: DataFrame functions only).

Every assistant turn becomes an example: all turns before it are context, only
that reply is trainable. A conversation's text is kept once and each example
refers to a prefix of it, so a conversation of T turns costs O(T) and not the
O(T^2) of T copied prefixes; :func:`example_text` gives an example in full.

Template, one segment per turn::

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Inside roles and texts ``&`` is written ``&amp;`` and ``<|`` is written
``&lt;|`` (and a line feed in a role ``&#10;``), so no text can hold a mark, and
unescaping gives the text back exactly.

Defined cases: null role or text counts as empty; rows with the same turn are
ordered by role, then text; repeated rows are turns of their own; a null turn
sorts first; a null conv_id is one conversation of its own; a conversation with
no assistant turn has no example (loss_chars 0, digest of the empty text); an
empty table gives an empty result; other columns are ignored. One conversation is
one row, so it must fit in a task: the contract's digest of its whole text needs
that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def format_conversations(df: DataFrame) -> DataFrame:
    """conv_id and the whole formatted text, one row per conversation."""
    turns = df.select("conv_id", F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    segment = lambda t: F.concat(
        F.lit(START), _escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))
    return (turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
            .select("conv_id", F.array_join(F.transform("turns", segment), "").alias("formatted")))


def _segments(formatted: Column) -> Column:
    """The segments of a formatted text, without their marks."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1),
                       lambda s: F.substr(s, F.lit(len(START) + 1)))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted text, unescaped."""
    def turn(s):
        head = F.substring_index(s, "\n", 1)
        return F.struct(_unescape_role(head).alias("role"),
                        unescape(F.substr(s, F.length(head) + 2)).alias("text"))
    return F.transform(_segments(formatted), turn)


def expand_examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, number (from 0), context_turns,
    context_chars (the prefix of the formatted text before the reply's segment),
    loss_start and loss_end (the code points of the example under the loss mask)
    and the reply as it stands in the text (escaped). The context itself stays in
    the conversation's row.
    """
    order = Window.partitionBy("conv_id").orderBy("context_turns")
    rows = (formatted.select("conv_id", F.posexplode(_segments(F.col("formatted"))).alias("context_turns", "segment"))
            .withColumn("size", F.length("segment") + len(START) + len(END) + 1)
            .withColumn("context_chars", F.coalesce(
                F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))))
    head = len(START) + len(TRAINED_ROLE) + 1
    reply = F.substr(F.col("segment"), F.lit(len(TRAINED_ROLE) + 2))
    return (rows.filter(F.substring_index("segment", "\n", 1) == TRAINED_ROLE)
            .select("conv_id", (F.row_number().over(order) - 1).alias("number"), "context_turns", "context_chars",
                    (F.col("context_chars") + head).alias("loss_start"),
                    (F.col("context_chars") + head + F.length(reply)).alias("loss_end"), reply.alias("reply")))


def example_text(formatted: Column, loss_end: Column) -> Column:
    """The full text of one example: its context and its reply's segment."""
    return F.substr(formatted, F.lit(1), (loss_end + len(END) + 1).cast("int"))


def chat_digest(df: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted output, one row per conversation."""
    fmt = format_conversations(df)
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    turns = read_turns(F.col("formatted"))
    conv = fmt.select(
        "conv_id", F.size(turns).cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, line), ""), 256).alias("turns_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars")).alias("c")
    ex = (expand_examples(fmt).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("number", unescape(F.col("reply")).alias("text")))).alias("replies"),
        F.count(F.lit(1)).alias("n_examples"), F.sum(F.col("loss_end") + len(END) + 1).alias("example_chars"))
        .withColumn("loss", F.array_join(F.transform("replies", lambda r: r["text"]), "")).alias("x"))
    loss = F.coalesce("x.loss", F.lit(""))
    none = F.lit(0).cast("bigint")
    return conv.join(ex, F.col("c.conv_id").eqNullSafe(F.col("x.conv_id")), "left").select(
        "c.conv_id", "n_turns", "turns_sha256", F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
        F.coalesce("x.n_examples", none).alias("n_examples"), F.coalesce("x.example_chars", none).alias("example_chars"))
