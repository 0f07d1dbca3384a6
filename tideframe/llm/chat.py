"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, merged where neighbours have one role, and
concatenated:

    <|im_start|>role\\ntext<|im_sep|>text of a merged turn<|im_end|>\\n

Control strings inside texts and roles are escaped: wherever `<`, any number of backslashes and `|`
meet, one backslash is added. No escaped text holds `<|`, so the output can be cut at its control strings
without doubt, and unescaping takes that one backslash away again.

The loss mask is a list of (start, length) in characters of the output; it covers each assistant text, and
neither headers nor control strings.

Defined cases: null texts and roles count as empty; rows that share conversation and turn are ordered by
role and text; turns that are null come first; rows of a null conversation form one conversation; an empty
table gives an empty result; extra columns are ignored. A conversation is one value of one row, so
its formatted text is bounded by what a row holds (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def escape_role(c: Column) -> Column:
    """A role ends at the first line feed, so those inside it are written as a backslash and n, and backslashes twice."""
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    """Between pairs of backslashes, a backslash and n is a line feed; no stand-in for the pairs is needed."""
    lines = F.transform(F.split(unescape(c), r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(lines, "\\")


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """conv_id, formatted, and loss_mask (array of start and length, in characters from 0)."""
    rows = narrow(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")

    def head(role: Column, before: Column, first: Column) -> Column:
        """What comes before a turn's text: a new header, or a separator where the role goes on."""
        header = F.concat(F.when(first, F.lit("")).otherwise(F.lit(END + "\n")), F.lit(START), escape_role(role), F.lit("\n"))
        return F.when(first | (before != role), header).otherwise(F.lit(SEP))

    # the start of a turn's text is a running sum, so a long conversation costs no more a turn than a short one
    before = F.lag("role").over(in_order)
    rows = rows.withColumn("lead", F.length(head(F.col("role"), before, before.isNull())))
    rows = rows.withColumn("size", F.col("lead") + F.length(escape(F.col("text"))))
    done = F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("at", (done - F.col("size") + F.col("lead")).cast("int"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "at"))).alias("t"))

    def part(x: Column, i: Column) -> Column:
        before = F.get(F.col("t"), i - 1)
        return F.concat(head(x["role"], before["role"], i == 0), escape(x["text"]))

    spoken = F.filter("t", lambda x: x["role"] == loss_role)
    spans = F.transform(spoken, lambda x: F.struct(x["at"].alias("start"), F.length(escape(x["text"])).alias("length")))
    body = F.array_join(F.transform("t", part), "")
    return sorted_turns.select("conv_id", F.concat(body, F.lit(END + "\n")).alias("formatted"), spans.alias("loss_mask"))


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) and loss_text, read back from the formatted string and its mask."""
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda _, i: i > 0)

    def texts(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END + "\n"))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda x: F.struct(unescape_role(role).alias("role"), unescape(x).alias("text")))

    loss = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return chats.select("conv_id", F.flatten(F.transform(blocks, texts)).alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")
