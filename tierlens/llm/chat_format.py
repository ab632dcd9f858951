"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the text holds all preceding turns
as context and then the reply, and only the reply's characters are trainable
(``loss_start``, ``loss_end``: code points, end exclusive).  When a conversation does
not end with an assistant turn, one more row holds the whole transcript with no
trainable part, so that nothing is lost.

Turns are marked ``<|im_start|>role\\n`` ... ``<|im_end|>\\n``.  Inside texts and roles
a backslash is doubled and ``<|`` is written ``<\\|`` (in roles a line feed is written
``\\n``), so control strings in the data can never act as marks and come back exactly.

Turns are ordered by (turn, role, text), nulls first; a null text or role is empty; a
repeated row is a turn like any other; rows without a conv_id form one conversation;
an empty table gives an empty result; other columns are ignored.  The method's output
for one conversation grows with the square of its length; the conversation's turns are
gathered in one row, because each example contains them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c):
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(c):
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape(c):
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def unescape_role(c):
    return unescape(F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, transcript): ``example`` is the
    target's place among the turns; ``transcript`` marks the row that holds all turns."""
    t = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    t = t.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    mark = F.transform("t", lambda x: F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"), escape(x["text"]), F.lit(END)))
    g = g.select("conv_id", "t", mark.alias("m"), F.size("t").alias("n"))
    last = F.element_at("t", -1)["role"]
    replies = F.filter(F.transform("t", lambda x, i: F.when(x["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
    targets = F.when(last == "assistant", replies).otherwise(F.concat(replies, F.array("n")))
    e = g.select("conv_id", "t", "m", "n", F.explode(targets).alias("example"))
    text = F.array_join(F.slice("m", 1, F.col("example")), "")
    reply = F.element_at("t", F.col("example"))["role"] == "assistant"
    e = e.select("conv_id", "example", text.alias("text"), reply.alias("reply"), (F.col("example") == F.col("n")).alias("transcript"),
                 F.length(escape(F.element_at("t", F.col("example"))["text"])).alias("len"))
    stop = F.length("text") - len(END)
    return e.select("conv_id", "example", "text", F.when(F.col("reply"), stop - F.col("len")).alias("loss_start"),
                    F.when(F.col("reply"), stop).alias("loss_end"), "transcript")


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: its turns and its trainable text."""
    pieces = F.split(F.col("text"), r"<\|im_end\|>\n")
    body = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, len(START) + 1, 2**31 - 1))
    turns = F.transform(body, lambda b: F.struct(
        unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(F.substr(b, F.instr(b, "\n") + 1)).alias("text")))
    loss = unescape(F.expr("substr(text, loss_start + 1, loss_end - loss_start)"))
    e = examples.select(
        "conv_id", "example", F.length("text").cast("long").alias("chars"), F.coalesce(loss, F.lit("")).alias("loss"),
        F.when(F.col("transcript"), turns).alias("turns"))
    return e.groupBy("conv_id").agg(
        F.max_by("turns", "example").alias("turns"), F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"))


def written(examples: DataFrame) -> DataFrame:
    """The examples as a table in the shared folder, read again."""
    return stored(examples, "chat")
