"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only that reply is trainable
(``loss_start`` and ``loss_end`` bound it in code points). A conversation that does not end with an assistant turn
gives one more example with all its turns and nothing trainable, so no turn is lost.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` a turn. Inside roles and texts a backslash is doubled and
``<|`` becomes ``<\\|``, so no control string can appear there; a line feed in a role becomes ``<\\n``. `unescape` undoes
it exactly.

Turns are ordered by turn, then role, then text (nulls first); repeated rows are turns of their own; a null role or
text is empty; rows without a conversation id form one conversation; other columns are ignored; an empty table gives
no examples. One shuffle brings a conversation together: its digest is that of one string, so a conversation has to
fit a task. Examples are made one at a time, so the expansion itself, which is quadratic in a conversation's turns, is
never held whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_CLOSE_PATTERN = r"<\|im_end\|>\n"


def _swap(column: Column, old: str, new: str) -> Column:
    return F.replace(column, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    """Text in which no control string can appear."""
    return _swap(_swap(text, "\\", "\\\\"), "<|", "<\\|")


def unescape(text: Column) -> Column:
    """The text that `escape` was given."""
    return _swap(_swap(text, "<\\|", "<|"), "\\\\", "\\")


def escape_role(role: Column) -> Column:
    """As `escape`, and on one line."""
    return _swap(escape(role), "\n", "<\\n")


def unescape_role(role: Column) -> Column:
    """The role that `escape_role` was given."""
    return _swap(_swap(_swap(role, "<\\n", "\n"), "<\\|", "<|"), "\\\\", "\\")


def examples(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trainable: str = "assistant") -> DataFrame:
    """A row per example: ``id_col``, ``target`` (turns in it), ``is_last``, ``text``, ``loss_start``, ``loss_end``."""
    c = conversations
    turns = c.select(
        c[id_col].alias("id"),
        F.struct(c[turn_col].alias("turn"), F.coalesce(c[role_col], F.lit("")).alias("role"), F.coalesce(c[text_col], F.lit("")).alias("text")).alias("t"),
    )
    whole = turns.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    formatted = whole.select(
        "id",
        F.transform("ts", lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))).alias("parts"),
        F.transform("ts", lambda t: F.when(t["role"] == trainable, F.char_length(escape(t["text"])))).alias("reply"),
    )
    targets = F.filter(F.transform("reply", lambda n, i: F.when(n.isNotNull() | (i == F.size("reply") - 1), i + 1)), lambda k: k.isNotNull())
    each = formatted.select("id", "parts", "reply", F.explode(targets).alias("target"))
    text = each.select("id", "target", (F.size("parts") == F.col("target")).alias("is_last"), F.array_join(F.slice("parts", 1, F.col("target")), "").alias("text"), F.element_at("reply", F.col("target")).alias("n"))
    end = F.when(F.col("n").isNotNull(), F.char_length("text") - len(CLOSE))
    return text.select(F.col("id").alias(id_col), "target", "is_last", "text", (end - F.col("n")).alias("loss_start"), end.alias("loss_end"))


def parse(text: Column) -> Column:
    """The turns of an example as an array of (role, text)."""
    pieces = F.split(text, _CLOSE_PATTERN)
    bodies = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.substr(p, F.lit(len(OPEN) + 1)))
    return F.transform(bodies, lambda b: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substr(b, F.instr(b, F.lit("\n")) + 1)).alias("text")))


def digests(made: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation what its examples say when they are read back: turns, trainable text and formatted length."""
    turns = parse(F.col("text"))
    read = made.select(
        id_col,
        "target",
        F.char_length("text").cast("long").alias("chars"),
        F.when(F.col("loss_start").isNotNull(), unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))).alias("loss"),
        F.when(F.col("is_last"), turns).alias("turns"),
    ).select(
        id_col, "target", "chars", "loss",
        F.size("turns").cast("long").alias("n"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"),
    )
    losses = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("target", "loss")))), lambda s: s["loss"]), "")
    return (
        read.groupBy(id_col)
        .agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), losses.alias("all"), F.sum("chars").alias("formatted_chars"))
        .select(id_col, "n_turns", "turns_sha256", F.char_length("all").cast("long").alias("loss_chars"), F.sha2("all", 256).alias("loss_sha256"), "formatted_chars")
    )
