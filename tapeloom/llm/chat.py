"""Chat formatting with one training example per assistant turn, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template: a turn is HEAD, role, MIDDLE, text, END.
HEAD, MIDDLE, END = "### ", ": ", " </turn>\n"
# Characters that control strings are made of, and how a text or role writes them.  The first pair is
# the escape character itself: it is written first and read last.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One row per assistant turn, with all preceding turns as context and only that reply trainable.

    Returns ``conv, example`` (from 1), ``is_last, formatted, loss_start, loss_length``: the loss mask
    covers ``loss_length`` code points of ``formatted`` from ``loss_start`` (from 0) on, the escaped
    reply without its control strings.  Turns after the last reply, or of a conversation without one,
    make a last example of their own whose mask is empty, so that no turn is lost.

    Turns are ordered by ``turn``, then role and text; null turns come first, a null role or text is
    empty, rows with a null ``conv`` are one conversation, repeated rows are turns of their own.  Other
    columns are ignored; no rows give no rows.  A conversation is one row of the shuffle, as each of
    its examples holds all that came before; its examples are made one at a time.
    """
    said = F.struct(F.col(turn), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = turns.groupBy(F.col(conv).alias("conv")).agg(F.array_sort(F.collect_list(said)).alias("turns"))
    heads = F.transform("turns", lambda t: F.concat(F.lit(HEAD), escape(t["role"]), F.lit(MIDDLE)))
    whole = whole.select(
        "conv",
        heads.alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("texts"),
        F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == target, i + 1)), lambda i: i.isNotNull()).alias("ends"),
    )
    parts = F.transform(F.arrays_zip("heads", "texts"), lambda p: F.concat(p["heads"], p["texts"], F.lit(END)))
    size = F.size("texts")
    rest = F.when(F.coalesce(F.array_max("ends"), F.lit(0)) < size, F.array(size)).otherwise(F.array().cast("array<int>"))
    whole = whole.select("*", parts.alias("parts"), F.size("ends").alias("replies"), F.concat("ends", rest).alias("all_ends"))
    one = whole.select("*", F.posexplode("all_ends").alias("place", "end"))
    context = F.array_join(F.slice("parts", F.lit(1), F.col("end") - 1), "")
    reply = F.col("place") < F.col("replies")
    last = F.element_at("parts", F.col("end"))
    one = one.select(
        "conv", "place", "replies", "all_ends", "end", reply.alias("reply"), context.alias("context"), last.alias("last"),
        F.length(F.element_at("heads", F.col("end"))).alias("head"), F.length(F.element_at("texts", F.col("end"))).alias("body"),
    )
    return one.select(
        F.col("conv").alias(conv),
        (F.col("place") + 1).alias("example"),
        (F.col("place") + 1 == F.size("all_ends")).alias("is_last"),
        F.concat("context", "last").alias("formatted"),
        F.when(F.col("reply"), F.length("context") + F.col("head")).otherwise(0).alias("loss_start"),
        F.when(F.col("reply"), F.col("body")).otherwise(0).alias("loss_length"),
    )


def trained(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask, as it was before escaping."""
    return unescape(F.substring(formatted, start + 1, length))


def parse(formatted: Column) -> Column:
    """Array of (role, text): the turns of a formatted example."""

    def turn(piece: Column) -> Column:
        middle = F.instr(piece, MIDDLE)  # the first one: an escaped role has no colon
        role = F.substring(piece, F.lit(len(HEAD) + 1), middle - len(HEAD) - 1)
        text = F.substring(piece, middle + len(MIDDLE), F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.filter(F.split(formatted, END), lambda p: p != ""), turn)


def conversation_digest(made: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, all read back from the examples: the number of turns and the digest of roles and
    texts from the last example, the texts under the loss masks in order, and the code points made."""
    reply = F.when(F.col("loss_length") >= 0, F.struct("example", trained(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("text")))
    got = made.groupBy(conv).agg(
        F.collect_list(F.when(F.col("is_last"), F.col("formatted"))).alias("full"),
        F.array_sort(F.collect_list(reply)).alias("replies"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    got = got.select(conv, "formatted_chars", parse(F.get("full", F.lit(0))).alias("turns"), F.array_join(F.col("replies")["text"], "").alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return got.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
