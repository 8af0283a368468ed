"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context and only its text trainable. A turn is written as

    <|im_start|>role\\ntext<|im_end|>\\n

Inside roles and texts every ``<`` followed by any number of backslashes and a
bar gets one backslash more, so no text can hold a control string, and taking one
backslash away restores it; a role's line breaks are written as backslash-n.
Turns behind the last assistant turn (or all, if there is none) follow in a last
example without a trainable part, so that the output holds every conversation whole.

An example repeats its context, so a conversation of n turns grows with n squared:
that is the format. Examples of one conversation are built row by row from its
turns, one output row per example.

Defined results: null text and null role count as empty; a null conversation is a
conversation; turns are ordered by ``turn`` (null first), then role, then text;
repeated rows stay; an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "<|im_start|>"
END = "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def restored(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def restored_role(role: Column) -> Column:
    # doubled backslashes, from the left, are backslashes; what stands between them holds line breaks only
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return restored(F.array_join(parts, "\\"))


def examples(turns: DataFrame) -> DataFrame:
    """``conv_id, example, formatted, loss_start, loss_chars``: one row per
    assistant turn, and one for turns behind the last (``loss_chars`` null).

    ``loss_start`` and ``loss_chars`` give the trainable part of ``formatted`` in
    code points, escapes included.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    turn = F.struct("turn", role.alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    listed = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def formatted_turn(t: Column) -> Column:
        head = F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"))
        return F.struct(t["role"].alias("role"), head.alias("head"), escaped(t["text"]).alias("body"))

    # escaped after sorting: ties are ordered by the texts themselves
    listed = listed.select("conv_id", F.transform("turns", formatted_turn).alias("turns"))
    written_turn = lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))
    n = F.size("turns")
    answers = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i.cast("int"))["role"] == "assistant")
    ends = F.when(F.coalesce(F.try_element_at("answers", F.lit(-1)), F.lit(0)) == n, F.col("answers")).otherwise(F.concat("answers", F.array(n)))
    listed = listed.select("conv_id", "turns", F.transform("turns", written_turn).alias("lines"), answers.alias("answers"))
    rows = listed.select("conv_id", "turns", "lines", F.posexplode(ends).alias("example", "at"))
    last = F.element_at("turns", F.col("at"))
    context = F.array_join(F.slice("lines", F.lit(1), F.col("at") - 1), "")
    trained = last["role"] == "assistant"
    return rows.select(
        "conv_id",
        "example",
        F.concat(context, F.element_at("lines", F.col("at"))).alias("formatted"),
        F.when(trained, F.length(context) + F.length(last["head"])).alias("loss_start"),
        F.when(trained, F.length(last["body"])).alias("loss_chars"),
    )


def parsed(formatted: Column) -> Column:
    """Array of ``role, text`` read back from an example."""
    lines = F.slice(F.split(formatted, r"<\|im_end\|>\n"), F.lit(1), F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1)

    def turn(line):
        inner = F.substr(line, F.lit(len(START) + 1))
        cut = F.instr(inner, "\n")
        return F.struct(restored_role(F.left(inner, cut - 1)).alias("role"), restored(F.substr(inner, cut + 1)).alias("text"))

    return F.transform(lines, turn)


def trainable(formatted: Column, start: Column, chars: Column) -> Column:
    return restored(F.substr(formatted, start + 1, chars))


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its examples hold: ``conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars``."""
    rows = formatted.select(
        "conv_id",
        "example",
        "formatted",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("loss_chars").isNotNull(), trainable(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))).alias("loss"),
    )
    whole = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", F.coalesce("loss", F.lit("")).alias("loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    back = whole.withColumn("turns", parsed(F.col("whole")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
