"""Chat formatting: every assistant turn becomes an example of its own.

A turn is written as ``[INST] role [/INST]text</s>``. An example is the conversation up
to and including one assistant turn; only the text of that turn is trainable, all that
stands before it is context. Turns after the last assistant turn make one more example
that has nothing to train, so that the output holds every turn.

A control string inside a role or text gets a backslash after its first character
(``</s>`` becomes ``<\\/s>``, and that ``<\\\\/s>``), so no text can end a turn, and the
text comes back whole.

All examples of a conversation are prefixes of one string, so each conversation is
rendered once and its examples are cut out of it. One conversation has to fit into
memory; how many there are does not matter.

Defined results
    null text or role        empty
    null conv_id             a conversation of its own
    null turn                before all others
    equal turns              by role, then text; repeated rows stay
    no assistant turn        one example, nothing to train
    empty table              no examples
    columns of other names   not read
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed strings of the template.
START, MIDDLE, END = "[INST] ", " [/INST]", "</s>"
_FREE = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escaped(text: Column) -> Column:
    """``text`` with every control string in it made harmless."""
    return F.regexp_replace(text, _FREE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def examples(
    conversations: DataFrame,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conv_id, example, formatted, mask_start, mask_end``: one row per example.

    Examples are numbered from 0. The mask counts code points of ``formatted``, its end
    not included; both are 0 where there is nothing to train.
    """
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(role, F.lit("")).alias("role"),
            F.coalesce(text, F.lit("")).alias("text"),
        ).alias("turn"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    parts = whole.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                t["role"].alias("role"),
                F.concat(F.lit(START), escaped(t["role"]), F.lit(MIDDLE)).alias("head"),
                escaped(t["text"]).alias("body"),
            ),
        ).alias("parts"),
    )
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,train:boolean>>)")
    tail = len(END)

    def placed(done: Column, part: Column) -> Column:
        before = F.when(F.size(done) == 0, F.lit(0)).otherwise(F.get(done, F.size(done) - 1)["end"] + tail)
        start = before + F.char_length(part["head"])
        here = F.struct(
            start.alias("start"),
            (start + F.char_length(part["body"])).alias("end"),
            (part["role"] == "assistant").alias("train"),
        )
        return F.concat(done, F.array(here))

    spans = parts.select(
        "conv_id",
        F.array_join(
            F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""
        ).alias("rendered"),
        F.aggregate("parts", none, placed).alias("spans"),
    )
    last = F.size("spans") - 1
    kept = F.filter("spans", lambda s, i: s["train"] | (i == last))
    return spans.select("conv_id", "rendered", F.posexplode(kept).alias("example", "span")).select(
        "conv_id",
        "example",
        F.substring("rendered", F.lit(1), F.col("span.end") + tail).alias("formatted"),
        F.when(F.col("span.train"), F.col("span.start")).otherwise(F.lit(0)).alias("mask_start"),
        F.when(F.col("span.train"), F.col("span.end")).otherwise(F.lit(0)).alias("mask_end"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns that a formatted example was made of, as (role, text)."""
    pieces = F.split(formatted, END, -1)
    parsed = r"(?s)^\[INST\] (.*?) \[/INST\](.*)$"
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, parsed, 1)).alias("role"),
            unescaped(F.regexp_extract(p, parsed, 2)).alias("text"),
        ),
    )


def trained_text(formatted: Column, start: Column, end: Column) -> Column:
    """What stands under the mask, as it was before formatting."""
    return unescaped(F.substring(formatted, start + 1, end - start))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the examples alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``; the
    last counts the code points of all examples of the conversation.
    """
    per_conversation = formatted.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(
            F.collect_list(
                F.struct(
                    "example",
                    trained_text(
                        F.col("formatted"), F.col("mask_start"), F.col("mask_end")
                    ).alias("loss"),
                )
            )
        ).alias("losses"),
        F.sum(F.char_length("formatted").cast("long")).alias("formatted_chars"),
    )
    rows = per_conversation.select(
        "conv_id",
        turns_of(F.col("longest")).alias("turns"),
        F.array_join("losses.loss", "").alias("loss"),
        "formatted_chars",
    )
    written = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(written, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
