"""Relational chat formatting: Spark expressions only.

One formatted string per conversation. Turns are collected as structs, sorted by
(turn, role, text), adjacent turns of one role merge into one block, and blocks
are concatenated. Control strings inside texts and roles are escaped reversibly,
so :func:`read_turns` gives back the rows exactly.

Defined results: null text and null role count as empty strings; a null
conversation id is a conversation of its own; repeated rows are kept as turns of
their own; ties in turn are ordered by role, then text; a null turn sorts first;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

START, SEP, PART, END = "<|im_start|>", "<|im_sep|>", "<|im_part|>", "<|im_end|>"
#: Strings that some tokenizer or template gives a meaning; escaped inside texts.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESC = "^"


def escape(text: Column) -> Column:
    """Double the escape sign, then break each control string after its first character."""
    out = F.replace(text, F.lit(ESC), F.lit(ESC * 2))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESC + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in reversed(CONTROL):
        out = F.replace(out, F.lit(c[0] + ESC + c[1:]), F.lit(c))
    return F.replace(out, F.lit(ESC * 2), F.lit(ESC))


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: Iterable[str] = ("assistant",)
) -> DataFrame:
    """conv, n_turns, formatted, segments: array of (text, loss).

    The segments concatenate to formatted; loss marks those a model is trained on
    (escaped texts of loss_roles, without any mark of the template).
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    roles = list(loss_roles)

    def segments(ts: Column, n: Column) -> Column:
        def of(t: Column, i: Column) -> Column:
            first = (i == 0) | (F.get(ts, i - 1)["role"] != t["role"])
            last = (i == n - 1) | (F.get(ts, i + 1)["role"] != t["role"])
            head = F.when(first, F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))).otherwise(F.lit(PART))
            tail = F.when(last, F.lit(END + "\n")).otherwise(F.lit(""))
            seg = lambda x, on: F.struct(x.alias("text"), on.alias("loss"))
            return F.array(seg(head, F.lit(False)), seg(escape(t["text"]), t["role"].isin(roles)), seg(tail, F.lit(False)))

        return F.flatten(F.transform(ts, of))

    out = chats.select("conv_id", F.size("ts").cast("long").alias("n_turns"), let(F.col("ts"), lambda ts: segments(ts, F.size(ts))).alias("segments"))
    return out.select("conv_id", "n_turns", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    blocks = F.filter(F.split(formatted, re.escape(END + "\n")), lambda b: b != "")

    def of(block: Column) -> Column:
        return let(
            F.split(F.substring(block, len(START) + 1, 2**31 - 1), re.escape(SEP)),
            lambda p: F.transform(F.split(p[1], re.escape(PART)), lambda x: F.struct(unescape(p[0]).alias("role"), unescape(x).alias("text"))),
        )

    return F.flatten(F.transform(blocks, of))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(chats: DataFrame) -> DataFrame:
    """Counts and digests read back from the output of format_chats()."""
    back = chats.select(
        "conv_id",
        let(read_turns(F.col("formatted")), lambda ts: F.struct(F.size(ts).cast("long").alias("n"), F.sha2(F.array_join(F.transform(ts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("h"))).alias("r"),
        let(loss_text(F.col("segments")), lambda x: F.struct(F.length(x).cast("long").alias("n"), F.sha2(x, 256).alias("h"))).alias("l"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return back.select("conv_id", F.col("r.n").alias("n_turns"), F.col("r.h").alias("turns_sha256"), F.col("l.n").alias("loss_chars"), F.col("l.h").alias("loss_sha256"), "formatted_chars")
