"""Conversations of typed content parts as one training string each.

A visitor flattens every part of a turn: runs of text parts are escaped, image, audio and document parts become placeholders in
order, and the reference and expanded token count of each attachment are recorded in the same order. Control strings
look like `<|name|>`; in texts and roles a backslash is put into every `<|`, `<\\|`, `<\\\\|` ... , which can be undone
and leaves no `<|` behind. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Tokens that one unit of an attachment takes: a tile of an image, a second of audio, a page of a document.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def text_part(text: Column) -> Column:
    """An array of one text part; null counts as empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units")))


def _kind(part: Column) -> Column:
    """text, image or audio; document for any other kind of attachment."""
    kind = F.coalesce(part["type"], F.lit("text"))
    return F.when(kind.isin("text", "image", "audio"), kind).otherwise("document")


def _body(parts: Column) -> Column:
    """Parts in order; texts that stand side by side are escaped as one, as a control string may be split between them."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("text"))

    def visit(state: Column, part: Column) -> Column:
        kind = _kind(part)
        return F.when(kind == "text", F.struct(state["done"].alias("done"), F.concat(state["text"], F.coalesce(part["text"], F.lit(""))).alias("text"))).otherwise(
            F.struct(F.concat(state["done"], escape(state["text"]), F.lit("<|"), kind, F.lit("|>")).alias("done"), F.lit("").alias("text"))
        )

    return F.aggregate(parts, start, visit, lambda s: F.concat(s["done"], escape(s["text"])))


def format_chats(df: DataFrame, parts: Column, conversation: str = "conv_id", turn: str = "turn", role: str = "role", loss_role: str = "assistant", unit_tokens: Mapping[str, int] = UNIT_TOKENS) -> DataFrame:
    """One row for each conversation: formatted, mask, attachments, expanded_tokens.

    parts: an array of structs (type, text, ref, units). mask: for each turn in order the code points of its head, body
    and tail and whether the body counts for the loss. attachments: (type, ref, tokens) in the order of their
    placeholders. Turns go by turn (null first), ties by role and then content, so repeated rows stay and results don't
    depend on the partitions. A null role is empty, a null or empty array of parts an empty body; rows without a
    conversation form one; an empty table gives none. Other columns of df don't matter, whatever their names.
    """
    tokens = F.create_map(*[F.lit(x) for kv in unit_tokens.items() for x in kv])
    safe_parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    attachment = lambda p: F.struct(_kind(p).alias("type"), p["ref"].alias("ref"), (F.coalesce(p["units"], F.lit(0)) * F.coalesce(F.try_element_at(tokens, _kind(p)), F.lit(0))).cast("long").alias("tokens"))
    who = F.coalesce(F.col(role), F.lit(""))
    rows = df.select(
        F.col(conversation).alias(conversation),
        F.col(turn).alias("__turn"),
        F.concat(F.lit(START), escape(who), F.lit(SEP)).alias("__head"),
        _body(safe_parts).alias("__body"),
        (who == loss_role).alias("__loss"),
        F.transform(F.filter(safe_parts, lambda p: _kind(p) != "text"), attachment).alias("__att"),
    )
    turns = rows.groupBy(conversation).agg(F.sort_array(F.collect_list(F.struct("__turn", "__head", "__body", "__loss", "__att"))).alias("__t"))
    lengths = lambda t: F.struct(F.length(t["__head"]).alias("head"), F.length(t["__body"]).alias("body"), F.lit(len(END)).alias("tail"), t["__loss"].alias("loss"))
    out = turns.select(
        conversation,
        F.array_join(F.transform("__t", lambda t: F.concat(t["__head"], t["__body"], F.lit(END))), "").alias("formatted"),
        F.transform("__t", lengths).alias("mask"),
        F.flatten(F.transform("__t", lambda t: t["__att"])).alias("attachments"),
    )
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: Column, mask: Column) -> Column:
    """The turns of a formatted string: an array of (role, text, loss), with escapes undone and placeholders left in."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.zip_with(
        pieces,
        mask,
        lambda p, m: F.struct(
            unescape(F.substring_index(p, SEP, 1)).alias("role"),
            unescape(F.substr(p, m["head"] - len(START) + 1, m["body"])).alias("text"),
            m["loss"].alias("loss"),
        ),
    )
