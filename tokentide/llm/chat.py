"""Chat formatting: turns with typed content parts become one marked-up string.

A turn's content is a list of parts. A visitor, an expression over that list, turns
a text part into its escaped text and an image, audio or document part into a
placeholder, in order, and records for each placeholder what it refers to and how
many tokens it will expand to. A turn is ``<|role|>``, a line end, its content,
``<|end|>`` and a line end. The loss mask is a list of ranges (start, length, in
code points) that cover the content of assistant turns.

Inside texts and roles, control strings are broken by a backslash after their first
character, and a backslash is doubled, so ``unescape`` gives the text back and no
control string in a text can pass for a mark.

Only DataFrame functions. Offsets come from a running sum by conversation, which
uses the same shuffle as the grouping; a conversation meets in one task because
its result is one string.

Defined cases: a null text, part list or role counts as empty; null parts are passed
over, as are parts of an unknown type; a null conv_id is a conversation of its own;
equal turn numbers are ordered by role, then content, and repeated rows all stay; a
null turn comes first; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Control strings of this template and of common ones.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = r"(<(?=\|)|\|(?=>)|<(?=/?s>)|\[(?=/?INST\])|<(?=</?SYS>>))"
END = "<|end|>\n"
ASSISTANT = "assistant"

#: A content part: its type, and what that type needs.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PARTS = f"array<{PART}>"

#: Pixels of an image patch's side, tokens of a second of audio, tokens of a page.
PATCH = 28
AUDIO_RATE = 25
PAGE_TOKENS = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A part list of one text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).cast("array<struct<type:string,text:string>>")


def _tokens(part: Column) -> Column:
    """Tokens that the placeholder of a part expands to."""
    side = lambda n: F.ceil(F.coalesce(part[n], F.lit(0)) / PATCH)
    return (
        F.when(part["type"] == "image", F.greatest(F.lit(1), side("width") * side("height")))
        .when(part["type"] == "audio", F.greatest(F.lit(1), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE)))
        .when(part["type"] == "document", F.greatest(F.lit(1), F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS))
        .cast("bigint")
    )


def visit(parts: Column) -> tuple[Column, Column]:
    """Content string of a part list, and its attachments in order (type, ref, tokens)."""
    known = F.filter(parts, lambda p: p["type"].isin("text", "image", "audio", "document"))
    content = F.transform(
        known, lambda p: F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), p["type"], F.lit("|>")))
    )
    attached = F.transform(
        F.filter(known, lambda p: p["type"] != "text"), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))
    )
    return F.coalesce(F.array_join(content, ""), F.lit("")), F.coalesce(attached, F.array().cast("array<struct<type:string,ref:string,tokens:bigint>>"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, parts).

    Columns: conv_id, formatted, loss (ranges: start, length), attachments (turn,
    type, ref, tokens, in the order of the placeholders), attachment_tokens.
    """
    content, attached = visit(F.col("parts").cast(PARTS))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), attached.alias("attached"))
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    rows = rows.withColumn("head", F.length(head)).withColumn("piece", F.concat(head, "content", F.lit(END)))
    upto = W.partitionBy("conv_id").orderBy("turn", "role", "content").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("start", F.sum(F.length("piece")).over(upto) - F.length("piece"))
    one = F.struct(
        "start",
        "piece",
        (F.col("role") == ASSISTANT).alias("learned"),
        (F.col("start") + F.col("head")).alias("content_start"),
        F.length("content").cast("bigint").alias("content_length"),
        F.transform("attached", lambda a: F.struct(F.col("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("attached"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("pieces"))
    learned = F.filter("pieces", lambda p: p["learned"])
    whole = whole.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(learned, lambda p: F.struct(p["content_start"].alias("start"), p["content_length"].alias("length"))).alias("loss"),
        F.flatten(F.transform("pieces", lambda p: p["attached"])).alias("attachments"),
    )
    return whole.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text, unescaped) and loss_text, taken from ``formatted`` and ``loss`` alone."""
    pieces = F.split("formatted", r"<\|end\|>\n")
    turns = F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"(?s)^<\|(.*?)\|>\n", 1)).alias("role"), unescape(F.regexp_replace(p, r"(?s)^<\|.*?\|>\n", "")).alias("text")
        ),
    )
    loss = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").cast("bigint").alias("formatted_chars"))
