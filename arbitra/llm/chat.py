"""Chat formatting of typed content parts, with DataFrame functions only.

A turn's content is a list of parts (text, image, audio, document). They are visited in order and flattened into
text with placeholders; each attachment's reference is recorded, with the number of tokens its
placeholder stands for. The template marks turns by control strings, all of which begin with "<". In texts
and roles the backslash and "<" are replaced by two-character escapes, so no text can hold a control
string, and the escapes are undone one after the other without looking at what stands around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("units", T.LongType())])
PARTS = T.ArrayType(PART)

TURN, TURN_END, CLOSE = "<turn ", ">\n", "</turn>\n"
#: Tokens that one unit of an attachment stands for: an image tile, a second of audio, a page.
TOKENS = {"image": 256, "audio": 25, "document": 600}
LOSS_ROLE = "assistant"
#: Turns of a conversation that are first brought together, by turn number; a long conversation never meets in one task turn by turn.
SPAN = 32


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """The inverse: an escaped backslash is always followed by s, so "\\l" can only be an escaped "<"."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """Roles stand in a line of their own that ends in ">"."""
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\g"), F.lit(">")))


def text_parts(text: Column) -> Column:
    """A plain text as its only part; null as empty text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units")))


def visit(parts: Column) -> dict[str, Column]:
    """content (escaped text with placeholders), attachments (type, ref, tokens in order), tokens (their sum).

    A part of another type, or null, adds nothing. Null units count as one; null parts as none.
    """
    parts = F.coalesce(parts, F.array().cast(PARTS))

    def content(part: Column) -> Column:
        kind = part["type"]
        marker = F.concat(F.lit("<"), kind, F.lit("/>"))
        return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).when(kind.isin(*TOKENS), marker).otherwise("")

    def tokens(part: Column) -> Column:
        units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0))
        each = F.lit(0).cast("long")
        for kind, n in TOKENS.items():
            each = F.when(part["type"] == kind, units * n).otherwise(each)
        return each

    kept = F.filter(parts, lambda p: F.coalesce(p["type"].isin(*TOKENS), F.lit(False)))
    attachments = F.transform(kept, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    return {
        "content": F.array_join(F.transform(parts, content), ""),
        "attachments": attachments,
        "tokens": F.aggregate(kept, F.lit(0).cast("long"), lambda total, p: total + tokens(p)),
    }


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, attachments, attachment_tokens from ``turns(conv_id, turn, role, parts)``.

    Turns stand by turn number; equal numbers by role, then content; null numbers first. Null role is the empty role.
    Repeated rows are turns of their own. Rows with null conv_id are one conversation. No rows: no rows.
    Other columns are ignored. Turns meet first in spans of SPAN turn numbers, then the spans by conversation.
    """
    seen = visit(F.col("parts"))
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        *(c.alias(name) for name, c in seen.items()),
    )
    line = F.struct("turn", "role", "content", "attachments", "tokens")
    spans = rows.groupBy("conv_id", F.floor(F.col("turn") / SPAN).alias("span")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    one = spans.select(
        "conv_id",
        F.struct(
            F.col("span"),
            F.array_join(F.transform("lines", lambda x: F.concat(F.lit(TURN), escape_role(x["role"]), F.lit(TURN_END), x["content"], F.lit(CLOSE))), "").alias("text"),
            F.flatten(F.transform("lines", lambda x: x["attachments"])).alias("attachments"),
        ).alias("part"),
        F.size("lines").cast("long").alias("n"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda total, x: total + x["tokens"]).alias("tokens"),
    )
    whole = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("tokens").alias("attachment_tokens"))
    return whole.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"),
        F.flatten(F.transform("parts", lambda p: p["attachments"])).alias("attachments"),
        "attachment_tokens",
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped. Placeholders stay in the text."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    return F.transform(
        blocks,
        lambda b: F.struct(
            unescape_role(F.substring_index(F.substr(b, F.lit(len(TURN) + 1)), TURN_END, 1)).alias("role"),
            unescape(F.substr(b, F.length(F.substring_index(b, TURN_END, 1)) + (len(TURN_END) + 1))).alias("text"),
        ),
    )


def loss_spans(formatted: Column, role: str = LOSS_ROLE) -> Column:
    """Code-point spans (start, end) of the formatted text that the loss counts: what ``role`` says, without markers."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    sized = F.transform(
        blocks,
        lambda b: F.struct(
            (unescape_role(F.substring_index(F.substr(b, F.lit(len(TURN) + 1)), TURN_END, 1)) == role).alias("counts"),
            F.length(F.substring_index(b, TURN_END, 1)).cast("long").alias("head"),
            F.length(b).cast("long").alias("length"),
        ),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, b: Column) -> Column:
        begin = state["at"] + b["head"] + len(TURN_END)
        end = state["at"] + b["length"]
        found = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE)).alias("at"), F.when(b["counts"], F.concat(state["spans"], found)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(sized, start, step, lambda state: state["spans"])


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from ``formatted``."""
    back = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_spans(F.col("formatted")).alias("spans"))
    masked = F.array_join(F.transform("spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return back.withColumn("loss", masked).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
