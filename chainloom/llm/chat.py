"""Chat formatting with typed content parts, in DataFrame functions only.

A message is a list of parts: text, image, audio or document. A visitor turns each part into template text: text is
escaped, and any other kind becomes an ordered placeholder such as <|image:2|>, whose attachment reference and expanded token
count are recorded. The output keeps the loss mask as spans of code points of the assistant's texts.

Control strings all begin with "<" or "["; a backslash behind these (and behind itself) in texts makes sure that no text holds
one, and takes nothing away: unescape() gives the text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, HEAD, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
TRAINED = "assistant"
KINDS = ("image", "audio", "document")
#: Tokens that a placeholder stands for: per 28 x 28 tile, per second and per page.
TILE, PER_SECOND, PER_PAGE, CHARS_PER_TOKEN = 28, 25, 256, 4
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("[\\"), F.lit("[")), F.lit("<\\"), F.lit("<")), F.lit("\\\\"), F.lit("\\"))


def part_tokens(p: Column) -> Column:
    """Expanded token count of a part; sizes that are null or below 1 count as one unit."""
    least = lambda x: F.greatest(F.coalesce(x, F.lit(1)), F.lit(1))
    image = F.ceil(least(p["width"]) / TILE) * F.ceil(least(p["height"]) / TILE)
    audio = F.ceil(F.greatest(F.coalesce(p["seconds"], F.lit(0.0)), F.lit(1.0 / PER_SECOND)) * PER_SECOND)
    text = F.ceil(F.length(F.coalesce(p["text"], F.lit(""))) / CHARS_PER_TOKEN)
    return F.when(p["type"] == "image", image).when(p["type"] == "audio", audio).when(p["type"] == "document", least(p["pages"]) * PER_PAGE).otherwise(text).cast("long")


def visit(parts: Column) -> Column:
    """(body, attachments, tokens) of a message: the parts in order, placeholders numbered by kind within the message.

    A null list is an empty message. A part of unknown or null type is read as text; null texts are empty.
    """
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    known = lambda p: F.coalesce(p["type"].isin(*KINDS), F.lit(False))

    def of_kind(kind: str | None) -> Column:
        """Places of one kind in order, each with its number."""
        mine = F.filter(F.transform(parts, lambda p, i: F.when(~known(p) if kind is None else F.coalesce(p["type"] == kind, F.lit(False)), i)), lambda i: i.isNotNull())
        return F.transform(mine, lambda i, n: F.struct(i.alias("at"), (n + 1).alias("number")))

    numbered = F.sort_array(F.concat(*[of_kind(k) for k in (*KINDS, None)]))  # all places again, each once

    def body(s: Column) -> Column:
        p = F.get(parts, s["at"])
        return F.when(known(p), F.concat(F.lit("<|"), p["type"], F.lit(":"), s["number"].cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))

    def attachment(s: Column) -> Column:
        p = F.get(parts, s["at"])
        return F.struct(s["at"].alias("part"), p["type"].alias("type"), s["number"].alias("number"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))

    return F.struct(
        F.array_join(F.transform(numbered, body), "").alias("body"),
        F.transform(F.filter(numbered, lambda s: known(F.get(parts, s["at"]))), attachment).alias("attachments"),
        F.aggregate(F.transform(parts, part_tokens), F.lit(0).cast("long"), lambda a, n: a + n).alias("tokens"),
    )


def text_part(text: Column) -> Column:
    """One text part, as a list."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])).cast(f"array<{PART}>")


def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """(conv_id, formatted, turns, loss array<struct<turn, start, length>>, attachments, n_tokens): one row per conversation.

    Messages go by turn; ties by role and content, null turns first. start and length of the loss mask are code points of
    `formatted`, start from 0; turn is the place of the message. Null roles are empty roles. Rows with a null conversation id form
    one conversation. Repeated rows are messages of their own. An empty table gives no rows. A conversation is one string, so it is
    gathered in one row, however long: that is its output.
    """
    m = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), visit(F.col(parts_col)).alias("v"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD))
    m = m.select("conv_id", "turn", "role", F.col("v.attachments").alias("attachments"), F.col("v.tokens").alias("tokens"), F.length(head).alias("lead"), F.length("v.body").alias("n"), F.concat(head, F.col("v.body"), F.lit(CLOSE)).alias("block"))
    order = ["turn", "role", "block"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)) - 1).withColumn("end", F.sum(F.length("block").cast("long")).over(before))
    g = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "block", "role", "end", "lead", "n", "attachments", "tokens"))).alias("t"))
    loss = F.transform(F.filter("t", lambda x: x["role"] == TRAINED), lambda x: F.struct(x["at"].alias("turn"), (x["end"] - len(CLOSE) - x["n"]).alias("start"), x["n"].cast("long").alias("length")))
    return g.select(
        "conv_id", F.array_join("t.block", "").alias("formatted"), F.size("t").cast("long").alias("n_turns"), loss.alias("loss"),
        F.flatten(F.transform("t", lambda x: F.transform(x["attachments"], lambda a: F.struct(x["at"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["number"].alias("number"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("t.tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"),
    )


def parse_chat(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; placeholders stay as they are in the text."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(unescape(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), HEAD, 1)).alias("role"), unescape(F.substring_index(b, HEAD, -1)).alias("text")))


def digest(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, n_tokens), read back from `formatted` and the loss mask.

    The text under the mask is cut out of `formatted` by the start and length of each span, unescaped, and joined. Null masks cover nothing.
    """
    turns = F.concat(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"])), "\n"), F.when(F.size("_turns") > 0, F.lit("\n")).otherwise(F.lit("")))
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    read = chats.select("conv_id", "formatted", "attachments", "n_tokens", parse_chat(F.col("formatted")).alias("_turns"), F.coalesce(masked, F.lit("")).alias("_masked"))
    return read.select(
        F.col("conv_id"), F.size("_turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("_masked").cast("long").alias("loss_chars"), F.sha2(F.col("_masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "n_tokens",
    )
