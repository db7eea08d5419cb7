"""Chat formatting over typed content parts (operator 9), in DataFrame functions only.

A turn is a list of parts: ``struct<kind, text, ref, size>`` with kind text, image, audio or
document.  A visitor (one expression per kind) flattens the parts of a turn in order: a text part
becomes its escaped text; an attachment becomes one placeholder per expanded token run,
``<|kind:number|>``, where number counts the attachments of the conversation; its reference and
its expanded token count are recorded.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Escaping: ``\\`` becomes ``\\\\``
and ``<|`` becomes ``<\\|``, so no control string can stand inside a text, and removing one
backslash of each pair gives the text back.  A role also has its line breaks written ``\\n``.
The loss mask is a list of (start, length) spans over the code points of the formatted text:
each assistant turn's content.

Edge cases: a null text, role or part list is empty; a null turn sorts first; equal turns of a
conversation are ordered by role, then text; null conv_ids form one conversation; a conversation
without assistant has an empty mask; an unknown kind is treated as a document; other columns are
never read.  One conversation is one value and so one row; all else is split by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
#: Tokens that a part of ``size`` units takes once expanded: (units per token, least).
EXPANSION = {"image": (196, 1), "audio": (320, 1), "document": (4, 1)}
PART = "struct<kind:string,text:string,ref:string,size:bigint>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    """The pair backslash-n is a line break; a doubled backslash is looked at first."""
    mark = F.lit("\x00b")
    safe = F.replace(F.replace(role, F.lit("\x00"), F.lit("\x00z")), F.lit("\\\\"), mark)
    plain = F.replace(F.replace(safe, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    return F.replace(F.replace(plain, mark, F.lit("\\")), F.lit("\x00z"), F.lit("\x00"))


def text_part(text: Column) -> Column:
    """The part list of a turn that is plain text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("bigint").alias("size")).cast(PART))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def expanded(part: Column) -> Column:
    """Tokens that an attachment is expanded to; 0 for text."""
    size = F.coalesce(part["size"], F.lit(0))
    cost = lambda kind: F.greatest(F.ceil(size / EXPANSION[kind][0]), F.lit(EXPANSION[kind][1])).cast("long")
    return F.when(_is_text(part), F.lit(0).cast("long")).when(part["kind"] == "image", cost("image")) \
        .when(part["kind"] == "audio", cost("audio")).otherwise(cost("document"))


def _placeholder(part: Column, number: Column) -> Column:
    kind = F.when(part["kind"].isin("image", "audio"), part["kind"]).otherwise(F.lit("document"))
    return F.concat(F.lit("<|"), kind, F.lit(":"), number.cast("string"), F.lit("|>"))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its ordered ``turns`` (role, parts); turns has conv_id, turn, role, parts."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")).alias("parts"))
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def formatted(convs: DataFrame) -> DataFrame:
    """conv_id, formatted, mask (start and length of each assistant content, in code points),
    attachments (number, kind, ref, tokens)."""
    files = F.filter(F.flatten(F.transform("turns", lambda t: t["parts"])), lambda p: ~_is_text(p))
    # How many attachments stand before each turn.
    before = F.transform("turns", lambda t: F.size(F.filter(t["parts"], lambda p: ~_is_text(p))))
    before = F.transform(before, lambda n, i: F.aggregate(F.slice(before, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    plain = F.size(files) == 0

    def visit(parts: Column, base: Column) -> Column:
        own = F.filter(parts, lambda p: ~_is_text(p))
        number = lambda i: F.size(F.filter(F.slice(parts, F.lit(1), i), lambda p: ~_is_text(p))) + base
        mixed = F.array_join(F.transform(parts, lambda p, i: F.when(_is_text(p), escaped(F.coalesce(p["text"], F.lit(""))))
                                         .otherwise(_placeholder(p, number(i)))), "")
        only = F.array_join(F.transform(parts, lambda p: escaped(F.coalesce(p["text"], F.lit("")))), "")
        return F.when(F.size(own) == 0, only).otherwise(mixed)

    body = convs.select(
        "conv_id",
        F.when(plain, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.array_join(
            F.transform(t["parts"], lambda p: escaped(F.coalesce(p["text"], F.lit("")))), "").alias("content"))))
        .otherwise(F.transform(F.arrays_zip(F.col("turns").alias("t"), before.alias("b")), lambda z: F.struct(
            z["t"]["role"].alias("role"), visit(z["t"]["parts"], z["b"]).alias("content")))).alias("body"),
        F.transform(files, lambda p, i: F.struct(
            i.cast("long").alias("number"), F.when(p["kind"].isin("image", "audio"), p["kind"]).otherwise(F.lit("document")).alias("kind"),
            p["ref"].alias("ref"), expanded(p).alias("tokens"))).alias("attachments"))
    head = lambda t: F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"))
    tail = f"{STOP}\n"
    spans = F.aggregate(
        F.transform("body", lambda t: F.struct((t["role"] == "assistant").alias("learn"), F.length(head(t)).cast("long").alias("before"),
                                               F.length(t["content"]).cast("long").alias("n"))),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + t["before"] + t["n"] + len(tail)).alias("at"),
            F.when(t["learn"], F.concat(a["spans"], F.array(F.struct((a["at"] + t["before"]).alias("start"), t["n"].alias("length")))))
            .otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    return body.select("conv_id", F.array_join(F.transform("body", lambda t: F.concat(head(t), t["content"], F.lit(tail))), "").alias("formatted"),
                       spans.alias("mask"), "attachments")


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role and text) and ``learned`` (the unescaped texts under the mask), from the
    formatted text and its mask alone."""
    segments = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.lit(2_000_000_000))
    role = lambda s: F.substring_index(s, "\n", 1)
    end = len(STOP) + 1
    text = lambda s: F.substring(s, F.length(role(s)) + 2, F.length(s) - F.length(role(s)) - 1 - end)
    return chats.select(
        "conv_id", "formatted", "mask", "attachments",
        F.transform(segments, lambda s: F.struct(unescaped_role(role(s)).alias("role"), unescaped(text(s)).alias("text"))).alias("turns"),
        F.transform("mask", lambda m: unescaped(F.substring("formatted", (m["start"] + 1).cast("int"), m["length"].cast("int")))).alias("learned"))


def digests(back: DataFrame) -> DataFrame:
    """The digest columns of the query, from what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(F.encode(learned, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
