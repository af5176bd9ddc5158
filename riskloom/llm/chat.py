"""Chat formatting: typed parts flattened into one string per conversation, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

START, END = "<|im_start|>", "<|im_end|>\n"
KINDS = ("image", "audio", "document", "other")
PLACEHOLDER = "<\\|(?:" + "|".join(KINDS) + ")\\|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, FRAMES, PAGE = 28, 25, 256  # pixels a side per token, tokens per second, tokens per page


def escape(text: Column) -> Column:
    """One backslash more between every ``<`` and ``|`` that have only backslashes between them.

    No ``<|`` is left, so no control string can occur; ``unescape`` takes the backslash away.
    """
    return F.regexp_replace(text, "<(\\\\*)\\|", "<\\\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "<\\\\(\\\\*)\\|", "<$1|")


def _role_out(role: Column) -> Column:
    """A role stays on one line: percent signs and line ends are written as percent codes."""
    plain = F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return escape(plain)


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part; null as an empty text."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    )


def _kind(part: Column) -> Column:
    return F.when(part["kind"] == "text", "text").when(part["kind"].isin(*KINDS), part["kind"]).otherwise("other")


def _visit(part: Column) -> Column:
    """What a part becomes in the string: its escaped text, or the placeholder of its kind."""
    return F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|"), _kind(part), F.lit("|>"))
    )


def _tokens(part: Column) -> Column:
    """Model positions an attachment expands to; unknown sizes count 0."""
    patches = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    return F.coalesce(
        F.when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", F.ceil(part["seconds"] * FRAMES))
        .when(part["kind"] == "document", part["pages"].cast("long") * PAGE),
        F.lit(0),
    ).cast("long")


def format_conversations(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, parts)``; ``parts`` is an array of PART.

    Result: ``conv_id, formatted, loss (array of start and length, code points from 0), attachments
    (turn, kind, ref, tokens, in order of their placeholders), attachment_tokens``. Text parts are
    escaped, attachments become placeholders. The loss covers the body of every turn whose role is
    ``learn_from``. Null parts, texts and roles are empty, unknown kinds become ``<|other|>``. Turns
    are ordered by turn (null first), then role, then body, so ties and repeated rows have one
    order; a null conv_id is one conversation. A conversation is one string, hence one row.
    """
    attached = F.filter(F.col("parts"), lambda p: ~p["kind"].eqNullSafe("text"))
    body = F.array_join(F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), _visit), "")
    flat = turns.select("conv_id", "turn", _role_out(F.col("role")).alias("role"), body.alias("body"),
                        F.col("role").eqNullSafe(learn_from).alias("learnt"),
                        F.transform(attached, lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"),
                                                                 _tokens(p).alias("tokens"))).alias("attached"))
    head = F.concat(F.lit(START), F.col("role"), F.lit("\n"))
    ordered = W.partitionBy("conv_id").orderBy("turn", "role", "body")
    placed = flat.withColumn("piece", F.concat(head, "body", F.lit(END))).withColumn(
        "at", F.sum(F.length("piece").cast("long")).over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
        - F.length("piece")
    )
    listed = placed.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("at", "turn", "piece", "learnt", (F.col("at") + F.length(head)).alias("start"),
                         F.length("body").alias("length"), "attached")
            )
        ).alias("turns")
    )
    pieces = F.transform("turns", lambda t: t["piece"])
    loss = F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct(t["start"], t["length"]))
    attachments = F.flatten(
        F.transform("turns", lambda t: F.transform(
            F.coalesce(t["attached"], F.array().cast("array<struct<kind:string,ref:string,tokens:bigint>>")),
            lambda a: F.struct(t["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"),
                               a["tokens"].alias("tokens"))))
    )
    return listed.select("conv_id", F.array_join(pieces, "").alias("formatted"), loss.alias("loss"),
                         attachments.alias("attachments")).withColumn(
        "attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def _plain(body: Column) -> Column:
    """The text of a body: attachments' placeholders go, the text is unescaped."""
    return unescape(F.regexp_replace(body, PLACEHOLDER, ""))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learnt text out of the strings alone: ``conv_id, turns (role, text), learnt_text``."""
    pieces = F.split("formatted", F.regexp_replace(F.lit(START), "\\|", "\\\\|"), -1)
    turns = F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces)),
        lambda p: F.struct(
            _role_back(F.substring_index(p, "\n", 1)).alias("role"),
            _plain(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2,
                               F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END))).alias("text"),
        ),
    )
    learnt = F.transform(
        "loss", lambda s: _plain(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"]))
    )
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(learnt, "").alias("learnt_text"))


def digests(read: DataFrame) -> DataFrame:
    """Counts and sha-256 digests of what was read back."""
    line = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
