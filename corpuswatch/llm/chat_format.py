r"""Chat formatting in Spark expressions only: sorted turn structs, merged runs of one role, one concatenation.

The template::

    ### {role}: {text}</turn>          one block for each run of turns of one role
    ### {role}: {text}<part>{text}</turn>    texts that were merged, their border kept

Blocks follow each other without anything between. Inside roles and texts ``\`` is written ``\\``, ``##`` is ``\#\#``,
``</turn>`` is ``<\/turn>`` and ``<part>`` is ``<\part>``; in roles ``: `` is ``:\ ``. So the marks occur nowhere else, and reading back is
a split at the marks, then the removal of one backslash before each escaped character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks.
HEAD, SEP, END, PART = "### ", ": ", "</turn>", "<part>"


def escape(text: Column) -> Column:
    for found, written in (("\\", "\\\\"), ("##", "\\#\\#"), (END, "<\\/turn>"), (PART, "<\\part>")):
        text = F.replace(text, F.lit(found), F.lit(written))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(SEP), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(conversations: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows (conv_id, formatted, segments), one for each conversation of ``conversations`` (conv_id, turn, role, text).

    Turns go by number, ties by role and text; rows that repeat are turns of their own. Adjacent turns of one role share a block.
    ``formatted`` is the whole text; ``segments`` cuts it into array<struct<text, trained>>, where ``trained`` is the loss
    mask: it holds each text of a trained role and no mark. A null text is empty, a null role is the empty role, a null turn comes
    first, rows with a null conv_id are one conversation. Other columns are ignored; an empty table gives no rows. A
    conversation is one row of the result, so its turns meet in one task.
    """
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    last = F.size("turns") - 1
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"]))
    grouped = grouped.withColumn("starts", starts)
    # Each run of turns of one role becomes a struct of the role and its texts.
    runs = F.transform("starts", lambda a, k: F.struct(
        F.get("turns", a)["role"].alias("role"),
        F.transform(F.slice("turns", a + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - a), lambda t: t["text"]).alias("texts"),
    ))
    grouped = grouped.select("conv_id", runs.alias("runs"))

    def segment(text: Column, trained: Column) -> Column:
        return F.struct(text.alias("text"), trained.alias("trained"))

    def block(run: Column) -> Column:
        trained = run["role"].isin(*trained_roles)
        head = segment(F.concat(F.lit(HEAD), escape_role(run["role"]), F.lit(SEP)), F.lit(False))
        body = F.transform(run["texts"], lambda t, i: F.when(
            i == 0, F.array(segment(escape(t), trained))).otherwise(F.array(segment(F.lit(PART), F.lit(False)), segment(escape(t), trained))))
        return F.concat(F.array(head), F.flatten(body), F.array(segment(F.lit(END), F.lit(False))))

    cut = grouped.select("conv_id", F.flatten(F.transform("runs", block)).alias("segments"))
    return cut.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(text: str | Column) -> Column:
    """The turns that a formatted text was made of: array<struct<role, text>>."""
    column = F.col(text) if isinstance(text, str) else text
    blocks = F.split(column, END, -1)

    def turns(b: Column) -> Column:
        # The first ": " ends the role, since it is escaped inside roles.
        at = F.instr(b, SEP)
        role = unescape(F.substring(b, F.lit(len(HEAD) + 1), at - len(HEAD) - 1))
        texts = F.split(F.substring(b, at + len(SEP), F.length(b)), PART, -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def read_loss(segments: str) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["trained"]), lambda s: unescape(s["text"])), "")
