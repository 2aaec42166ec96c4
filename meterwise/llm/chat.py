"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" text "<|im_end|>\\n"

A conversation is first rendered as it is and parsed back. If the turns differ, its
texts conflict with the grammar, and it is rendered with them escaped: each "<", any
number of "\\", "|" gets one more "\\", so that no text has "<|". The parser always takes
one off. Roles are URL-encoded (plain words stay as they are).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def rendered(turns: Column, text: callable) -> Column:
    one = F.transform(
        turns,
        lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"), text(t["text"]), F.lit(f"{END}\n")),
    )
    return F.array_join(one, "")


def parsed(formatted: Column) -> Column:
    """The turns of a rendered conversation. Deterministic and total: each start begins a
    turn; its role ends at the first line break, its text at the first end after it."""
    segments = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda s: s != "")

    def turn(s: Column) -> Column:
        role = F.substring_index(s, "\n", 1)
        return F.struct(
            F.coalesce(F.try_url_decode(role), role).alias("role"),
            unescaped(F.substring_index(F.substring(s, F.length(role) + 2, F.length(s)), END, 1)).alias("text"),
        )

    return F.transform(segments, turn)


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``):
    ``formatted``, ``escaped_content`` (whether escaping was needed), ``round_trip`` (whether the
    parsed turns equal the source's).

    Turns are ordered by ``turn`` (null first), then role and text; repeated rows are
    turns of their own. Null role and text are empty. Rows with null ``conv_id`` are one conversation.
    An empty table gives no rows. Further columns are left out. The turns of one
    conversation meet in one row, since its text is one value; a conversation is the unit
    of the output.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    source = grouped.select("conv_id", F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = source.withColumn("plain", rendered(F.col("turns"), lambda t: t))
    tried = plain.withColumn("conflict", parsed(F.col("plain")) != F.col("turns"))
    final = tried.withColumn("formatted", F.when(F.col("conflict"), rendered(F.col("turns"), escaped)).otherwise(F.col("plain")))
    return final.select(
        "conv_id",
        "formatted",
        F.col("conflict").alias("escaped_content"),
        (parsed(F.col("formatted")) == F.col("turns")).alias("round_trip"),
    )


def loss_texts(turns: Column, role: str = "assistant") -> Column:
    """The texts under the loss mask: those of the assistant's turns, in order."""
    return F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"])


def loss_segments(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """The loss mask as spans of ``formatted`` (code points, end exclusive): ``conv_id``,
    ``start``, ``end`` per masked turn. A running sum over the turns of a conversation."""
    from pyspark.sql import Window

    segments = formatted.select("conv_id", F.posexplode(F.split("formatted", r"(?<=<\|im_end\|>\n)")).alias("at", "segment"))
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    header = F.length(F.substring_index("segment", "\n", 1)) + 1
    begin = F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0))
    placed = segments.withColumn("start", begin + header).withColumn("end", begin + F.length("segment") - len(END) - 1)
    masked = F.substring_index("segment", "\n", 1) == F.concat(F.lit(START), F.url_encode(F.lit(role)))
    return placed.where(masked).select("conv_id", "start", "end")
