"""Conversation and action logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.clock import Clock
from meterwise.functions.ordering import numbered
from meterwise.functions.versioning import top_per_key
from meterwise.schemas import CONVERSATION, conform

TURNS_PER_BUCKET = 10_000


def assign_turns(conversation: DataFrame, new: DataFrame) -> DataFrame:
    """Number new rows on from each session's last turn, in the order of ``seq``; a new
    session starts at 0. Only the batch's sessions are read from the log. One batch has one writer, so numbers cannot collide."""
    known = conversation.join(new.select("session_id").distinct(), "session_id", "left_semi")
    last = known.groupBy("session_id").agg(F.max("turn").alias("_last"))
    placed = numbered(new, ["session_id"], ["seq"], F.floor(F.col("seq") / TURNS_PER_BUCKET), "_position")
    turn = F.coalesce("_last", F.lit(-1)) + 1 + F.col("_position")
    return (
        placed.join(last, "session_id", "left")
        .withColumn("turn", turn.cast("int"))
        .drop("_last", "_position", "seq")
    )


def conversation_rows(numbered_turns: DataFrame, clock: Clock) -> DataFrame:
    """Log rows from numbered turns. ``tool_args`` and ``tool_result`` may be structs,
    maps or arrays and are stored as JSON text; both and ``user_id`` are optional."""
    present = dict(numbered_turns.dtypes)

    def text(name: str):
        if name not in present:
            return F.lit(None).cast("string")
        return F.col(name) if present[name] == "string" else F.to_json(name)

    rows = numbered_turns.select(
        "session_id",
        "turn",
        "role",
        F.coalesce("content", F.lit("")).alias("content"),
        text("tool_name").alias("tool_name"),
        text("tool_args").alias("tool_args"),
        text("tool_result").alias("tool_result"),
        text("user_id").alias("user_id"),
        clock.now.alias("ts"),
    )
    return conform(rows, CONVERSATION)


def recent_turns(conversation: DataFrame, limit: int = 20, session_id: str | None = None) -> DataFrame:
    """The last ``limit`` turns of each session; of one session, oldest first."""
    if session_id is None:
        return top_per_key(conversation, ["session_id"], [F.desc("turn")], limit)
    one = conversation.where(F.col("session_id") == session_id)
    return one.orderBy(F.desc("turn")).limit(limit).orderBy("turn")


def recent_actions_filtered(
    log: DataFrame, target_id: str | None = None, skill_name: str | None = None, limit: int = 20
) -> DataFrame:
    if target_id is not None:
        log = log.where(F.col("target_id") == target_id)
    if skill_name is not None:
        log = log.where(F.col("skill_name") == skill_name)
    return log.orderBy(F.desc_nulls_last("action_timestamp"), "action_id").limit(limit)
