"""Session history from the ordered command log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateline.operators.ordering import ordered_neighbours


def lifecycle(commands: DataFrame) -> DataFrame:
    """Starts and ends; a start without a division is refused and closes nothing."""
    placed = F.coalesce(F.col("division_id"), F.lit(0)) != 0
    command = F.col("command")
    return commands.filter((command == "end") | ((command == "start") & placed))


def session_history(commands: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row per start; the next start or end in its lane closes it.

    Deriving intervals from the log makes "close the open one, open the next"
    one step, which two statements without a transaction are not.
    """
    steps = lifecycle(commands).withColumn("at", F.struct("ts", "seq"))
    ordered = ordered_neighbours(
        steps, ["ts", "seq"], "at", ["lane"], previous=None, following="closed_at",
        buckets=buckets,
    )
    return ordered.filter(F.col("command") == "start").select(
        "lane",
        F.col("session_id").alias("id"),
        "division_id",
        F.col("ts").alias("started_at"),
        F.col("closed_at.ts").alias("ended_at"),
        F.col("closed_at").isNull().alias("active"),
        "at",
        "closed_at",
    )


def session_cursors(history: DataFrame, commands: DataFrame) -> DataFrame:
    """Sessions with their skill index: the advances that came while active.

    The index has no upper bound, and the player index returns to 0 each time.
    """
    advances = commands.filter(F.col("command") == "advance").select(
        F.col("lane").alias("_lane"),
        F.col("session_id").alias("_session"),
        F.struct("ts", "seq").alias("_at"),
    )
    effective = (
        history.join(
            advances,
            (F.col("lane") == F.col("_lane"))
            & (F.col("id") == F.col("_session"))
            & (F.col("_at") > F.col("at"))
            & (F.col("closed_at").isNull() | (F.col("_at") < F.col("closed_at"))),
        )
        .groupBy("lane", "id")
        .agg(F.count(F.lit(1)).cast("int").alias("_advances"))
    )
    return history.join(effective, ["lane", "id"], "left").select(
        "lane",
        "id",
        "division_id",
        F.coalesce("_advances", F.lit(0)).alias("current_skill_index"),
        F.lit(0).alias("current_player_index"),
        "active",
        "started_at",
        "ended_at",
    )


def close_active(sessions: DataFrame, as_of) -> DataFrame:
    """End every active session at ``as_of`` (a timestamp column or value)."""
    moment = F.lit(as_of).cast("timestamp_ntz")
    return sessions.withColumn(
        "ended_at", F.when(F.col("active"), moment).otherwise(F.col("ended_at"))
    ).withColumn("active", F.lit(False))


def active_session(sessions: DataFrame, divisions: DataFrame) -> DataFrame:
    """The latest active session, with its division's name."""
    named = divisions.select(F.col("id").alias("division_id"), F.col("name").alias("division_name"))
    return (
        sessions.filter("active")
        .join(named, "division_id")
        .orderBy(F.desc("id"))
        .limit(1)
        .select(
            "id",
            "division_id",
            "division_name",
            "current_skill_index",
            "current_player_index",
            "started_at",
        )
    )
