"""A field snapshot: what a rater needs with them when there is no connection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rateline.functions.scoring import display_number, position_label
from rateline.sources.workspace import publish, read_published

SNAPSHOT = T.StructType(
    [
        T.StructField("player_id", T.LongType()),
        T.StructField("number", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("position", T.StringType()),
        T.StructField("coach_id", T.LongType()),
        T.StructField("skill_index", T.IntegerType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("session_id", T.LongType()),
    ]
)

#: Names a row; coach and skill are missing where a player has no score.
SNAPSHOT_KEY = ["session_id", "player_id", "coach_id", "skill_index"]


def field_snapshot(sessions: DataFrame, players: DataFrame, evaluations: DataFrame) -> DataFrame:
    """The roster of each active session with the scores given so far."""
    active = sessions.filter("active").select(F.col("id").alias("session_id"), "division_id")
    roster = players.join(active, "division_id").select(
        "session_id",
        F.col("id").alias("player_id"),
        display_number(F.col("id")).alias("number"),
        "name",
        position_label(F.col("is_pitcher"), F.col("is_catcher")).alias("position"),
    )
    scores = evaluations.join(active, "session_id", "left_semi").select(
        "session_id", "player_id", "coach_id", "skill_index", "score"
    )
    return roster.join(scores, ["session_id", "player_id"], "left").select(*SNAPSHOT.names)


def save_snapshot(snapshot: DataFrame, root: str, version: int) -> None:
    publish(snapshot, root, version, partition_by=("session_id",))


def load_snapshot(spark, root: str, version: int | None = None) -> DataFrame:
    return read_published(spark, root, SNAPSHOT, version)
