"""Player search over an index of three-character pieces of names and shown numbers.

A name has a piece at each of its characters, of three characters or what is left at its
end, so any text it contains starts a piece, however short. Postings are laid out by piece: a search
reads the files of one piece, the rarest of the query's, and holds the whole name against the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rateline.functions.scoring import display_number
from rateline.functions.text import name_key
from rateline.sources.workspace import current_version, publish, read_published

PIECE = 3

POSTINGS = T.StructType(
    [
        T.StructField("piece", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("division_id", T.LongType()),
    ]
)
COUNTS = T.StructType(
    [T.StructField("piece", T.StringType()), T.StructField("players", T.LongType())]
)


def _pieces(text: Column) -> Column:
    length = F.coalesce(F.length(text), F.lit(0))
    starts = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(PIECE)))


def postings(players: DataFrame) -> DataFrame:
    """piece, id, name, division_id: one row per player and different piece."""
    pieces = F.array_distinct(
        F.concat(_pieces(F.lower("name")), _pieces(display_number(F.col("id"))))
    )
    return players.select(F.explode(pieces).alias("piece"), "id", "name", "division_id")


def save_index(players: DataFrame, root: str, version: int) -> None:
    """Postings in ranges of piece and id, so that a common piece is written by many tasks,
    and the number of players a piece, in ranges of piece. Announced after both are written."""
    spark = players.sparkSession
    rows = postings(players).repartitionByRange("piece", "id").sortWithinPartitions("piece", "id")
    publish(rows, f"{root}/postings", version)
    written = read_published(spark, f"{root}/postings", POSTINGS, version)
    counts = written.groupBy("piece").agg(F.count(F.lit(1)).alias("players"))
    publish(
        counts.repartitionByRange("piece").sortWithinPartitions("piece"), f"{root}/counts", version
    )


def _rarest(spark: SparkSession, root: str, text: str, version: int) -> str | None:
    """The piece of the text that fewest players have; None if one of them occurs nowhere."""
    pieces = {text[i : i + PIECE] for i in range(len(text) - PIECE + 1)}
    counts = read_published(spark, f"{root}/counts", COUNTS, version)
    found = counts.filter(F.col("piece").isin(sorted(pieces))).collect()  # at most the query's length
    if len(found) < len(pieces):
        return None
    return min(found, key=lambda r: (r.players, r.piece)).piece


def matches(
    spark: SparkSession, root: str, query: str, division_id: int | None = None, version: int | None = None
) -> DataFrame:
    """id, number, name of every player whose name or shown number contains the query.

    A blank query matches nobody. Same answer as a scan of the players the index was made of.
    """
    text = query.strip().lower()
    if version is None:
        version = read_version(spark, root)
    rows = read_published(spark, f"{root}/postings", POSTINGS, version)
    if not text:
        rows = rows.filter(F.lit(False))
    elif len(text) < PIECE:
        rows = rows.filter(F.col("piece").startswith(text))
    else:
        piece = _rarest(spark, root, text, version)
        rows = rows.filter(F.lit(False) if piece is None else F.col("piece") == piece)
    if division_id:
        rows = rows.filter(F.col("division_id") == division_id)
    number = display_number(F.col("id"))
    holds = F.lower("name").contains(text) | number.contains(text)
    found = rows.filter(holds).select("id", number.alias("number"), "name")
    # A short text may start several pieces of one player.
    return found.distinct() if 0 < len(text) < PIECE else found


def read_version(spark: SparkSession, root: str) -> int:
    """The last version whose counts are announced, as they are written last."""
    version = current_version(spark, f"{root}/counts")
    if version is None:
        raise ValueError("no index is announced")
    return version


def search(
    spark: SparkSession,
    root: str,
    query: str,
    division_id: int | None = None,
    limit: int = 8,
    version: int | None = None,
) -> DataFrame:
    """The first few matches by name, as ``player_search`` gives them."""
    found = matches(spark, root, query, division_id, version)
    return found.orderBy(name_key(F.col("name")), "id").limit(limit)
