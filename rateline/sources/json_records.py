"""JSON records in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rateline.functions.text import is_scientific, leading_int, optional_int, reference_id, truthy
from rateline.schemas import IMPORT_JSON, SUBMISSION_JSON, UPDATE_JSON

_NUMBERS = ("session_id", "player_id", "skill_index", "score")


def read_submission_json(spark: SparkSession, path: str) -> DataFrame:
    """One submission a line; a malformed line becomes a row without values."""
    return spark.read.schema(SUBMISSION_JSON).option("mode", "PERMISSIVE").json(path)


#: Milliseconds from the epoch to the end of the year 9999.
_LAST_MILLI = 253402300799999


def coerce_submissions(
    raw: DataFrame, arrived_at: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Loosely typed fields to numbers; a missing skill index is -1, all else 0.

    ``created_at`` is ``arrived_at`` or else the queue time, which counts from the
    epoch whatever the session's time zone; one past the year 9999 is missing.
    Columns in ``keep`` go first as they are.
    """
    fallback = {"skill_index": -1}
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    millis = F.col("queued_at")
    queued_at = F.when(
        millis.between(-_LAST_MILLI, _LAST_MILLI), epoch + F.make_dt_interval(secs=millis / 1000)
    )

    def number(name: str) -> Column:
        default = F.lit(fallback.get(name, 0)).cast("bigint")
        return F.when(F.col(name).isNull(), default).otherwise(leading_int(F.col(name)))

    scientific = F.lit(False)
    for name in _NUMBERS:
        scientific = scientific | is_scientific(F.col(name))
    return raw.select(
        *keep,
        leading_int(F.col("id")).alias("arrival_seq"),
        *[number(name).alias(name) for name in _NUMBERS],
        leading_int(F.col("coach_id")).alias("coach_id"),
        queued_at.alias("queued_at"),
        (queued_at if arrived_at is None else arrived_at).alias("created_at"),
        F.col("_corrupt_record").isNotNull().alias("malformed"),
        scientific.alias("scientific"),
    )


def read_import_json(spark: SparkSession, path: str) -> DataFrame:
    """Import requests, one a line, as one row per player.

    A malformed or empty request yields no players.
    """
    requests = spark.read.schema(IMPORT_JSON).option("mode", "PERMISSIVE").json(path)
    return requests.select(
        F.explode("players").alias("player"), "default_division_id"
    ).select("player.*", "default_division_id")


def read_update_json(spark: SparkSession, path: str) -> DataFrame:
    """Player updates, one request or an array of them a line, with loosely typed fields coerced.

    A missing id is 0, an age that is missing or empty and division 0 are NULL, and a flag is set
    unless missing, empty, zero or false. A malformed line keeps its place as a row that
    ``update_fault`` refuses, and so does one with a number in scientific notation.
    """
    raw = spark.read.schema(UPDATE_JSON).option("mode", "PERMISSIVE").json(path)
    scientific = F.lit(False)
    for name in ("id", "age", "division_id"):
        scientific = scientific | is_scientific(F.col(name))
    return raw.select(
        "seq",
        F.coalesce(leading_int(F.col("id")), F.lit(0)).alias("id"),
        "name",
        optional_int(F.col("age")).alias("age"),
        truthy(F.col("is_pitcher")).alias("is_pitcher"),
        truthy(F.col("is_catcher")).alias("is_catcher"),
        reference_id(F.col("division_id")).alias("division_id"),
        F.col("_corrupt_record").isNotNull().alias("malformed"),
        scientific.alias("scientific"),
    )


def as_json(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row as one JSON object, fields in column order, NULLs written out."""
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(*keep, record.alias("record"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
