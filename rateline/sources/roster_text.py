"""Roster lines: ``name, age, position, division``, split on commas, no quoting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rateline.functions.text import trim_client
from rateline.sources.workspace import materialize

FIELDS = ("name", "age_text", "position_text", "division_text")


LINE_ORDER = ("file_path", "block_start", "line_in_block")


def read_roster_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Add the order of lines within a read block, and fix it.

    The number comes from the task that read the line, so it is only data once
    it has been written: a re-read under other settings could differ.
    """
    return materialize(lines.withColumn("line_in_block", F.monotonically_increasing_id()))


def parse_roster(lines: DataFrame, header: bool = False) -> DataFrame:
    """Non-blank lines as four trimmed fields; missing ones NULL, extra ones dropped.

    With ``header`` a line that spells the four field names is left out.
    """
    parts = F.split("line", ",")
    rows = lines.filter(F.length(trim_client(F.col("line"))) > 0).select(
        "*", *[trim_client(F.get(parts, F.lit(i))).alias(f) for i, f in enumerate(FIELDS)]
    )
    if header:
        spelled = F.concat_ws(",", *[F.lower(F.coalesce(f, F.lit(""))) for f in FIELDS])
        rows = rows.filter(spelled != "name,age,position,division")
    return rows
