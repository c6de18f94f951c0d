"""Scans of the model tables, from Parquet or over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    schema: T.StructType,
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    **properties: str,
) -> DataFrame:
    """A partitioned read: the id range is split over ``partitions`` tasks.

    ``lower`` and ``upper`` only set the stride; rows outside are still read.
    """
    custom = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=partition_column,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(partitions),
            customSchema=custom,
            **properties,
        )
        .load()
    )


def write_evaluations(evaluations: DataFrame, path: str) -> None:
    """Lay evaluations out for session reads.

    Files hold ranges of session and player: one popular session is written by
    many tasks, and a session's read skips the files of all others.
    """
    (
        evaluations.repartitionByRange("session_id", "player_id")
        .sortWithinPartitions("session_id", "player_id", "coach_id", "skill_index")
        .write.mode("overwrite")
        .parquet(path)
    )
