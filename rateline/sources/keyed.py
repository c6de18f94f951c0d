"""Evaluations laid out by their natural key, so that joins on it leave them where they are.

A version is a folder of files bucketed by the whole key: a popular session is spread over all
buckets. The number of buckets is part of the folder's name, and a reader declares the folder as a
table in its own session, so no shared catalog is needed.
"""

from __future__ import annotations

import re
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rateline.operators.latest import upsert_evaluations
from rateline.schemas import EVALUATION_KEY, EVALUATIONS
from rateline.sources.workspace import announce, new_attempt, published_folder

#: Evaluations as ``latest_evaluations(keep_order=True)`` gives them.
STORED = T.StructType(
    [
        *EVALUATIONS.fields,
        T.StructField("first_seq", T.LongType()),
        T.StructField("arrival_seq", T.LongType()),
    ]
)


def _declare(spark: SparkSession, folder: str, schema: T.StructType) -> str:
    """The name of the bucketed table over the folder; the same folder has the same name."""
    buckets = int(re.fullmatch(r".*-b(\d+)", folder).group(1))
    name = f"rateline_keyed_{md5(folder.encode()).hexdigest()}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    key = ", ".join(f"`{c}`" for c in EVALUATION_KEY)
    place = folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return name


def publish_keyed(
    evaluations: DataFrame, root: str, version: int, buckets: int, dealt: bool = False
) -> None:
    """Write a version in ``buckets`` files or more.

    ``dealt`` says that the rows come from a join with a keyed version of as many buckets, whose
    tasks hold one bucket each; others are shuffled first, so that a bucket is one file.
    """
    spark = evaluations.sparkSession
    attempt = f"{new_attempt()}-b{buckets}"
    folder = f"{root}/v={version}/{attempt}"
    rows = evaluations.select(*STORED.names)
    if not dealt:
        rows = rows.repartition(buckets, *EVALUATION_KEY)
    name = f"rateline_keyed_{md5(folder.encode()).hexdigest()}"
    (
        rows.write.format("parquet")
        .bucketBy(buckets, *EVALUATION_KEY)
        .sortBy(*EVALUATION_KEY)
        .option("path", folder)
        .saveAsTable(name)
    )
    announce(spark, root, version, attempt)


def read_keyed(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The version, the last one unless named; a join on the whole key does not shuffle it."""
    return spark.table(_declare(spark, published_folder(spark, root, version), STORED))


def buckets_of(spark: SparkSession, root: str, version: int | None = None) -> int:
    return int(published_folder(spark, root, version).rsplit("-b", 1)[1])


def upsert_keyed(submissions: DataFrame, root: str, version: int) -> None:
    """Publish ``version``: the version before it with further submissions.

    Only the submissions are shuffled. Saving a version again replaces it, so a repeated batch
    counts once.
    """
    spark = submissions.sparkSession
    stored = read_keyed(spark, root, version - 1)
    merged = upsert_evaluations(stored, submissions)
    publish_keyed(merged, root, version, buckets_of(spark, root, version - 1), dealt=True)


def forget_keyed(spark: SparkSession, folder: str) -> None:
    """Drop the session's declaration of a folder; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS rateline_keyed_{md5(folder.encode()).hexdigest()}")
