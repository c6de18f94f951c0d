"""Queued scores shown over the published ones, while both go on.

The queue is read as a stream and the evaluations are versions bucketed by key, which others publish
meanwhile. Each batch joins the version that is current then. What is kept is the scores still
pending, one a key: it grows with the queue and shrinks when a version holds what was queued.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rateline.operators.latest import pending_overlay
from rateline.operators.quality import valid_submissions
from rateline.schemas import EVALUATION_KEY, EVALUATIONS
from rateline.sources.keyed import read_keyed
from rateline.sources.workspace import announced, publish, read_published

PENDING = T.StructType(
    [
        *[f for f in EVALUATIONS.fields if f.name in (*EVALUATION_KEY, "score")],
        T.StructField("arrival_seq", T.LongType()),
    ]
)


def _still_pending(pending: DataFrame, stored: DataFrame) -> DataFrame:
    """The scores that arrived after the stored one of their key, or have none."""
    held = stored.select(*EVALUATION_KEY, F.col("arrival_seq").alias("_held"))
    later = F.col("_held").isNull() | (F.col("arrival_seq") > F.col("_held"))
    return held.join(pending, EVALUATION_KEY, "right").filter(later).select(*PENDING.names)


def _before(spark: SparkSession, state: str, batch_id: int | None) -> DataFrame:
    versions = announced(spark, state)
    if batch_id is not None:
        versions = versions.filter(F.col("version") < batch_id)
    last = versions.agg(F.max("version")).first()[0]
    if last is None:
        return spark.createDataFrame([], PENDING)
    return read_published(spark, state, PENDING, last)


def start_live_overlay(
    stream: DataFrame, stored: str, state: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Keep the pending scores of ``stream`` under ``state``; ``stored`` is the root of keyed versions.

    A batch that is run again starts from the state before it, so its rows count once.
    Invalid submissions are left out.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        queued = valid_submissions(batch).select(*PENDING.names)
        last = (
            _before(spark, state, batch_id)
            .union(queued)
            .groupBy(*EVALUATION_KEY)
            .agg(F.max_by("score", "arrival_seq").alias("score"), F.max("arrival_seq").alias("arrival_seq"))
        )
        publish(_still_pending(last, read_keyed(spark, stored)), state, batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()


def live_pending(spark: SparkSession, stored: str, state: str) -> DataFrame:
    """The scores still pending: those of the last batch that no version since holds."""
    return _still_pending(_before(spark, state, None), read_keyed(spark, stored))


def live_overlay(spark: SparkSession, stored: str, state: str) -> DataFrame:
    """The current version's scores with the pending ones on top, as ``pending_overlay`` of a batch."""
    return pending_overlay(read_keyed(spark, stored), live_pending(spark, stored, state))
