"""The last score per key in the state store, released when its session ends.

State is kept per session and bucket of players, so that one session of any size is
spread over the buckets, and an end reaches all of a session's state as one row a bucket.
Within a bucket a map holds the last score of each player, coach and skill, packed in parts
(``packed.py``): two state calls for each score would take most of the time.

The state only tells what is news. What it lets through goes to a log that is folded by
arrival number, so releasing state never changes a result: a score that comes after its
session has ended, or after it has been idle, is let through again (``is_first`` says
that no state was behind it), and the log keeps whichever arrived last. Such a late score's state
goes when the session is ended once more, or when nothing came for the idle time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rateline.operators.quality import submission_faults
from rateline.schemas import EVALUATION_KEY
from rateline.streaming import packed
from rateline.streaming.runs import RunLog

BUCKETS = 16
IDLE_MS = 24 * 3600 * 1000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_OF_BUCKET = ["player_id", "coach_id", "skill_index"]
_SCORES = np.dtype([("player_id", "<i8"), ("coach_id", "<i8"), ("skill_index", "<i4"), ("score", "<i4"), ("arrival_seq", "<i8")])
_NEWS = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in EVALUATION_KEY[:3]],
        T.StructField("skill_index", T.IntegerType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("arrival_seq", T.LongType()),
        T.StructField("is_first", T.BooleanType()),
    ]
)


class LastScores(StatefulProcessor):
    """Per session and bucket: lets through a key's score if it arrived after the last one."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = packed.Parts(handle, _OF_BUCKET, scores=_SCORES)
        self.expiry = handle.getValueState("expiry", "at long")

    def _release(self) -> None:
        self.parts.clear()
        if self.expiry.exists():
            self.handle.deleteTimer(self.expiry.get()[0])
            self.expiry.clear()

    def _wait(self, now: int) -> None:
        """One timer, the idle time after the last score."""
        if self.expiry.exists():
            self.handle.deleteTimer(self.expiry.get()[0])
        self.handle.registerTimer(now + self.idle_ms)
        self.expiry.update((now + self.idle_ms,))

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        ended, came = False, False
        for frame in packed.chunks(rows):
            ended |= bool(frame["ended"].any())
            scores = frame[~frame["ended"]]
            last = scores.sort_values("arrival_seq").drop_duplicates(_OF_BUCKET, keep="last")
            came |= len(last) > 0
            if len(news := self._take(packed.records(last, _SCORES))):
                yield news.assign(session_id=int(key[0]))[_NEWS.names]
        # An end comes after the scores of its batch, in whatever order both arrived.
        if ended:
            self._release()
        elif came and self.idle_ms is not None:
            self._wait(timerValues.getCurrentProcessingTimeInMs())

    def _take(self, came: np.ndarray) -> pd.DataFrame:
        """Keep the scores that arrived after the known ones of their keys; those scores."""
        (known,) = self.parts.read(came)
        both = np.concatenate([known, came])
        is_news = np.arange(len(both)) >= len(known)
        # Of equal arrivals the known one stays.
        order = np.lexsort((~is_news, both["arrival_seq"], *(both[c] for c in _OF_BUCKET)))
        both, is_news = both[order], is_news[order]
        first = packed.begins(*(both[c] for c in _OF_BUCKET))
        last = packed.ends(first)
        is_first = (first & is_news)[last]  # the one row of its key
        both, is_news = both[last], is_news[last]
        if is_news.any():
            self.parts.write(both)
        return pd.DataFrame(both[is_news]).assign(is_first=is_first[is_news])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.parts.clear()
        self.expiry.clear()
        return iter(())


def _log(spark: SparkSession, root: str) -> RunLog:
    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*EVALUATION_KEY).agg(
            F.max_by("score", "arrival_seq").alias("score"),
            F.max("arrival_seq").alias("arrival_seq"),
            F.bool_and("is_first").alias("is_first"),
        )

    return RunLog(spark, root, _NEWS, fold)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started here keep their state in RocksDB; they keep the settings they started with."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def start_keyed_latest(
    stream: DataFrame,
    log: str,
    checkpoint: str,
    interval: str | None = None,
    ends: DataFrame | None = None,
    idle_ms: int = IDLE_MS,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the last score per key in the state store, and what changed in a log.

    ``ends`` is a stream of commands; an ``end`` with a session_id releases the state of that
    session. With an ``interval``, a session without scores for ``idle_ms`` is released too; a
    query without one ends when its input does, and so has no timers. A checkpoint
    belongs to one of both kinds. The query runs on the RocksDB state store.
    """
    bucket = F.pmod(F.xxhash64("player_id"), F.lit(buckets)).cast("int")
    kinds = {f.name: f.dataType for f in _NEWS.fields}
    columns = [*EVALUATION_KEY, "score", "arrival_seq"]
    rows = stream.filter(F.size(submission_faults(stream.columns)) == 0).select(
        *[F.col(c).cast(kinds[c]).alias(c) for c in columns], bucket.alias("bucket"), F.lit(False).alias("ended")
    )
    if ends is not None:
        of_bucket = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
        rows = rows.unionByName(
            ends.filter((F.col("command") == "end") & F.col("session_id").isNotNull()).select(
                "session_id",
                *[F.lit(0).cast(kinds[c]).alias(c) for c in columns[1:]],
                of_bucket.alias("bucket"),
                F.lit(True).alias("ended"),
            )
        )
    news = rows.groupBy("session_id", "bucket").transformWithStateInPandas(
        LastScores(idle_ms if interval else None), _NEWS, "Update", "ProcessingTime" if interval else "None"
    )
    kept = _log(stream.sparkSession, log)

    def write(batch: DataFrame, batch_id: int) -> None:
        if not kept.has(checkpoint, batch_id):
            kept.commit(checkpoint, batch_id, batch)

    writer = news.writeStream.outputMode("update").foreachBatch(write)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = writer.option("checkpointLocation", checkpoint).trigger(**trigger)
    with rocksdb(stream.sparkSession):
        return writer.start()


def keyed_latest(spark: SparkSession, log: str) -> DataFrame:
    """The last score per key, as the log has it."""
    return _log(spark, log).folded().select(*EVALUATION_KEY, "score")
