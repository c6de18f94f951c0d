"""Session history kept live: a state machine per lane and span of time.

Commands may come in any order and more than once. A machine holds the starts and ends
of one lane within one span (a day unless told otherwise); a command that comes early
waits there for its turn, and one that comes late is put in its place. Only steps whose successor
changed go to the log, so a step is written again when something came between it and the next.
A lane with many commands is spread over its spans, and a machine reads no more than its own span.
The machines of a bucket of lanes share a group of the state store and lie there in packed parts
(``packed.py``): a group and some state calls for each machine cost far more than its few steps.

The last step of a span is closed by the first step of the lane's next span, which is looked up
among one row per lane and span when the history is read. A machine that nothing reached for
the idle time is released whole (an eighth of that time later, at most). Should a command come after that, the next machine of the
span carries another epoch; spans of several epochs are put in order when they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rateline.operators.sessions import lifecycle
from rateline.streaming import packed
from rateline.streaming.keyed_state import rocksdb
from rateline.streaming.runs import RunLog

SPAN_US = 24 * 3600 * 1_000_000
IDLE_MS = 7 * 24 * 3600 * 1000

BUCKETS = 16
#: How often in an idle time a bucket is looked through for lanes to release, at most.
LOOKS = 8

_STEP = ["at", "seq", "command", "session_id", "division_id"]


def _fields(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType() if n == "command" else T.LongType()) for n in names])


_LOGGED = _fields(["lane", "span", *_STEP, "next_at", "next_seq", "epoch", "revision"])

# Inside the machines all is whole numbers; bits of ``kind`` say which of them stand for a value.
IS_START, HAS_SESSION, HAS_DIVISION, HAS_NEXT = 1, 2, 4, 8
_NUMBERS = ["lane", "at", "seq", "kind", "session_id", "division_id"]
_STEPS = np.dtype([(n, "<i8") for n in (*_NUMBERS, "next_at", "next_seq")])
_LANES = np.dtype([(n, "<i8") for n in ("lane", "epoch", "revision", "expiry")])
_OUT = np.dtype([(n, "<i8") for n in (*_STEPS.names, "epoch", "revision")])
_NEWS = _fields(["span", *_OUT.names])


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _numbered(steps: DataFrame) -> DataFrame:
    """Without strings and nulls, of which pandas would make floats."""
    flags = {IS_START: F.col("command") == "start", HAS_SESSION: F.col("session_id").isNotNull(), HAS_DIVISION: F.col("division_id").isNotNull()}
    kind = reduce(Column.__add__, [F.when(held, bit).otherwise(0) for bit, held in flags.items()])
    whole = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("session_id", "division_id")]
    return steps.select("bucket", "span", "lane", "at", "seq", kind.cast("long").alias("kind"), *whole)


def _logged(news: DataFrame) -> DataFrame:
    """The steps as the log has them."""
    bits = {"session_id": HAS_SESSION, "division_id": HAS_DIVISION, "next_at": HAS_NEXT, "next_seq": HAS_NEXT}
    columns = {c: F.when(F.col("kind").bitwiseAND(bit) > 0, F.col(c)).alias(c) for c, bit in bits.items()}
    starts = F.col("kind").bitwiseAND(IS_START) > 0
    columns["command"] = F.when(starts, "start").otherwise("end").alias("command")
    return news.select(*[columns.get(c, F.col(c)) for c in _LOGGED.names])


class LaneMachines(StatefulProcessor):
    """Per bucket of lanes and span: the steps of each lane as they were last logged, and what changed of them."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = packed.Parts(handle, ["lane"], steps=_STEPS, lanes=_LANES)
        self.expiry = handle.getValueState("expiry", "at long")

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms is not None else 0
        for frame in packed.chunks(rows):
            news = self._take(packed.records(frame, _STEPS), now)
            if len(news):
                yield pd.DataFrame(news).assign(span=int(key[1]))[_NEWS.names]
        # The timer that waits is never later than the first lane's turn, which only moves on.
        if self.idle_ms is not None and not self.expiry.exists():
            self._wait(now + self.idle_ms)

    def _take(self, came: np.ndarray, now: int) -> np.ndarray:
        """Put the steps that came in their places; the steps to log."""
        steps, lanes = self.parts.read(came)
        both = np.concatenate([steps, came])
        # Stable: what is known before what came, and that in the order it came.
        order = np.lexsort((both["seq"], both["at"], both["lane"]))
        both = both[order]
        first = packed.begins(both["lane"], both["at"], both["seq"])
        after = both[packed.ends(first)]
        same = after["lane"][:-1] == after["lane"][1:]
        after["kind"] &= ~HAS_NEXT
        after["kind"][:-1] |= np.where(same, HAS_NEXT, 0)
        for name in ("at", "seq"):
            after[f"next_{name}"] = 0
            after[f"next_{name}"][:-1] = np.where(same, after[name][1:], 0)
        news = after[(order[first] >= len(steps)) | (both[first] != after)]

        marks = np.zeros(len(reached := np.unique(came["lane"])), _LANES)
        marks["lane"], marks["epoch"] = reached, now
        known = lanes[np.isin(lanes["lane"], reached)]
        marks[np.searchsorted(reached, known["lane"])] = known
        marks["revision"] += 1
        marks["expiry"] = now + (self.idle_ms or 0)
        self.parts.write(after, np.concatenate([lanes[~np.isin(lanes["lane"], reached)], marks]))

        out = np.zeros(len(news), _OUT)
        for name in _STEPS.names:
            out[name] = news[name]
        mark = marks[np.searchsorted(reached, news["lane"])]
        out["epoch"], out["revision"] = mark["epoch"], mark["revision"]
        return out

    def _wait(self, until: int) -> None:
        self.handle.registerTimer(until)
        self.expiry.update((until,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Release the lanes whose time has come, and wait for the next; a bucket is looked through few times an idle time."""
        now = timerValues.getCurrentProcessingTimeInMs()

        def waiting(steps: np.ndarray, lanes: np.ndarray) -> list[np.ndarray]:
            left = lanes[lanes["expiry"] > now]
            return [steps[np.isin(steps["lane"], left["lane"])], left]

        turns = [int(lanes["expiry"].min()) for _, lanes in self.parts.sift(waiting)]
        if turns:
            self._wait(max(min(turns), now + self.idle_ms // LOOKS))
        else:
            self.expiry.clear()
        return iter(())


def _log(spark: SparkSession, root: str) -> RunLog:
    def fold(rows: DataFrame) -> DataFrame:
        others = [c for c in _LOGGED.names if c not in ("lane", "at", "seq")]
        last = F.max_by(F.struct(*others), F.struct("epoch", "revision")).alias("last")
        return rows.groupBy("lane", "at", "seq").agg(last).select("lane", "at", "seq", "last.*")

    return RunLog(spark, root, _LOGGED, fold)


def start_lanes(
    commands: DataFrame,
    log: str,
    checkpoint: str,
    interval: str | None = None,
    idle_ms: int = IDLE_MS,
    span_us: int = SPAN_US,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the steps of all lanes in order in ``log``.

    A command without lane, time or number has no turn and is left out. Of two deliveries of one
    (lane, ts, seq) the later counts. With an ``interval``, machines are released after ``idle_ms``;
    a query without one ends when its input does, and so has no timers. A log belongs to one
    ``span_us``, a checkpoint to one kind of query and number of ``buckets``.
    """
    at = F.timestamp_diff("MICROSECOND", _epoch(), F.col("ts"))
    steps = (
        lifecycle(commands)
        .filter("lane is not null and ts is not null and seq is not null")
        .withColumn("at", at)
        .select("lane", F.floor(F.col("at") / F.lit(span_us)).cast("long").alias("span"), *_STEP)
    )
    changes = (
        _numbered(steps.withColumn("bucket", F.pmod(F.xxhash64("lane"), F.lit(buckets)).cast("int")))
        .groupBy("bucket", "span")
        .transformWithStateInPandas(
            LaneMachines(idle_ms if interval else None), _NEWS, "Update", "ProcessingTime" if interval else "None"
        )
    )
    kept = _log(commands.sparkSession, log)

    def write(batch: DataFrame, batch_id: int) -> None:
        if not kept.has(checkpoint, batch_id):
            kept.commit(checkpoint, batch_id, batch)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = _logged(changes).writeStream.outputMode("update").foreachBatch(write)
    with rocksdb(commands.sparkSession):
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def live_history(spark: SparkSession, log: str) -> DataFrame:
    """One row per start, closed by the lane's next start or end, as ``session_history`` has it."""
    steps = _log(spark, log).folded()
    of_span = ["lane", "span"]
    place = F.struct("at", "seq")
    following = F.when(F.col("next_at").isNotNull(), F.struct(F.col("next_at").alias("at"), F.col("next_seq").alias("seq")))
    edges = steps.groupBy(*of_span).agg(
        F.min(place).alias("first"),
        F.max(place).alias("last"),
        (F.min("epoch") != F.max("epoch")).alias("mixed"),
    )
    after = F.lead("first").over(Window.partitionBy("lane").orderBy("span"))
    joined = steps.join(edges.withColumn("after", after), of_span)
    in_order = F.lead(place).over(Window.partitionBy(*of_span).orderBy("at", "seq"))
    settled = joined.filter(~F.col("mixed")).withColumn("inner", following)
    mixed = joined.filter("mixed").withColumn("inner", in_order)
    closed = F.when(place == F.col("last"), F.col("after")).otherwise(F.col("inner"))
    return (
        settled.unionByName(mixed)
        .withColumn("closed", closed)
        .filter(F.col("command") == "start")
        .select(
            "lane",
            F.col("session_id").alias("id"),
            "division_id",
            _moment(F.col("at")).alias("started_at"),
            _moment(F.col("closed.at")).alias("ended_at"),
            F.col("closed").isNull().alias("active"),
        )
    )


def _moment(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, _epoch())
