"""Active-session monitor over a stream of session commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rateline.operators.sessions import lifecycle
from rateline.schemas import COMMANDS, JSON_TIMES
from rateline.streaming.runs import RunLog
from rateline.streaming.submissions import _start


def drop_commands(commands: DataFrame, folder: str, files: int, mixed: bool = False) -> None:
    """Commands as JSON files, one after the other in time, or ``mixed`` so that they come in no order."""
    spread = commands.repartition(files, F.xxhash64("seq")) if mixed else commands.repartitionByRange(files, "seq")
    spread.write.mode("append").options(**JSON_TIMES).json(folder)


def command_stream(
    spark: SparkSession, folder: str, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(COMMANDS).options(**JSON_TIMES)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def _last_command(commands: DataFrame) -> DataFrame:
    """The last start or end per lane, by time and then ``seq`` as in a batch."""
    started = F.when(F.col("command") == "start", F.col("session_id")).alias("session_id")
    return _last(lifecycle(commands).select("lane", "ts", "seq", started, "division_id"))


def _last(state: DataFrame) -> DataFrame:
    step = F.struct("ts", "seq", "session_id", "division_id")
    return state.groupBy("lane").agg(F.max(step).alias("step")).select("lane", "step.*")


_STATE = T.StructType([f for f in COMMANDS.fields if f.name != "command"])


def _log(spark: SparkSession, root: str) -> RunLog:
    return RunLog(spark, root, _STATE, _last)


def start_monitor(
    stream: DataFrame, log: str, checkpoint: str, interval: str | None = "4 seconds"
) -> StreamingQuery:
    """Keep each lane's last command in a log of runs, which folds itself."""
    kept = _log(stream.sparkSession, log)

    def write(batch: DataFrame, batch_id: int) -> None:
        if not kept.has(checkpoint, batch_id):
            kept.commit(checkpoint, batch_id, _last_command(batch))

    return _start(stream.writeStream.foreachBatch(write), checkpoint, interval)


def active_sessions(spark: SparkSession, log: str) -> DataFrame:
    """Per lane the session now open; a lane whose last command ended it has none."""
    last = _log(spark, log).folded()
    return last.filter(F.col("session_id").isNotNull()).select(
        "lane", F.col("session_id").alias("id"), "division_id", F.col("ts").alias("started_at")
    )
