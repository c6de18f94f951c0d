"""Submission streams: replay, quarantine, live progress.

The replay is a log of folders ``batch_id=<n>``, and a micro-batch that is run again
overwrites its own folder; progress is a log of runs, which knows the batches it has.
So at-least-once delivery has the effect of exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rateline.functions.scoring import average_e4, e4_to_double
from rateline.operators.latest import latest_evaluations
from rateline.operators.quality import submission_faults
from rateline.schemas import EVALUATION_KEY, JSON_TIMES, SUBMISSION_JSON, SUBMISSIONS
from rateline.sources.json_records import coerce_submissions
from rateline.streaming.runs import FANOUT, RunLog

SESSION_BUCKETS = 64
#: Sessions of a batch that are looked up by their ids; beyond that by their buckets alone.
TOUCHED = 1000

_JUDGED = [
    T.StructField("faults", T.ArrayType(T.StringType())),
    T.StructField("valid", T.BooleanType()),
]
_COUNTED = T.StructType([T.StructField(n, T.LongType()) for n in ("accepted", "rejected")])
_CHANGES = T.StructType(
    [
        *[f for f in SUBMISSIONS.fields if f.name in (*EVALUATION_KEY, "score", "arrival_seq")],
        T.StructField("d_sum", T.LongType()),
        T.StructField("d_count", T.LongType()),
        T.StructField("session_bucket", T.IntegerType()),
    ]
)


def drop_submissions(submissions: DataFrame, folder: str, files: int) -> None:
    """Add submissions to a folder of JSON files in arrival order, as a field queue would."""
    submissions.repartitionByRange(files, "arrival_seq").write.mode("append").options(**JSON_TIMES).json(folder)


def submission_stream(
    spark: SparkSession,
    folder: str,
    files_per_trigger: int | None = None,
    bytes_per_trigger: str | None = None,
    dequeue: str | None = None,
) -> DataFrame:
    """New files of a folder; a batch may be limited by files or by size, not both.

    With ``dequeue`` a file leaves the queue once the batch that read it is committed, on the
    way to the next batch: "delete" removes it, any other value is the folder it is moved to. What fails
    before the commit is still there to be read again.
    """
    reader = _limited(spark.readStream, files_per_trigger, bytes_per_trigger)
    if dequeue is not None:
        reader = reader.option("cleanSource", "delete" if dequeue == "delete" else "archive")
        if dequeue != "delete":
            reader = reader.option("sourceArchiveDir", dequeue)
    return reader.schema(SUBMISSIONS).options(**JSON_TIMES).json(folder)


def payload_stream(
    spark: SparkSession,
    folder: str,
    files_per_trigger: int | None = None,
    bytes_per_trigger: str | None = None,
) -> DataFrame:
    """Loosely typed JSON lines, coerced as in a batch; ``payload`` keeps the line.

    Blank lines are no submissions.
    """
    lines = _limited(spark.readStream, files_per_trigger, bytes_per_trigger).text(folder)
    fields = F.from_json("value", SUBMISSION_JSON, {"mode": "PERMISSIVE"})
    parsed = lines.filter(F.btrim("value") != "").select(
        F.col("value").alias("payload"), fields.alias("_fields")
    )
    return coerce_submissions(parsed.select("payload", "_fields.*"), keep=("payload",))


def _limited(reader, files: int | None, size: str | None):
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    if size is not None:
        reader = reader.option("maxBytesPerTrigger", size)
    return reader


def _start(writer, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def start_replay(
    stream: DataFrame,
    log: str,
    checkpoint: str,
    interval: str | None = None,
    counters: str | None = None,
) -> StreamingQuery:
    """Append each batch to the log, split into accepted and quarantined rows.

    A row that can never be accepted is set aside and blocks nothing behind it;
    a failed write is retried from the checkpoint. With ``counters``, a folder, the rows of each batch are
    counted while they are written; a batch that is run again replaces its counts.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("faults", submission_faults(batch.columns)).withColumn(
            "valid", F.size("faults") == 0
        )
        seen = Observation("replay")
        if counters is not None:
            rows = rows.observe(
                seen, F.count_if("valid").alias("accepted"), F.count_if(~F.col("valid")).alias("rejected")
            )
        rows.write.mode("overwrite").partitionBy("valid").parquet(f"{log}/batch_id={batch_id}")
        if counters is not None:
            counted = spark.createDataFrame([(seen.get["accepted"], seen.get["rejected"])], _COUNTED)
            counted.coalesce(1).write.mode("overwrite").parquet(f"{counters}/batch_id={batch_id}")

    return _start(stream.writeStream.foreachBatch(write), checkpoint, interval)


def delivered(spark: SparkSession, counters: str) -> DataFrame:
    """What came in all batches, copies included: accepted and rejected."""
    return spark.read.schema(_COUNTED).parquet(counters).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTED.names]
    )


def replay_summary(spark: SparkSession, log: str, schema: T.StructType = SUBMISSIONS) -> DataFrame:
    """Accepted and rejected submissions, each once, and how many copies came besides.

    A queue that is emptied after the upload sends an item again when it fails between the two. Copies are
    rows that are equal in all columns, in whichever files or batches they came.
    """
    once = _replayed(spark, log, schema).groupBy(*schema.names, "valid").agg(F.count(F.lit(1)).alias("copies"))
    return once.agg(
        F.count_if("valid").alias("accepted"),
        F.count_if(~F.col("valid")).alias("rejected"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("repeated"),
    )


def _replayed(spark: SparkSession, log: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, *_JUDGED])).parquet(log)


def accepted_submissions(
    spark: SparkSession, log: str, schema: T.StructType = SUBMISSIONS
) -> DataFrame:
    """Accepted rows; ``schema`` is PAYLOADS for a log of ``payload_stream``."""
    return _replayed(spark, log, schema).filter("valid").select(*schema.names)


def quarantined_submissions(
    spark: SparkSession, log: str, schema: T.StructType = SUBMISSIONS
) -> DataFrame:
    """Refused rows with the reasons, and of payloads the line as it came; what came twice is there once."""
    rows = _replayed(spark, log, schema).filter(~F.col("valid")).dropDuplicates(schema.names)
    return rows.select(*schema.names, F.concat_ws(",", "faults").alias("reasons"))


def replayed_latest(
    spark: SparkSession, log: str, schema: T.StructType = SUBMISSIONS
) -> DataFrame:
    return latest_evaluations(accepted_submissions(spark, log, schema))


def progress_log(spark: SparkSession, changes: str, fanout: int = FANOUT) -> RunLog:
    """Changes to sum and count by key, folded to one row a key; laid out by session."""

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*EVALUATION_KEY, "session_bucket").agg(
            F.max_by("score", "arrival_seq").alias("score"),
            F.max("arrival_seq").alias("arrival_seq"),
            F.sum("d_sum").alias("d_sum"),
            F.sum("d_count").alias("d_count"),
        )

    return RunLog(spark, changes, _CHANGES, fold, ("session_bucket",), ("session_id",), fanout)


def start_progress(
    stream: DataFrame,
    changes: str,
    checkpoint: str,
    interval: str | None = "5 seconds",
    fanout: int = FANOUT,
) -> StreamingQuery:
    """Keep progress current by adding up changes.

    A batch keeps the last score of each of its keys, looks the keys up among
    earlier changes, and adds what that does to sum and count. A corrected
    score so takes back the old one, and averages are never stored. The log folds itself: a
    batch reads its sessions' part of a few runs, however many batches came before.
    """
    log = progress_log(stream.sparkSession, changes, fanout)
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(SESSION_BUCKETS)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        if log.has(checkpoint, batch_id):
            return
        valid = batch.filter(F.size(submission_faults(batch.columns)) == 0)
        latest = (
            valid.groupBy(*EVALUATION_KEY)
            .agg(
                F.max_by("score", "arrival_seq").alias("score"),
                F.max("arrival_seq").alias("arrival_seq"),
            )
            .withColumn("session_bucket", bucket)
            .persist()
        )
        try:
            log.commit(checkpoint, batch_id, _change(log, latest))
        finally:
            latest.unpersist()

    return _start(stream.writeStream.foreachBatch(write), checkpoint, interval)


def _change(log: RunLog, latest: DataFrame) -> DataFrame:
    # Only folders of touched buckets are read, of a few sessions only the row groups that may
    # hold them, and only keys of this batch go on to the shuffle.
    some = latest.select("session_bucket", "session_id").distinct().limit(TOUCHED + 1).collect()
    buckets = sorted({r.session_bucket for r in some})
    known = log.read()
    if len(some) <= TOUCHED:
        known = known.filter(
            F.col("session_bucket").isin(buckets) & F.col("session_id").isin([r.session_id for r in some])
        )
    before = (
        known.join(latest.select(*EVALUATION_KEY), EVALUATION_KEY, "left_semi")
        .groupBy(*EVALUATION_KEY)
        .agg(
            F.max_by("score", "arrival_seq").alias("old_score"),
            F.max("arrival_seq").alias("old_seq"),
        )
    )
    is_new = F.col("old_seq").isNull()
    return (
        latest.join(before, EVALUATION_KEY, "left")
        .filter(is_new | (F.col("arrival_seq") > F.col("old_seq")))
        .select(
            *EVALUATION_KEY,
            "score",
            "arrival_seq",
            (F.col("score") - F.coalesce("old_score", F.lit(0))).cast("bigint").alias("d_sum"),
            is_new.cast("bigint").alias("d_count"),
            "session_bucket",
        )
    )


def progress_so_far(spark: SparkSession, changes: str) -> DataFrame:
    sums = (
        progress_log(spark, changes)
        .read()
        .groupBy("session_id", "player_id", "skill_index")
        .agg(F.sum("d_sum").alias("_sum"), F.sum("d_count").alias("coach_count"))
    )
    avg_e4 = average_e4(F.col("_sum"), F.col("coach_count"))
    return sums.withColumn("avg_e4", avg_e4).select(
        "session_id",
        "player_id",
        "skill_index",
        "avg_e4",
        e4_to_double(F.col("avg_e4")).alias("avg_score"),
        "coach_count",
    )


def compact_changes(spark: SparkSession, changes: str, target: str) -> None:
    """A log of changes as one run in a new folder, which streams may go on from."""
    progress_log(spark, target).commit("compacted", 0, progress_log(spark, changes).folded())
