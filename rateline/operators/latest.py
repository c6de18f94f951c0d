"""Last score per natural key, and the overlay of pending scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateline.functions.scoring import skill_name
from rateline.operators.quality import valid_submissions
from rateline.schemas import EVALUATION_KEY


def latest_evaluations(submissions: DataFrame, keep_order: bool = False) -> DataFrame:
    """The upsert: the last arrival sets the score, the first keeps its time.

    ``arrival_seq`` is one bigint, so this stays a hash aggregate, and the partial
    step folds the copies of a hot key before the shuffle. ``keep_order`` adds the
    first and last arrival, which ``upsert_evaluations`` needs.
    """
    order = [F.min("arrival_seq").alias("first_seq"), F.max("arrival_seq").alias("arrival_seq")]
    return (
        valid_submissions(submissions)
        .groupBy(*EVALUATION_KEY)
        .agg(
            F.max_by("score", "arrival_seq").alias("score"),
            F.min_by("created_at", "arrival_seq").alias("created_at"),
            *(order if keep_order else []),
        )
        .select(
            *EVALUATION_KEY,
            skill_name(F.col("skill_index")).alias("skill_name"),
            "score",
            "created_at",
            *(["first_seq", "arrival_seq"] if keep_order else []),
        )
    )


def latest_queued(submissions: DataFrame) -> DataFrame:
    """The score queued last per key; of equal queue times the last arrival counts.

    Two hash aggregates, as one order of two columns would need sorts. A missing
    queue time comes before all others.
    """
    never = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    return (
        valid_submissions(submissions)
        .groupBy(*EVALUATION_KEY, F.coalesce("queued_at", never).alias("queued_at"))
        .agg(F.max_by("score", "arrival_seq").alias("score"))
        .groupBy(*EVALUATION_KEY)
        .agg(F.max_by("score", "queued_at").alias("score"))
        .select(*EVALUATION_KEY, skill_name(F.col("skill_index")).alias("skill_name"), "score")
    )


def upsert_evaluations(stored: DataFrame, submissions: DataFrame) -> DataFrame:
    """Evaluations stored with ``keep_order``, and further submissions.

    Saves folding the whole log again: only the new rows are aggregated. Both sides
    know their first and last arrival, so batches may come late or twice.
    """
    new = latest_evaluations(submissions, keep_order=True)
    values = ("score", "created_at", "first_seq", "arrival_seq")
    new = new.select(*EVALUATION_KEY, *[F.col(c).alias(f"_{c}") for c in values])
    later = F.col("_arrival_seq") > F.col("arrival_seq")
    earlier = F.col("_first_seq") < F.col("first_seq")

    def pick(name: str, wins: Column) -> Column:
        taken = F.coalesce(wins, F.col("arrival_seq").isNull())
        return F.when(taken, F.col(f"_{name}")).otherwise(F.col(name)).alias(name)

    return stored.join(new, EVALUATION_KEY, "full_outer").select(
        *EVALUATION_KEY,
        skill_name(F.col("skill_index")).alias("skill_name"),
        pick("score", later),
        pick("created_at", earlier),
        pick("first_seq", earlier),
        pick("arrival_seq", later),
    )


def pending_overlay(evaluations: DataFrame, pending: DataFrame) -> DataFrame:
    """Stored scores with the queued ones on top; the last queued one wins."""
    queued = pending.groupBy(*EVALUATION_KEY).agg(
        F.max_by("score", "arrival_seq").alias("pending_score")
    )
    stored = evaluations.select(*EVALUATION_KEY, F.col("score").alias("stored_score"))
    return stored.join(queued, EVALUATION_KEY, "full_outer").select(
        *EVALUATION_KEY,
        F.coalesce("pending_score", "stored_score").alias("score"),
        F.col("pending_score").isNotNull().alias("is_pending"),
    )


def pending_counts(pending: DataFrame) -> DataFrame:
    return pending.groupBy("coach_id", "session_id").agg(F.count("*").alias("pending"))
