"""Submission checks and the integrity report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateline.functions.scoring import MAX_SCORE, MIN_SCORE, SKILLS
from rateline.functions.text import MAX_INT
from rateline.schemas import EVALUATION_KEY


def submission_faults(columns: list[str]) -> Column:
    """The names of the rules a submission breaks, in a fixed order."""
    session, player = F.col("session_id"), F.col("player_id")
    skill, score = F.col("skill_index"), F.col("score")
    rules = [
        ("missing_session", F.coalesce(session, F.lit(0)) == 0),
        ("missing_player", F.coalesce(player, F.lit(0)) == 0),
        (
            "bad_skill_index",
            F.coalesce(skill, F.lit(-1)).cast("bigint").between(0, MAX_INT) == F.lit(False),
        ),
        (
            "bad_score",
            F.coalesce(score, F.lit(0)).cast("bigint").between(MIN_SCORE, MAX_SCORE)
            == F.lit(False),
        ),
    ]
    if "malformed" in columns:
        rules.append(("malformed", F.col("malformed")))
    if "scientific" in columns:
        rules.append(("scientific_notation", F.col("scientific")))
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def valid_submissions(submissions: DataFrame) -> DataFrame:
    """Rows without a fault; ``rejected_submissions`` holds all others."""
    return submissions.filter(F.size(submission_faults(submissions.columns)) == 0)


def rejected_submissions(submissions: DataFrame) -> DataFrame:
    faults = submissions.withColumn("faults", submission_faults(submissions.columns))
    return faults.filter(F.size("faults") > 0).withColumn(
        "reasons", F.concat_ws(",", "faults")
    ).drop("faults")


def _present(df: DataFrame, key: str, flag: str, *extra: Column) -> DataFrame:
    return df.select(F.col("id").alias(key), *extra, F.lit(True).alias(flag))


def integrity_report(
    divisions: DataFrame,
    players: DataFrame,
    coaches: DataFrame,
    sessions: DataFrame,
    submissions: DataFrame,
) -> DataFrame:
    """Every broken rule as ``(rule, key, detail)``.

    Submissions are folded to one row per natural key once, with the number of
    copies, and all rules about that row are judged in one pass over it: it is
    scanned, shuffled and joined once, not once per rule.
    """
    evaluations = (
        valid_submissions(submissions)
        .groupBy(*EVALUATION_KEY)
        .agg(
            F.min_by("created_at", "arrival_seq").alias("created_at"),
            F.count(F.lit(1)).alias("copies"),
        )
    )
    division_present = _present(divisions, "division_id", "division_found")

    def orphan_divisions(children: DataFrame, rule: str) -> DataFrame:
        return (
            children.filter(F.col("division_id").isNotNull())
            .join(division_present, "division_id", "left_anti")
            .select(
                F.lit(rule).alias("rule"),
                F.col("id").cast("string").alias("key"),
                F.concat(F.lit("division "), F.col("division_id")).alias("detail"),
            )
        )

    joined = (
        evaluations.join(
            _present(
                sessions,
                "session_id",
                "session_found",
                F.col("division_id").alias("session_division"),
                "started_at",
                "ended_at",
            ),
            "session_id",
            "left",
        )
        .join(
            _present(
                players,
                "player_id",
                "player_found",
                F.col("division_id").alias("player_division"),
            ),
            "player_id",
            "left",
        )
        .join(_present(coaches, "coach_id", "coach_found"), "coach_id", "left")
    )
    outside = (F.col("created_at") < F.col("started_at")) | (
        F.col("created_at") >= F.col("ended_at")
    )
    mismatch = (
        F.col("session_found")
        & F.col("player_found")
        & ~F.col("session_division").eqNullSafe(F.col("player_division"))
    )

    def finding(rule: str, broken: Column, detail: Column) -> Column:
        return F.when(
            broken,
            F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")),
        )

    findings = F.array_compact(
        F.array(
            finding("orphan_session", F.col("session_found").isNull(), F.col("session_id")),
            finding("orphan_player", F.col("player_found").isNull(), F.col("player_id")),
            finding("orphan_coach", F.col("coach_found").isNull(), F.col("coach_id")),
            finding(
                "unknown_skill",
                F.col("skill_index") >= len(SKILLS),
                F.col("skill_index"),
            ),
            finding("inactive_session_score", outside, F.col("session_id")),
            finding("player_division_mismatch", mismatch, F.col("player_division")),
            finding("duplicate_key", F.col("copies") > 1, F.col("copies")),
        )
    )
    of_evaluations = joined.select(
        F.concat_ws("/", *EVALUATION_KEY).alias("key"), F.explode(findings).alias("finding")
    ).select("finding.rule", "key", "finding.detail")

    of_submissions = submissions.filter(
        ~F.coalesce(F.col("score").between(MIN_SCORE, MAX_SCORE), F.lit(False))
    ).select(
        F.lit("score_out_of_range").alias("rule"),
        F.concat_ws("/", *EVALUATION_KEY).alias("key"),
        F.col("score").cast("string").alias("detail"),
    )
    skill_index_range = sessions.filter(F.col("current_skill_index") >= len(SKILLS)).select(
        F.lit("session_skill_out_of_range").alias("rule"),
        F.col("id").cast("string").alias("key"),
        F.col("current_skill_index").cast("string").alias("detail"),
    )
    several_active = (
        sessions.filter("active")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .select(
            F.lit("several_active_sessions").alias("rule"),
            F.lit("sessions").alias("key"),
            F.col("n").cast("string").alias("detail"),
        )
    )
    report = of_evaluations
    for part in (
        of_submissions,
        orphan_divisions(players, "orphan_player_division"),
        orphan_divisions(sessions, "orphan_session_division"),
        skill_index_range,
        several_active,
    ):
        report = report.unionByName(part)
    return report
