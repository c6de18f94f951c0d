"""Averages per player and skill, overall scores, leaderboards and grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rateline.functions.scoring import (
    SKILLS,
    average_e4,
    display_number,
    e4_to_double,
    e4_to_tenths,
    medal,
    overall,
    overall_tenths,
    position_label,
    score_band,
    skill_name,
    subtitle,
)
from rateline.functions.text import name_key
from rateline.operators.ordering import ordered_position


def skill_averages(evaluations: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and count per ``by`` and skill, as integers."""
    sums = evaluations.groupBy(*by, "skill_index").agg(
        F.sum("score").alias("_sum"), F.count(F.lit(1)).alias("n")
    )
    return sums.select(
        *by, "skill_index", average_e4(F.col("_sum"), F.col("n")).alias("avg_e4"), "n"
    )


def visible_evaluations(
    evaluations: DataFrame, viewer_coach_id: int | None = None, session_id: int | None = None
) -> DataFrame:
    """All rows for an administrator, own rows for a coach; optionally one session."""
    terms: list[Column] = []
    if viewer_coach_id is not None:
        terms.append(F.col("coach_id") == viewer_coach_id)
    if session_id:
        terms.append(F.col("session_id") == session_id)
    return evaluations.filter(reduce(lambda a, b: a & b, terms)) if terms else evaluations


def results(
    evaluations: DataFrame,
    players: DataFrame,
    divisions: DataFrame,
    viewer_coach_id: int | None = None,
    division_id: int | None = None,
    session_id: int | None = None,
) -> DataFrame:
    """Average per player and skill; players without a division are left out.

    Scores are folded before the joins, so only one row per player and skill
    meets the roster. A division filter also reaches the scores as a semi join,
    which Catalyst moves below the aggregate when the roster side is small.
    """
    scores = visible_evaluations(evaluations, viewer_coach_id, session_id)
    if division_id:
        players = players.filter(F.col("division_id") == division_id)
        scores = scores.join(
            players.select(F.col("id").alias("player_id")), "player_id", "left_semi"
        )
    averages = skill_averages(scores, ["player_id"])
    roster = players.select(
        F.col("id").alias("player_id"),
        F.col("name").alias("player_name"),
        "age",
        position_label(F.col("is_pitcher"), F.col("is_catcher")).alias("position"),
        "division_id",
    )
    named = divisions.select(
        F.col("id").alias("division_id"), F.col("name").alias("division_name")
    )
    return averages.join(roster, "player_id").join(named, "division_id").select(
        "player_id",
        "player_name",
        "age",
        "position",
        "division_id",
        "division_name",
        "skill_index",
        skill_name(F.col("skill_index")).alias("skill_name"),
        "avg_e4",
        e4_to_double(F.col("avg_e4")).alias("avg_score"),
        F.col("n").alias("eval_count"),
    )


def ordered_results(rows: DataFrame) -> DataFrame:
    """Results with their place by player name and skill; equal names go by id."""
    keyed = rows.withColumn("_key", name_key(F.col("player_name")))
    order = ["_key", "player_id", "skill_index"]
    return ordered_position(keyed, order, position="place").drop("_key")


def session_progress(evaluations: DataFrame, session_id: int | None = None) -> DataFrame:
    scores = visible_evaluations(evaluations, session_id=session_id)
    return skill_averages(scores, ["session_id", "player_id"]).select(
        "session_id",
        "player_id",
        "skill_index",
        "avg_e4",
        e4_to_double(F.col("avg_e4")).alias("avg_score"),
        F.col("n").alias("coach_count"),
    )


def pivot_skills(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One column per skill; the explicit list saves the job that would find it."""
    pivoted = (
        df.groupBy(*by).pivot("skill_index", list(range(len(SKILLS)))).agg(F.first(value))
    )
    for index, name in enumerate(SKILLS):
        pivoted = pivoted.withColumnRenamed(str(index), name.lower())
    return pivoted


def player_overall(result_rows: DataFrame, *more: Column) -> DataFrame:
    """Mean of the skill means per player, out-of-range skills included.

    ``more`` aggregates are computed in the same pass.
    """
    folded = result_rows.groupBy("player_id").agg(
        F.any_value("player_name").alias("player_name"),
        F.any_value("age").alias("age"),
        F.any_value("position").alias("position"),
        F.any_value("division_id").alias("division_id"),
        F.any_value("division_name").alias("division_name"),
        F.sum("avg_e4").alias("_sum"),
        F.count(F.lit(1)).alias("skills"),
        *more,
    )
    total, skills = F.col("_sum"), F.col("skills")
    return folded.withColumns(
        {"overall": overall(total, skills), "overall_1dp": overall_tenths(total, skills)}
    ).drop("_sum")


def results_wide(result_rows: DataFrame) -> DataFrame:
    """One row per player with a rounded cell per skill and the overall score."""
    cell = e4_to_tenths(F.col("avg_e4"))
    return player_overall(
        result_rows,
        *[
            F.max(F.when(F.col("skill_index") == index, cell)).alias(name.lower())
            for index, name in enumerate(SKILLS)
        ],
    )


def leaderboard(
    players_overall: DataFrame, by_division: bool = False, buckets: int | None = None
) -> DataFrame:
    """Position by overall, ties by player id, over everyone or per division.

    The order is cut into even ranges of (overall, player id), so no task sorts
    a large share of the players, however many of them tie or share a division.
    """
    ranked = ordered_position(
        players_overall.withColumn("_down", -F.col("overall")),
        ["_down", "player_id"],
        ["division_id"] if by_division else [],
        position="rank",
        buckets=buckets,
    )
    return _decorated(ranked)


def podium(players_overall: DataFrame, size: int = 3) -> DataFrame:
    """The best few over everyone: a top-k, no full ranking."""
    best = players_overall.orderBy(F.desc("overall"), "player_id").limit(size)
    place = F.row_number().over(Window.orderBy(F.desc("overall"), "player_id"))
    return _decorated(best.withColumn("rank", place))


def podium_by_division(players_overall: DataFrame, size: int = 3) -> DataFrame:
    """The best few per division; each task keeps only its own best few."""
    window = Window.partitionBy("division_id").orderBy(F.desc("overall"), "player_id")
    return _decorated(
        players_overall.withColumn("rank", F.row_number().over(window)).filter(
            F.col("rank") <= size
        )
    )


def _decorated(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        F.col("rank").cast("bigint").alias("rank"),
        "player_id",
        "player_name",
        subtitle(F.col("position"), F.col("age")).alias("subtitle"),
        "division_id",
        "division_name",
        "skills",
        "overall",
        "overall_1dp",
        score_band(F.col("overall")).alias("band"),
        medal(F.col("rank")).alias("medal"),
    )


def score_bands(result_rows: DataFrame) -> DataFrame:
    """Both bands of a skill mean: of the exact one and of the rounded one."""
    rounded = e4_to_tenths(F.col("avg_e4"))
    return result_rows.select(
        "player_id",
        "skill_index",
        "avg_score",
        rounded.alias("avg_1dp"),
        score_band(F.col("avg_score")).alias("band"),
        score_band(rounded).alias("rounded_band"),
    )


def progress_grid(
    evaluations: DataFrame,
    players: DataFrame,
    sessions: DataFrame,
    session_id: int | None = None,
    scored_only: bool = False,
) -> DataFrame:
    """The roster of each given session with a rounded mean and band per skill.

    With ``session_id`` one session is read, on all sides. With ``scored_only`` players without a score
    are left out: the result grows with the scores, not with sessions times rosters.
    """
    if session_id is not None:
        evaluations = evaluations.filter(F.col("session_id") == session_id)
        sessions = sessions.filter(F.col("id") == session_id)
    cells = pivot_skills(
        session_progress(
            evaluations.join(
                sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi"
            )
        ).withColumn("_cell", e4_to_tenths(F.col("avg_e4"))),
        ["session_id", "player_id"],
        "_cell",
    )
    divisions = sessions.select(F.col("id").alias("session_id"), "division_id")
    listed = players.select(F.col("id").alias("player_id"), "name", "division_id")
    if scored_only:
        rows = cells.join(divisions, "session_id").join(listed, ["division_id", "player_id"])
    else:
        rows = divisions.join(listed, "division_id").join(cells, ["session_id", "player_id"], "left")
    names = [name.lower() for name in SKILLS]
    return rows.select(
        "session_id",
        "player_id",
        display_number(F.col("player_id")).alias("number"),
        "name",
        *names,
        *[score_band(F.col(n)).alias(f"{n}_band") for n in names],
    )


def scores_as_map(evaluations: DataFrame) -> DataFrame:
    """Skill to score per session, coach and player; a map holds one entry a skill."""
    entries = F.array_sort(F.collect_list(F.struct("skill_index", "score")))
    return evaluations.groupBy("session_id", "coach_id", "player_id").agg(
        F.map_from_entries(entries).alias("scores")
    )


def scores_from_map(maps: DataFrame) -> DataFrame:
    return maps.select(
        "session_id",
        "coach_id",
        "player_id",
        F.explode("scores").alias("skill_index", "score"),
    )
