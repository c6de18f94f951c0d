"""Rosters in order, and what is still to be scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateline.functions.scoring import SKILLS, display_number, position_label, score_band
from rateline.functions.text import name_key
from rateline.operators.ordering import ordered_neighbours, ordered_position
from rateline.sources.workspace import materialize

# Places in one long when gaps are searched, and longs that one long of the next level stands for.
WORD = 64

_GROUP = ["session_id", "coach_id", "skill_index"]


def roster_positions(players: DataFrame, buckets: int | None = None) -> DataFrame:
    """Place of each player in the division's roster: name order, then id."""
    roster = players.filter(F.col("division_id").isNotNull()).select(
        "division_id", F.col("id").alias("player_id"), "name", name_key(F.col("name")).alias("_key")
    )
    placed = ordered_position(
        roster,
        ["_key", "player_id"],
        ["division_id"],
        position="position",
        total="roster_size",
        buckets=buckets,
    )
    return placed.select("division_id", "player_id", "name", "position", "roster_size")


def roster_neighbours(players: DataFrame, buckets: int | None = None) -> DataFrame:
    """The player before and after in the division's roster."""
    roster = players.filter(F.col("division_id").isNotNull()).select(
        "division_id", F.col("id").alias("player_id"), "name", name_key(F.col("name")).alias("_key")
    )
    return ordered_neighbours(
        roster,
        ["_key", "player_id"],
        "player_id",
        ["division_id"],
        previous="previous_id",
        following="next_id",
        buckets=buckets,
    ).drop("_key")


def neighbour_scores(neighbours: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Neighbours with the score each of them holds, for one coach's scores."""
    def held(key: str, name: str) -> DataFrame:
        return evaluations.select(F.col("player_id").alias(key), F.col("score").alias(name))

    return (
        neighbours.join(held("player_id", "score"), "player_id", "left")
        .join(held("previous_id", "previous_score"), "previous_id", "left")
        .join(held("next_id", "next_score"), "next_id", "left")
    )


def roster_sizes(players: DataFrame) -> DataFrame:
    return (
        players.filter(F.col("division_id").isNotNull())
        .groupBy("division_id")
        .agg(F.count(F.lit(1)).alias("roster_size"))
    )


def in_roster(evaluations: DataFrame, players: DataFrame, sessions: DataFrame) -> DataFrame:
    """Scores of players who are in the division of the session."""
    member = players.select(F.col("id").alias("player_id"), "division_id")
    of_session = sessions.select(F.col("id").alias("session_id"), "division_id")
    return evaluations.join(of_session, "session_id").join(member, ["player_id", "division_id"])


def unscored_players(
    evaluations: DataFrame,
    players: DataFrame,
    sessions: DataFrame,
    session_id: int,
    coach_id: int,
    skill_index: int,
) -> DataFrame:
    """The roster of a session without those a coach has scored for a skill."""
    roster = players.join(
        sessions.filter(F.col("id") == session_id).select("division_id"),
        "division_id",
        "left_semi",
    ).select(F.col("id").alias("player_id"), "name")
    scored = evaluations.filter(
        (F.col("session_id") == session_id)
        & (F.col("coach_id") == coach_id)
        & (F.col("skill_index") == skill_index)
    )
    return roster.join(scored, "player_id", "left_anti")


def review_list(
    evaluations: DataFrame, players: DataFrame, sessions: DataFrame, session_id: int, coach_id: int
) -> DataFrame:
    """The roster of a session in order, for each skill with a coach's own score and its band.

    The scores of a player are put side by side in one fold, so that the roster is joined once and
    a row per skill is made afterwards; what was not scored has neither score nor band.
    """
    of_session = sessions.filter(F.col("id") == session_id).select("division_id")
    members = players.join(of_session, "division_id", "left_semi")
    shown = members.select(
        F.col("id").alias("player_id"),
        display_number(F.col("id")).alias("number"),
        position_label(F.col("is_pitcher"), F.col("is_catcher")).alias("label"),
    )
    own = (
        evaluations.filter((F.col("session_id") == session_id) & (F.col("coach_id") == coach_id))
        .groupBy("player_id")
        .agg(*[F.max(F.when(F.col("skill_index") == i, F.col("score"))).alias(f"s{i}") for i in range(len(SKILLS))])
    )
    skills = F.array(
        *[
            F.struct(F.lit(i).alias("skill_index"), F.lit(name).alias("skill_name"), F.col(f"s{i}").alias("score"))
            for i, name in enumerate(SKILLS)
        ]
    )
    return (
        roster_positions(members)
        .join(shown, "player_id")
        .join(own, "player_id", "left")
        .select("position", "player_id", "number", "name", "label", F.explode(skills).alias("skill"))
        .select(
            "skill.skill_index",
            "skill.skill_name",
            F.col("position").alias("place"),
            "player_id",
            "number",
            "name",
            F.nullif("label", F.lit("Player")).alias("position"),
            "skill.score",
            score_band(F.col("skill.score")).alias("band"),
        )
    )


def remaining_counts(
    evaluations: DataFrame, players: DataFrame, sessions: DataFrame
) -> DataFrame:
    """Roster size less scored members, per session, coach and skill with a score."""
    scored = (
        in_roster(evaluations, players, sessions)
        .groupBy(*_GROUP, "division_id")
        .agg(F.count(F.lit(1)).alias("scored"))
    )
    return scored.join(roster_sizes(players), "division_id").select(
        *_GROUP,
        "scored",
        "roster_size",
        (F.col("roster_size") - F.col("scored")).alias("remaining"),
    )


def skill_coverage(evaluations: DataFrame, players: DataFrame, sessions: DataFrame) -> DataFrame:
    """Scored members against roster size for every skill, per session and coach.

    Counts stand in for skills x roster: one conditional count per skill, then
    a row per skill.
    ``all_done`` wants a roster with someone in it, ``none_missing`` does not.
    """
    of_session = sessions.select(F.col("id").alias("session_id"), "division_id")
    member = players.select(
        F.col("id").alias("player_id"), F.col("division_id").alias("player_division")
    )
    joined = evaluations.join(of_session, "session_id").join(member, "player_id", "left")
    member_of = F.col("player_division") == F.col("division_id")
    scored = joined.groupBy("session_id", "coach_id", "division_id").agg(
        *[
            F.count_if(member_of & (F.col("skill_index") == i)).alias(f"_scored_{i}")
            for i in range(len(SKILLS))
        ]
    )
    per_skill = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("skill_index"), F.col(f"_scored_{i}").alias("scored"))
                for i in range(len(SKILLS))
            ]
        )
    )
    size = F.coalesce("roster_size", F.lit(0))
    rows = (
        scored.join(roster_sizes(players), "division_id", "left")
        .select("session_id", "coach_id", size.alias("roster_size"), per_skill.alias("_skill"))
        .select("session_id", "coach_id", "roster_size", "_skill.*")
    )
    none_missing = F.col("scored") == F.col("roster_size")
    return rows.select(
        *_GROUP,
        "scored",
        "roster_size",
        ((F.col("roster_size") > 0) & none_missing).alias("all_done"),
        none_missing.alias("none_missing"),
    )


def session_complete(coverage: DataFrame) -> DataFrame:
    """Whether a coach is through with all skills of a session."""
    return coverage.groupBy("session_id", "coach_id").agg(
        F.bool_and("none_missing").alias("complete"),
        F.bool_and("all_done").alias("complete_with_roster"),
        F.count_if("all_done").alias("skills_done"),
    )


def next_unfinished_skill(coverage: DataFrame) -> DataFrame:
    """For each skill a coach may be on, the lowest other one with a gap, else -1."""
    open_skill = F.when(~F.col("none_missing"), F.col("skill_index"))
    lowest = [
        F.coalesce(F.min(F.when(F.col("skill_index") != i, open_skill)), F.lit(-1))
        for i in range(len(SKILLS))
    ]
    per_skill = F.array(
        *[
            F.struct(F.lit(i).alias("current_skill"), F.col(f"_next_{i}").alias("next_skill"))
            for i in range(len(SKILLS))
        ]
    )
    return (
        coverage.groupBy("session_id", "coach_id")
        .agg(*[c.alias(f"_next_{i}") for i, c in enumerate(lowest)])
        .select("session_id", "coach_id", F.explode(per_skill).alias("_skill"))
        .select("session_id", "coach_id", "_skill.*")
    )


def _bit(place: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({place} % {WORD} as int))")


def _first_zero(word: Column) -> Column:
    """Place of the lowest bit of a long that is not set, WORD if all are."""
    ones = F.bit_count(word.bitwiseAND(F.bitwise_not(word + 1)))
    return F.when(word == (1 << 63) - 1, 63).otherwise(ones)


def _next_level(words: DataFrame, span: int) -> DataFrame:
    """WORD words of ``span`` places each as one; the gap is null where all places are scored."""
    full = F.when(F.col("gap").isNull(), _bit("word")).otherwise(0)
    at = F.col("word") * WORD + F.col("zero")  # the first word that is not full, or not there
    return (
        words.groupBy(*_GROUP, F.expr(f"word div {WORD}").alias("next"))
        .agg(
            F.bit_or(full).alias("full"),
            F.min("gap").alias("gap"),
            F.sum("scored").alias("scored"),
            F.any_value("roster_size").alias("roster_size"),
        )
        .withColumnRenamed("next", "word")
        .withColumn("zero", _first_zero(F.col("full")))
        .select(
            *_GROUP,
            "word",
            "roster_size",
            "scored",
            F.when(F.col("zero") == WORD, None)
            .when(F.expr(f"gap div {span}") == at, F.col("gap"))
            .otherwise(at * span)
            .alias("gap"),
        )
    )


def first_unscored(
    evaluations: DataFrame,
    positions: DataFrame,
    sessions: DataFrame,
    assignments: DataFrame | None = None,
) -> DataFrame:
    """0-based place of the first unscored member per session, coach and skill.

    The answer is the roster size when none is left. Cost follows the scores:
    roster x coach x skill is never formed. Scored places are bits, folded into longs
    before the shuffle, so nothing is sorted and a huge group is spread over its longs. A
    level of longs says which longs below are full; there are as many levels as the largest
    roster needs.

    ``assignments`` (session_id, coach_id, skill_index) adds groups that have
    no score yet.
    """
    of_session = sessions.select(F.col("id").alias("session_id"), "division_id")
    place = F.col("position") - 1
    members = materialize(
        positions.select("division_id", "player_id", "roster_size", place.alias("place")), "places"
    )
    scored = (
        evaluations.select("session_id", "player_id", "coach_id", "skill_index")
        .join(of_session, "session_id")
        .join(members, ["player_id", "division_id"])
    )
    zero = _first_zero(F.col("bits"))
    words = (
        scored.groupBy(*_GROUP, F.expr(f"place div {WORD}").alias("word"))
        .agg(F.bit_or(_bit("place")).alias("bits"), F.any_value("roster_size").alias("roster_size"))
        .select(
            *_GROUP,
            "word",
            "roster_size",
            F.bit_count("bits").cast("bigint").alias("scored"),
            F.when(zero < WORD, F.col("word") * WORD + zero).alias("gap"),
        )
    )
    span, largest = WORD, members.agg(F.max("roster_size")).first()[0] or 0
    while span < largest:
        words = _next_level(words, span)
        span *= WORD
    answers = words.select(
        *_GROUP,
        F.coalesce("gap", "scored").alias("first_unscored"),
        (F.col("roster_size") - F.col("scored")).alias("remaining"),
    )
    if assignments is None:
        return answers
    sizes = positions.groupBy("division_id").agg(F.any_value("roster_size").alias("roster_size"))
    wanted = assignments.join(of_session, "session_id").join(sizes, "division_id", "left")
    untouched = wanted.join(answers, _GROUP, "left_anti").select(
        *_GROUP,
        F.lit(0).cast("bigint").alias("first_unscored"),
        F.coalesce("roster_size", F.lit(0)).alias("remaining"),
    )
    return answers.unionByName(untouched)
