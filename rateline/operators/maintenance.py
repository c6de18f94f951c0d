"""Updates, deletes and resets as functions from table to next table version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateline.functions.text import trim_server, valid_name

_PLAYER_FIELDS = ["name", "age", "is_pitcher", "is_catcher", "division_id"]


def update_fault(columns: list[str]) -> Column:
    """Why an update is refused, the first reason that holds; NULL for one that is taken."""
    rules = [
        ("missing_id", F.coalesce(F.col("id"), F.lit(0)) == 0),
        ("missing_name", ~valid_name(F.col("name"))),
    ]
    if "malformed" in columns:
        rules.insert(0, ("malformed", F.col("malformed")))
    if "scientific" in columns:
        rules.append(("scientific_notation", F.col("scientific")))
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules])


def apply_player_updates(players: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Replace the five fields of each changed player; NULL is a value here.

    Rows with a fault are refused, and ids that do not exist change
    nothing. Of several accepted changes of one id the last by column ``order`` counts; among
    equals, the one that is greatest by its fields.
    """
    accepted = changes.filter(update_fault(changes.columns).isNull()).select(
        F.col("id").alias("_id"),
        trim_server(F.col("name")).alias("_name"),
        *[F.col(c).alias(f"_{c}") for c in _PLAYER_FIELDS[1:]],
        F.col(order).alias("_order"),
    )
    fields = F.struct(*[f"_{c}" for c in _PLAYER_FIELDS])
    last = accepted.groupBy("_id").agg(
        F.max_by(fields, F.struct("_order", fields)).alias("_last")
    )
    accepted = last.select("_id", "_last.*")
    changed = F.col("_id").isNotNull()
    return players.join(accepted, F.col("id") == F.col("_id"), "left").select(
        "id",
        *[F.when(changed, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in _PLAYER_FIELDS],
    )


def _children(table: DataFrame, key: str) -> DataFrame:
    return table.select(F.col(key).alias("id")).filter(F.col("id").isNotNull()).distinct()


def delete_divisions(
    divisions: DataFrame, players: DataFrame, sessions: DataFrame, requested: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Divisions and players after deleting ``requested.id``.

    A division with sessions stays; players of a deleted one lose their division.
    """
    asked = requested.select("id").distinct()
    gone = asked.join(divisions.select("id"), "id", "left_semi").join(
        _children(sessions, "division_id"), "id", "left_anti"
    )
    orphaned = gone.select(F.col("id").alias("_gone"))
    released = players.join(orphaned, F.col("division_id") == F.col("_gone"), "left").select(
        *[c for c in players.columns if c != "division_id"],
        F.when(F.col("_gone").isNull(), F.col("division_id")).alias("division_id"),
    )
    return divisions.join(gone, "id", "left_anti"), released


def delete_outcomes(
    table: DataFrame,
    requested: DataFrame,
    children: DataFrame,
    child_key: str,
    protect_admins: bool = False,
) -> DataFrame:
    """What happens to each requested id: deleted, restricted, protected, missing."""
    admin = F.col("is_admin") if protect_admins else F.lit(False)
    found = table.select("id", admin.alias("_admin"))
    used = _children(children, child_key).withColumn("_used", F.lit(True))
    return (
        requested.select("id")
        .distinct()
        .join(found, "id", "left")
        .join(used, "id", "left")
        .select(
            "id",
            F.when(F.col("_admin").isNull(), "missing")
            .when(F.col("_admin"), "protected")
            .when(F.col("_used"), "restricted")
            .otherwise("deleted")
            .alias("outcome"),
        )
    )


def delete_rows(table: DataFrame, outcomes: DataFrame) -> DataFrame:
    gone = outcomes.filter(F.col("outcome") == "deleted").select("id")
    return table.join(gone, "id", "left_anti")


def without_scores_of(evaluations: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Evaluations that survive the deletion of their owners."""
    return evaluations.join(owners.select(F.col("id").alias(key)), key, "left_anti")


def scores_of(evaluations: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Evaluations that go with the deletion of their owners."""
    return evaluations.join(owners.select(F.col("id").alias(key)), key, "left_semi")


def reset_players(evaluations: DataFrame, players: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evaluations and players after removing every player and their scores."""
    return without_scores_of(evaluations, players, "player_id"), players.limit(0)


def reset_coaches(evaluations: DataFrame, coaches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evaluations and coaches after removing all but administrators."""
    leaving = coaches.filter(~F.col("is_admin"))
    return without_scores_of(evaluations, leaving, "coach_id"), coaches.filter("is_admin")
