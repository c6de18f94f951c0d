"""Player, division and coach lists, look-ups, and the roster import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rateline.functions.scoring import display_number, position_code, position_label
from rateline.functions.text import (
    name_key,
    optional_int,
    reference_id,
    trim_server,
    truthy,
    valid_name,
)
from rateline.operators.ordering import ordered_position
from rateline.sources.roster_text import LINE_ORDER


def player_list(
    players: DataFrame, divisions: DataFrame, division_id: int | None = None
) -> DataFrame:
    """Players with division name and position; the unassigned are kept."""
    if division_id:
        players = players.filter(F.col("division_id") == division_id)
    named = divisions.select(F.col("id").alias("division_id"), F.col("name").alias("division_name"))
    position = position_label(F.col("is_pitcher"), F.col("is_catcher"))
    return players.join(named, "division_id", "left").select(
        "id",
        "name",
        "age",
        "is_pitcher",
        "is_catcher",
        "division_id",
        "division_name",
        position.alias("position"),
    )


def numbered_players(
    players: DataFrame, divisions: DataFrame, division_id: int | None = None
) -> DataFrame:
    """The list with its place in the list as a column."""
    listed = player_list(players, divisions, division_id)
    keyed = listed.withColumn(
        "_division", F.coalesce(name_key(F.col("division_name")), name_key(F.lit("")))
    ).withColumn("_assigned", F.col("division_name").isNotNull())
    keyed = keyed.withColumn("_key", name_key(F.col("name")))
    return ordered_position(
        keyed, ["_assigned", "_division", "_key", "id"], position="place"
    ).drop("_assigned", "_division", "_key")


def player_positions(players: DataFrame) -> DataFrame:
    position = position_label(F.col("is_pitcher"), F.col("is_catcher"))
    return players.select(
        "id",
        display_number(F.col("id")).alias("number"),
        position.alias("position"),
        position_code(position).alias("position_code"),
    )


def coach_list(coaches: DataFrame) -> DataFrame:
    """Administrators first, then by name; credentials are not in the model."""
    keyed = coaches.select("id", "name", "is_admin", "created_at").withColumn("_rest", ~F.col("is_admin"))
    keyed = keyed.withColumn("_key", name_key(F.col("name")))
    return ordered_position(keyed, ["_rest", "_key", "id"], position="place").drop("_rest", "_key")


def coach_by_name(coaches: DataFrame, names: DataFrame) -> DataFrame:
    """Coaches whose name matches one of ``names.name`` but for case and accents."""
    wanted = names.select(name_key(trim_server(F.col("name"))).alias("_name")).distinct()
    return coaches.join(wanted, name_key(coaches.name) == F.col("_name")).drop("_name")


def player_search(
    players: DataFrame,
    query: str,
    division_id: int | None = None,
    limit: int = 8,
    scored: DataFrame | None = None,
) -> DataFrame:
    """The first few players whose name or number contains the query.

    With ``scored``, a table of the player_ids already scored, each match says whether it is one.
    """
    text = query.strip().lower()
    if division_id:
        players = players.filter(F.col("division_id") == division_id)
    number = display_number(F.col("id"))
    found = players.select("id", number.alias("number"), "name").filter(
        F.lower("name").contains(text) | number.contains(text) if text else F.lit(False)
    )
    first = found.orderBy(name_key(F.col("name")), "id").limit(limit)
    if scored is None:
        return first
    marks = scored.select(F.col("player_id").alias("id")).distinct().withColumn("_mark", F.lit(True))
    return first.join(marks, "id", "left").select(*first.columns, F.col("_mark").isNotNull().alias("scored"))


def division_counts(divisions: DataFrame, players: DataFrame) -> DataFrame:
    """Players per division, 0 for an empty one, placed by name; folded before the join."""
    counts = players.groupBy("division_id").agg(F.count("id").alias("player_count"))
    listed = divisions.join(counts, divisions.id == counts.division_id, "left").select(
        "id",
        "name",
        F.coalesce("player_count", F.lit(0)).alias("player_count"),
        name_key(F.col("name")).alias("_key"),
    )
    return ordered_position(listed, ["_key", "id"], position="place").drop("_key")


def insert_if_absent(
    existing: DataFrame, candidates: DataFrame, order_by: list[str]
) -> DataFrame:
    """Candidate names no existing row has, with new ids; equal names count once.

    Names are compared as the database does: case, accents and trailing spaces
    do not matter.
    """
    keyed = candidates.withColumn("_key", name_key(F.col("name")))
    first = F.struct(*order_by, "name")
    once = keyed.groupBy("_key").agg(F.min(first).alias("_first"))
    taken = existing.select(name_key(F.col("name")).alias("_key"))
    fresh = once.join(taken, "_key", "left_anti").select("_first.*")
    return append_ids(existing, fresh, order_by).select("id", "name")


def create_named(existing: DataFrame, requested: DataFrame, order_by: list[str]) -> DataFrame:
    """Create requests with a usable name as new rows; equal names are allowed."""
    named = requested.withColumn("name", trim_server(F.col("name")))
    return append_ids(existing, named.filter(valid_name(F.col("name"))), order_by)


def append_ids(existing: DataFrame, new_rows: DataFrame, order_by: list[str]) -> DataFrame:
    """New rows with ids that go on after the highest one, in the given order."""
    highest = existing.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint"))).scalar()
    placed = ordered_position(new_rows, order_by, position="_place")
    return placed.select((highest + F.col("_place")).alias("id"), *new_rows.columns)


def resolve_roster(
    parsed: DataFrame, divisions: DataFrame, default_division_id: int | None = None
) -> DataFrame:
    """Parsed lines as players: role flags, age, and the division by its name.

    Names match but for case. Of equal division names the last one listed
    counts; one that is unknown falls back to the default and is flagged.
    """
    lookup = divisions.groupBy(F.lower("name").alias("_division")).agg(
        F.max_by("id", F.struct("name", "id")).alias("_division_id")
    )
    role = F.lower(F.coalesce("position_text", F.lit("")))
    asked = F.lower(F.coalesce("division_text", F.lit("")))
    default = F.lit(default_division_id or None).cast("bigint")
    return (
        parsed.withColumn("_asked", asked)
        .join(lookup, F.col("_asked") == F.col("_division"), "left")
        .select(
            *[c for c in LINE_ORDER if c in parsed.columns],
            trim_server(F.col("name")).alias("name"),
            optional_int(F.col("age_text")).alias("age"),
            role.contains("pitcher").alias("is_pitcher"),
            role.contains("catcher").alias("is_catcher"),
            F.coalesce("_division_id", default).alias("division_id"),
            ((F.col("_asked") != "") & F.col("_division_id").isNull()).alias("division_unmatched"),
        )
    )


def split_roster(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable name, and the rest with the reason."""
    ok = valid_name(F.col("name"))
    reason = F.when(F.coalesce("name", F.lit("")) == "", "blank_name").otherwise("zero_name")
    return rows.filter(ok), rows.filter(~ok).withColumn("reason", reason)


def roster_import(
    parsed: DataFrame,
    players: DataFrame,
    divisions: DataFrame,
    default_division_id: int | None = None,
    order_by: tuple[str, ...] = LINE_ORDER,
) -> DataFrame:
    """Accepted lines as new players, ids in line order; equal lines all count."""
    accepted, _ = split_roster(resolve_roster(parsed, divisions, default_division_id))
    return append_ids(players, accepted, list(order_by)).select(
        "id", "name", "age", "is_pitcher", "is_catcher", "division_id", "division_unmatched"
    )


def import_players(requests: DataFrame, players: DataFrame, order_by: list[str]) -> DataFrame:
    """Players from JSON import requests (see ``read_import_json``)."""
    own = F.col("division_id")
    rows = requests.select(
        trim_server(F.col("name")).alias("name"),
        optional_int(F.col("age")).alias("age"),
        truthy(F.col("is_pitcher")).alias("is_pitcher"),
        truthy(F.col("is_catcher")).alias("is_catcher"),
        F.when(own.isNotNull(), reference_id(own))
        .otherwise(reference_id(F.col("default_division_id")))
        .alias("division_id"),
    )
    return append_ids(players, rows.filter(valid_name(F.col("name"))), order_by)


def import_summary(rows: DataFrame) -> DataFrame:
    """Counts of an import in one aggregate."""
    ok = valid_name(F.col("name"))
    return rows.agg(
        F.count_if(ok).alias("imported"),
        F.count_if(~ok).alias("rejected"),
        F.count_if(ok & F.col("division_unmatched")).alias("unmatched"),
    ).withColumn("message", F.format_string("Imported %d players", "imported"))


def observed(rows: DataFrame, name: str = "import") -> tuple[DataFrame, Observation]:
    """Rows that count themselves while they are written, without a second pass."""
    counter = Observation(name)
    ok = valid_name(F.col("name"))
    return rows.observe(
        counter,
        F.count_if(ok).alias("imported"),
        F.count_if(~ok).alias("rejected"),
    ), counter


def created_message(created: Column, noun: str) -> Column:
    return F.when(
        created > 0, F.format_string(f"Created %d {noun}(s).", created)
    ).otherwise(F.lit(f"Demo {noun}s already exist."))

