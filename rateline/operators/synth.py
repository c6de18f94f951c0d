"""Demo data. Draws are hashes of the row's own key, so a retried task repeats them."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The divisions a fresh installation is seeded with.
DEMO_DIVISIONS = ("Majors", "AAA", "AA", "Single-A")

# Roster size, ages and role shares in percent of demo players.
PLAYERS_PER_DIVISION = 100
MIN_AGE, MAX_AGE = 8, 14
PITCHER_SHARE, CATCHER_SHARE = 20, 10
DEMO_COACHES = 10

# A hundred names each, so that a roster seldom draws a pair twice.
GIVEN_NAMES = tuple(
    start + end
    for start in ("Ad", "Bel", "Cor", "Dar", "Ed", "Fal", "Gor", "Han", "Il", "Jon")
    for end in ("a", "an", "en", "ia", "in", "is", "o", "on", "us", "ya")
)
FAMILY_NAMES = tuple(
    start + end
    for start in ("Ash", "Berg", "Cott", "Dahl", "Elm", "Farr", "Gold", "Holm", "Ing", "Kerr")
    for end in ("by", "er", "field", "ford", "ley", "man", "sen", "ton", "well", "wick")
)


def draw(bound: int, seed: int, purpose: str, *key: str) -> Column:
    """An even draw from 0 to ``bound - 1``, fixed by seed, purpose and key."""
    text = F.concat_ws("/", F.lit(str(seed)), F.lit(purpose), *[F.col(k) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % bound


def _pick(names: Sequence[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def synth_roster(
    divisions: DataFrame,
    per_division: int = PLAYERS_PER_DIVISION,
    seed: int = 1,
    given: Sequence[str] = GIVEN_NAMES,
    family: Sequence[str] = FAMILY_NAMES,
) -> DataFrame:
    """Players per division with unique names there; a repeated name gets a suffix."""
    drawn = divisions.select(
        F.col("id").alias("division_id"),
        F.explode(F.sequence(F.lit(1), F.lit(per_division))).alias("n"),
    ).select(
        "division_id",
        "n",
        F.concat_ws(
            " ",
            _pick(given, draw(len(given), seed, "given", "division_id", "n")),
            _pick(family, draw(len(family), seed, "family", "division_id", "n")),
        ).alias("name"),
        (MIN_AGE + draw(MAX_AGE - MIN_AGE + 1, seed, "age", "division_id", "n")).alias("age"),
        (1 + draw(100, seed, "role", "division_id", "n")).alias("roll"),
    )
    nth = F.row_number().over(Window.partitionBy("division_id", "name").orderBy("n"))
    roll = F.col("roll")
    return drawn.withColumn("nth", nth).select(
        "division_id",
        "n",
        F.when(F.col("nth") == 1, F.col("name"))
        .otherwise(F.concat_ws(" ", "name", "n"))
        .alias("name"),
        "age",
        (roll <= PITCHER_SHARE).alias("is_pitcher"),
        ((roll > PITCHER_SHARE) & (roll <= PITCHER_SHARE + CATCHER_SHARE)).alias("is_catcher"),
    )


def _stride(size: int) -> int:
    """A step that visits every residue of ``size`` before it repeats."""
    step = max(1, int(size * 0.618))
    while gcd(step, size) != 1:
        step += 1
    return step


def synth_coaches(
    groups: DataFrame,
    per_group: int = DEMO_COACHES,
    seed: int = 1,
    given: Sequence[str] = GIVEN_NAMES,
    family: Sequence[str] = FAMILY_NAMES,
) -> DataFrame:
    """Coaches with names unique over all groups; ``groups.id`` must be unique.

    From a drawn start, equal steps walk through all pairs of names without
    meeting one twice, so no pool of used names is kept. Each further round
    through the pairs adds its number to the names.
    """
    pairs = len(given) * len(family)
    pair = (draw(pairs, seed, "coach") + F.col("place") % pairs * _stride(pairs)) % pairs
    lap = F.floor(F.col("place") / pairs)
    return (
        groups.select("id", F.explode(F.sequence(F.lit(1), F.lit(per_group))).alias("n"))
        .withColumn("place", F.col("id") * per_group + F.col("n") - 1)
        .withColumn("pair", pair)
        .select(
            F.col("id").alias("group_id"),
            "n",
            F.concat_ws(
                " ",
                _pick(given, F.floor(F.col("pair") / len(family))),
                _pick(family, F.col("pair") % len(family)),
                F.when(lap > 0, (lap + 1).cast("string")),
            ).alias("name"),
            F.lit(False).alias("is_admin"),
        )
    )
