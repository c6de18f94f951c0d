"""Skills, averages, rounding, bands and player labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Skill names in index order, and the name of any other index.
SKILLS = ("Running", "Fielding", "Pitching", "Hitting")
UNKNOWN_SKILL = "Unknown"

# Score limits and band thresholds.
MIN_SCORE, MAX_SCORE = 1, 10
BANDS = ((8, "high"), (6, "mid"), (4, "low"))
LOWEST_BAND = "poor"

MEDALS = ("gold", "silver", "bronze")


def whole_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def skill_array() -> Column:
    return F.array(*[F.lit(name) for name in SKILLS])


def skill_name(index: Column) -> Column:
    return F.coalesce(F.get(skill_array(), index), F.lit(UNKNOWN_SKILL))


def average_e4(total: Column, n: Column) -> Column:
    """Mean in ten-thousandths, half up, on integers only."""
    return whole_div(total * 20000 + n, n * 2)


def e4_to_double(e4: Column) -> Column:
    return e4 / F.lit(10000.0)


def e4_to_tenths(e4: Column) -> Column:
    """A mean in ten-thousandths rounded half up to one decimal."""
    return whole_div(e4 + 500, F.lit(1000)) / F.lit(10.0)


def overall(sum_e4: Column, skills: Column) -> Column:
    """Unweighted mean of the skill means."""
    return sum_e4 / (skills * F.lit(10000.0))


def overall_tenths(sum_e4: Column, skills: Column) -> Column:
    return whole_div(sum_e4 * 2 + skills * 1000, skills * 2000) / F.lit(10.0)


def score_band(score: Column) -> Column:
    band = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, label in BANDS:
        band = band.when(score >= least, label)
    return band.otherwise(LOWEST_BAND)


def position_label(is_pitcher: Column, is_catcher: Column) -> Column:
    return (
        F.when(is_pitcher & is_catcher, "Pitcher/Catcher")
        .when(is_pitcher, "Pitcher")
        .when(is_catcher, "Catcher")
        .otherwise("Player")
    )


def position_code(position: Column) -> Column:
    return F.concat(F.lit("pos-"), F.replace(position, F.lit("/"), F.lit("")))


def display_number(player_id: Column) -> Column:
    """At least three digits; a longer id is kept whole."""
    return F.format_string("%03d", player_id)


def subtitle(position: Column, age: Column, separator: str = ", ") -> Column:
    return F.concat_ws(
        separator,
        F.when(position != "Player", position),
        F.when(age != 0, F.concat(F.lit("Age "), age.cast("string"))),
    )


def medal(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MEDALS]), (rank - 1).cast("int"))
