"""Hand-written cases, one per rule."""

import pytest
from pyspark.sql import functions as F

from rateline.functions import scoring, text
from rateline.operators.quality import rejected_submissions, submission_faults, valid_submissions


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    picked = rows.orderBy("i").select(expression(F.col("c")).alias("x"))
    return [r.x for r in picked.collect()]


def test_leading_int(spark):
    values = ["7", "7abc", " -3x", "7.9", "abc", "", "+4", "99999999999999999999", None]
    got = column(spark, values, "string", text.leading_int)
    assert got == [7, 7, -3, 7, 0, 0, 4, 9223372036854775807, 0]


def test_optional_int(spark):
    assert column(spark, [None, "", "abc", "12abc", "0"], "string", text.optional_int) == [
        None, None, 0, 12, 0,
    ]


def test_truthy(spark):
    values = [None, "", "0", "false", "1", "true", "no"]
    assert column(spark, values, "string", text.truthy) == [False] * 4 + [True] * 3


def test_trimming(spark):
    assert column(spark, ["\t a \x00\x0b", " b "], "string", text.trim_server) == [
        "a", " b ",
    ]
    assert column(spark, ["  b﻿\r"], "string", text.trim_client) == ["b"]


def test_valid_name(spark):
    values = [None, "", "  ", "0", " 0 ", "00", "Ann"]
    assert column(spark, values, "string", text.valid_name) == [False] * 5 + [True] * 2


def test_skill_name(spark):
    assert column(spark, [0, 3, 4, -1, 2147483647], "int", scoring.skill_name) == [
        "Running", "Hitting", "Unknown", "Unknown", "Unknown",
    ]


def test_display_number_never_truncates(spark):
    assert column(spark, [7, 42, 1234], "long", scoring.display_number) == ["007", "042", "1234"]


@pytest.mark.parametrize(
    "total, n, e4, tenths",
    [(1, 3, 3333, 0.3), (2, 3, 6667, 0.7), (29, 4, 72500, 7.3), (147, 20, 73500, 7.4), (9, 1, 90000, 9.0)],
)
def test_averages_round_half_up(spark, total, n, e4, tenths):
    row = spark.range(1).select(
        scoring.average_e4(F.lit(total).cast("long"), F.lit(n).cast("long")).alias("e4")
    ).select("e4", scoring.e4_to_tenths(F.col("e4")).alias("t")).first()
    assert (row.e4, row.t) == (e4, tenths)


def test_band_of_exact_and_rounded_score(spark):
    bands = column(spark, [7.96, 8.0, 6.0, 5.99, 4.0, 3.9, None], "double", scoring.score_band)
    assert bands == ["mid", "high", "mid", "low", "low", "poor", None]
    rounded = column(spark, [79600], "long", scoring.e4_to_tenths)
    assert rounded == [8.0]


def test_subtitle_and_position(spark):
    rows = spark.createDataFrame(
        [(1, True, True, 9), (2, False, False, 9), (3, True, False, None), (4, False, False, 0)],
        "i int, p boolean, c boolean, age long",
    )
    position = scoring.position_label(F.col("p"), F.col("c"))
    got = rows.orderBy("i").select(
        scoring.subtitle(position, F.col("age")).alias("s"),
        scoring.position_code(position).alias("code"),
    )
    assert [tuple(r) for r in got.collect()] == [
        ("Pitcher/Catcher, Age 9", "pos-PitcherCatcher"),
        ("Age 9", "pos-Player"),
        ("Pitcher", "pos-Pitcher"),
        ("", "pos-Player"),
    ]


def test_medals(spark):
    assert column(spark, [1, 2, 3, 4], "long", scoring.medal) == ["gold", "silver", "bronze", None]


def test_submission_rules(spark):
    rows = spark.createDataFrame(
        [
            (1, 1, 0, 1), (1, 1, 0, 10), (1, 1, 4, 5), (0, 1, 0, 5), (1, 0, 0, 5),
            (1, 1, -1, 5), (1, 1, 0, 0), (1, 1, 0, 11), (None, 1, None, None),
        ],
        "session_id long, player_id long, skill_index int, score int",
    )
    assert valid_submissions(rows).count() == 3
    reasons = [r.reasons for r in rejected_submissions(rows).collect()]
    assert sorted(reasons) == sorted(
        ["missing_session", "missing_player", "bad_skill_index", "bad_score", "bad_score",
         "missing_session,bad_skill_index,bad_score"]
    )
    accepted = rows.filter(F.size(submission_faults(rows.columns)) == 0)
    assert accepted.exceptAll(valid_submissions(rows)).count() == 0
