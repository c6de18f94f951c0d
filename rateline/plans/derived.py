"""Loosely typed inputs (roster lines, JSON payloads) derived from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateline.sources.star import StarTables


def _case(key: Column, cases: dict[int, str | Column], otherwise: Column, modulus: int) -> Column:
    chain = otherwise
    for remainder, value in cases.items():
        value = F.lit(value) if isinstance(value, str) else value
        chain = F.when(key % modulus == remainder, value).otherwise(chain)
    return chain


def roster_lines(tables: StarTables) -> DataFrame:
    """One roster line per customer, in the shapes hand-typed lines come in."""
    key, name = F.col("c_custkey"), F.col("c_name")
    field_name = _case(key, {0: "", 1: "0", 2: F.concat(F.lit("  "), name, F.lit(" \t"))}, name, 50)
    age = (8 + key % 7).cast("string")
    field_age = _case(key, {0: "", 1: "abc", 2: F.concat(age, F.lit("yrs"))}, age, 9)
    segment = F.col("c_mktsegment")
    role = (
        F.when(segment == "BUILDING", " Pitcher")
        .when(segment == "MACHINERY", "pitcher/CATCHER ")
        .when(segment == "HOUSEHOLD", "Catcher")
        .when(segment == "FURNITURE", "Player")
        .otherwise("")
    )
    nation = F.col("n_name")
    division = _case(key, {0: F.lower(nation), 1: "Unlisted", 2: ""}, nation, 6)
    full = F.concat_ws(",", field_name, field_age, role, division)
    line = (
        F.when(key % 97 == 5, "  \t ")
        .when(key % 13 == 0, field_name)
        .when(key % 17 == 0, F.concat(full, F.lit(", extra, fields")))
        .when(key % 29 == 0, F.concat(full, F.lit("\r")))
        .otherwise(full)
    )
    customer, nations = tables.raw("customer"), tables.raw("nation")
    return customer.join(nations, customer.c_nationkey == nations.n_nationkey).select(
        "c_custkey", line.alias("line")
    )


def write_roster_lines(tables: StarTables, folder: str, files: int) -> None:
    (
        roster_lines(tables)
        .repartitionByRange(files, "c_custkey")
        .sortWithinPartitions("c_custkey")
        .select("line")
        .write.option("lineSep", "\n")
        .text(folder)
    )


def submission_payloads(tables: StarTables) -> DataFrame:
    """One JSON payload per event: numbers, numeric text, gaps, broken lines."""
    key = F.col("event_id")
    number = F.col("value").cast("string")
    score = _case(
        key,
        {
            0: F.concat(F.lit('"'), F.floor("value").cast("string"), F.lit('abc"')),
            2: "null",
            3: '"1e1"',
        },
        number,
        11,
    )
    skill = F.get_json_object("props", "$.k").cast("bigint") % 7 - 1
    body = F.concat(
        F.lit('{"id": '),
        key.cast("string"),
        F.lit(', "session_id": '),
        F.date_format("ts", "yyyyMMdd"),
        F.lit(', "player_id": '),
        F.when(key % 37 == 0, "0").otherwise((F.col("user_id") + 1).cast("string")),
        F.when(key % 41 == 0, "").otherwise(
            F.concat(F.lit(', "skill_index": '), skill.cast("string"))
        ),
        F.lit(', "score": '),
        score,
        F.lit(', "queued_at": '),
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string"),
        F.lit("}"),
    )
    broken = F.concat(F.lit('{"id": '), key.cast("string"), F.lit(', "session_id": '))
    return tables.raw("events").select(F.when(key % 23 == 0, broken).otherwise(body).alias("line"))


def player_changes(tables: StarTables) -> DataFrame:
    """An update per customer in debt: renamed, a year older, without division."""
    return (
        tables.players()
        .join(
            tables.raw("customer")
            .filter(F.col("c_acctbal") < 0)
            .select((F.col("c_custkey") + 1).alias("id")),
            "id",
            "left_semi",
        )
        .select(
            "id",
            F.when(F.col("id") % 10 == 3, "  ")
            .otherwise(F.concat(F.lit(" "), F.upper("name"), F.lit(" ")))
            .alias("name"),
            (F.col("age") + 1).alias("age"),
            (~F.col("is_pitcher")).alias("is_pitcher"),
            "is_catcher",
            F.lit(None).cast("bigint").alias("division_id"),
            F.col("id").alias("seq"),
        )
    )


def player_update_payloads(tables: StarTables) -> DataFrame:
    """JSON update requests of customers in debt: numbers, numeric text, gaps, broken lines.

    Every fourth of them is asked for once more, later.
    """
    key, name = F.col("c_custkey"), F.upper("c_name")
    number = (key + 1).cast("string")
    quoted = lambda c, tail="": F.concat(F.lit('"'), c, F.lit(f'{tail}"'))
    fields = {
        "seq": key.cast("string"),
        "id": F.when(key % 23 == 1, quoted(number, "x")).when(key % 29 == 2, "0").when(
            key % 5 == 0, quoted(number)
        ).otherwise(number),
        "name": _case(key, {2: '"  "', 3: '"0"'}, quoted(F.concat(F.lit(" "), name), " "), 10),
        "age": _case(
            key, {0: '""', 1: "null", 2: '"abc"', 3: '"9yrs"', 4: '"1e1"'}, (8 + key % 7).cast("string"), 7
        ),
        "is_pitcher": _case(key, {0: "0", 1: '"0"'}, F.lit("true"), 3),
        "is_catcher": _case(key, {0: "false", 1: "1", 2: "null"}, F.lit('""'), 4),
        "division_id": _case(key, {0: "null", 1: '"0"', 2: "0"}, (key % 24 + 1).cast("string"), 6),
    }
    again = {
        "seq": (key + (1 << 40)).cast("string"),
        "id": number,
        "name": quoted(name, " II"),
        "division_id": F.lit("1"),
    }

    def line(of: dict[str, Column]) -> Column:
        return F.concat(
            F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), c) for n, c in of.items()]), F.lit("}")
        )

    first = F.when(key % 37 == 5, F.lit('{"id": 4,')).otherwise(line(fields))
    lines = F.array_compact(F.array(first, F.when(key % 4 == 0, line(again))))
    return tables.raw("customer").filter(F.col("c_acctbal") < 0).select(F.explode(lines).alias("line"))


def affiliates(tables: StarTables) -> tuple[DataFrame, DataFrame]:
    """Regions as further divisions without sessions, suppliers as their players."""
    divisions = tables.raw("region").select(
        (F.col("r_regionkey") + 101).cast("bigint").alias("id"), F.col("r_name").alias("name")
    )
    supplier, nation = tables.raw("supplier"), tables.raw("nation")
    players = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        (F.col("s_suppkey") + (1 << 40)).alias("id"),
        F.col("s_name").alias("name"),
        F.lit(None).cast("bigint").alias("age"),
        F.lit(False).alias("is_pitcher"),
        F.lit(False).alias("is_catcher"),
        (F.col("n_regionkey") + 101).cast("bigint").alias("division_id"),
    )
    return divisions, players


def session_ends(tables: StarTables) -> DataFrame:
    """An end command for every day of the event stream, at its last queue time."""
    return (
        tables.stream_submissions()
        .groupBy("session_id")
        .agg(F.max("queued_at").alias("ts"))
        .select(
            F.lit(1).cast("bigint").alias("lane"),
            F.col("session_id").alias("seq"),
            "ts",
            F.lit("end").alias("command"),
            F.lit(None).cast("bigint").alias("division_id"),
            "session_id",
        )
    )
