"""Text and JSON inputs, published versions, and the shared folder."""

import json
import time

import pytest
from pyspark.sql import functions as F

from rateline.operators import roster
from rateline.schemas import EVALUATIONS, PLAYERS
from rateline.sources import json_records, roster_text, snapshot, tables, workspace

LINES = [
    "Name, Age, Position, Division",
    "John Smith, 12, Pitcher, Majors",
    "",
    "   ",
    "Jane Doe, , Pitcher/Catcher, aaa",
    "Bob Jones, abc, , Nowhere, more, fields",
    "Short",
    "0, 9, Player, Majors",
    " , 9, Player, Majors",
    "\tTabbed\t,12abc,catcher,Majors\r",
    "Twice, 9, Player, Majors",
    "Twice, 9, Player, Majors",
]


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("roster")
    (folder / "a.txt").write_text("\n".join(LINES), newline="")
    return roster_text.parse_roster(
        roster_text.number_lines(roster_text.read_roster_lines(spark, str(folder)))
    )


@pytest.fixture(scope="module")
def divisions(spark):
    return spark.createDataFrame([(1, "Majors"), (2, "AAA"), (3, "aaa")], "id long, name string")


def test_import_of_hand_typed_lines(spark, parsed, divisions):
    players = spark.createDataFrame([(40, "x", None, None, None, None)], PLAYERS)
    got = roster.roster_import(parsed, players, divisions, default_division_id=9)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [
        (41, "Name", 0, False, False, 9, True),
        (42, "John Smith", 12, True, False, 1, False),
        (43, "Jane Doe", None, True, True, 3, False),
        (44, "Bob Jones", 0, False, False, 9, True),
        (45, "Short", None, False, False, 9, False),
        (46, "Tabbed", 12, False, True, 1, False),
        (47, "Twice", 9, False, False, 1, False),
        (48, "Twice", 9, False, False, 1, False),
    ]


def test_rejects_and_summary(parsed, divisions):
    resolved = roster.resolve_roster(parsed, divisions)
    _, rejected = roster.split_roster(resolved)
    assert sorted((r.name, r.reason) for r in rejected.collect()) == [
        ("", "blank_name"), ("0", "zero_name"),
    ]
    summary = roster.import_summary(resolved).first()
    assert (summary.imported, summary.rejected, summary.unmatched) == (8, 2, 2)
    assert summary.message == "Imported 8 players"
    counted, counter = roster.observed(resolved)
    counted.write.format("noop").mode("overwrite").save()
    assert counter.get == {"imported": 8, "rejected": 2}


def test_header_line_can_be_left_out(parsed):
    lines = parsed.select("line")
    assert roster_text.parse_roster(lines, header=True).count() == parsed.count() - 1


def test_submission_json(spark, tmp_path):
    payloads = [
        {"session_id": 5, "player_id": 7, "skill_index": 0, "score": "7abc", "id": 1, "queued_at": 1000},
        {"session_id": 5, "player_id": 7, "skill_index": 1, "score": 7.9, "id": 2},
        {"session_id": "5x", "player_id": None, "score": 3, "id": 3},
        {"session_id": 5, "player_id": 7, "skill_index": 0, "score": "1e1", "id": 4},
    ]
    lines = [json.dumps(p) for p in payloads] + ['{"session_id": 5,', ""]
    (tmp_path / "q.json").write_text("\n".join(lines))
    rows = json_records.coerce_submissions(
        json_records.read_submission_json(spark, str(tmp_path))
    )
    got = sorted(
        (r.arrival_seq, r.session_id, r.player_id, r.skill_index, r.score, r.malformed, r.scientific)
        for r in rows.collect()
    )
    assert got == [
        (0, 0, 0, -1, 0, True, False),
        (1, 5, 7, 0, 7, False, False),
        (2, 5, 7, 1, 7, False, False),
        (3, 5, 0, -1, 3, False, False),
        (4, 5, 7, 0, 1, False, True),
    ]


def test_import_json(spark, tmp_path):
    requests = [
        {
            "players": [
                {"name": " Ann ", "age": "", "is_pitcher": 1, "is_catcher": "0", "division_id": 0},
                {"name": "0", "age": 3},
                {"name": "Bo", "age": "x", "is_pitcher": True, "is_catcher": None},
            ],
            "default_division_id": 4,
        },
        {"players": [], "default_division_id": 4},
    ]
    (tmp_path / "i.json").write_text("\n".join([*map(json.dumps, requests), "{broken"]))
    players = spark.createDataFrame([], PLAYERS)
    got = roster.import_players(json_records.read_import_json(spark, str(tmp_path)), players, ["name"])
    assert [tuple(r) for r in got.orderBy("id").collect()] == [
        (1, "Ann", None, True, False, None), (2, "Bo", 0, True, False, 4),
    ]


def test_json_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert json_records.as_json(df).first().record == '{"a":1,"b":null}'
    json_records.write_json(df, str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out")).first().value
    assert json.loads(text) == {"a": 1, "b": None}


def test_published_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    first, second = spark.range(3), spark.range(5)
    workspace.publish(first, root, 1)
    workspace.publish(second, root, 2)
    second.write.parquet(f"{root}/v=3")
    assert workspace.current_version(spark, root) == 2
    assert workspace.read_published(spark, root, first.schema).count() == 5
    held = workspace.read_published(spark, root, first.schema)
    workspace.publish(first, root, 2)
    assert held.count() == 5  # a replay leaves the files of earlier readers alone
    workspace.publish(second, root, 2)
    assert workspace.read_published(spark, root, first.schema, 1).count() == 3
    with pytest.raises(ValueError):
        workspace.read_published(spark, root, first.schema, 3)
    assert workspace.read_published(spark, root, first.schema).count() == 5


def test_snapshot_holds_active_sessions_only(spark, tmp_path):
    sessions = spark.createDataFrame([(1, 1, True), (2, 1, False)], "id long, division_id long, active boolean")
    players = spark.createDataFrame([(7, "a", 9, True, True, 1), (8, "b", 9, True, True, 2)], PLAYERS)
    scores = spark.createDataFrame([(1, 7, 3, 0, "x", 5, None), (2, 7, 3, 0, "x", 6, None)], EVALUATIONS)
    snapshot.save_snapshot(snapshot.field_snapshot(sessions, players, scores), str(tmp_path / "s"), 1)
    loaded = snapshot.load_snapshot(spark, str(tmp_path / "s"))
    assert [tuple(r) for r in loaded.collect()] == [(7, "007", "a", "Pitcher/Catcher", 3, 0, 5, 1)]


def test_written_evaluations_skip_other_sessions(spark, tmp_path):
    scores = spark.range(100).select(
        (F.col("id") % 4).alias("session_id"), F.col("id").alias("player_id"),
        F.lit(1).cast("long").alias("coach_id"), F.lit(0).alias("skill_index"),
        F.lit("Running").alias("skill_name"), F.lit(5).alias("score"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )
    tables.write_evaluations(scores, str(tmp_path / "e"))
    read = tables.read_table(spark, str(tmp_path / "e"), EVALUATIONS).filter("session_id = 3")
    assert read.count() == 25
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(session_id,3)" in plan


def test_files_of_evaluations_hold_ranges_of_sessions(spark, tmp_path):
    scores = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") % 1000).cast("long").alias("session_id"),
        F.col("id").alias("player_id"),
        F.lit(1).cast("long").alias("coach_id"), F.lit(0).alias("skill_index"),
        F.lit("Running").alias("skill_name"), F.lit(5).alias("score"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_evaluations(scores, str(tmp_path / "e"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = tables.read_table(spark, str(tmp_path / "e"), EVALUATIONS)
    named = read.select("session_id", F.input_file_name().alias("file"))
    files = named.groupBy("session_id").agg(F.count_distinct("file").alias("n"))
    found = {r.session_id: r.n for r in files.collect()}
    assert read.count() == 40_000
    assert found[500] > 1, "a popular session is written by several tasks"
    others = [n for session, n in found.items() if session != 500]
    assert sum(others) <= len(others) + 8, "others are in one file, but for those on an edge"


def test_cluster_without_shared_folder_is_refused():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        workspace.shared_folder(Session())


def test_a_step_leaves_no_shuffle_files(spark):
    """The setting is the session's own again afterwards."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if "shuffle" in files.apply(i).getName()}

    before = shuffled()
    step = workspace.materialize(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.monotonic() + 10
    while shuffled() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not shuffled() - before
    assert step.count() == 7 and spark.conf.get(workspace.CLEANUP) == "false"
