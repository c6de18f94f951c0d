"""The named queries: each takes a session and a table folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rateline.functions.scoring import skill_name
from rateline.operators import (
    coverage,
    latest,
    maintenance,
    quality,
    results,
    roster,
    search_index,
    synth,
)
from rateline.operators import sessions as sessions_ops
from rateline.plans import derived
from rateline.plans.parameters import (
    COACH,
    DEFAULT_DIVISION,
    DIVISION,
    KEYED_BUCKETS,
    PENDING_FROM,
    PLAYER_LETTERS,
    PLAYER_NUMBER,
    PLAYER_QUERY,
    SESSION,
    SKILL,
)
from rateline.schemas import EVALUATION_KEY, PAYLOADS
from rateline.sources import changes, keyed
from rateline.sources.json_records import (
    as_json,
    coerce_submissions,
    read_submission_json,
    read_update_json,
)
from rateline.sources.roster_text import number_lines, parse_roster, read_roster_lines
from rateline.sources.snapshot import SNAPSHOT, SNAPSHOT_KEY, load_snapshot, save_snapshot
from rateline.sources.snapshot import field_snapshot as take_snapshot
from rateline.sources.star import StarTables
from rateline.sources.workspace import materialize, new_folder
from rateline.streaming import keyed_state, lanes, overlay
from rateline.streaming import sessions as session_stream
from rateline.streaming import submissions as submission_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[StarTables], DataFrame]) -> Callable[[StarTables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(StarTables(spark, folder))
    return build


def _evaluations(t: StarTables) -> DataFrame:
    return latest.latest_evaluations(t.submissions())


def _results(t: StarTables, **options) -> DataFrame:
    return results.results(_evaluations(t), t.players(), t.divisions(), **options)


def _history(t: StarTables) -> DataFrame:
    return sessions_ops.session_history(t.session_starts())


def _sessions(t: StarTables) -> DataFrame:
    return sessions_ops.session_cursors(_history(t), t.session_advances())


def _session_divisions(t: StarTables) -> DataFrame:
    """Written down, so that its size is known when it is joined."""
    return materialize(t.session_divisions(), "sessions")


def _scored_sessions(t: StarTables) -> DataFrame:
    """Sessions somebody was scored in, with their division."""
    scored = t.session_starts().select(F.col("session_id").alias("id"), "division_id")
    return materialize(scored, "sessions")


# --- submissions and evaluations -------------------------------------------------


@query
def submissions_valid(t: StarTables) -> DataFrame:
    return quality.valid_submissions(t.submissions())


@query
def submissions_rejected(t: StarTables) -> DataFrame:
    return quality.rejected_submissions(t.submissions())


@query
def evaluations_latest(t: StarTables) -> DataFrame:
    return _evaluations(t)


@query
def evaluations_upsert(t: StarTables) -> DataFrame:
    """Two batches in the wrong order, the first of them twice."""
    one, two = _halves(t.submissions())
    stored = latest.latest_evaluations(one, keep_order=True)
    return latest.upsert_evaluations(latest.upsert_evaluations(stored, two), one)


@query
def evaluations_upsert_keyed(t: StarTables) -> DataFrame:
    """The same batches onto versions bucketed by key, which are not shuffled again."""
    one, two = _halves(t.submissions())
    folder = new_folder(t.spark, "keyed")
    first = latest.latest_evaluations(one, keep_order=True)
    keyed.publish_keyed(first, folder, 1, KEYED_BUCKETS)
    keyed.upsert_keyed(two, folder, 2)
    keyed.upsert_keyed(one, folder, 3)
    return keyed.read_keyed(t.spark, folder)


def _halves(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows in two batches that share keys, each with earlier and later arrivals."""
    first = F.xxhash64("arrival_seq") >= 0
    return submissions.filter(first), submissions.filter(~first)


@query
def evaluations_latest_queued(t: StarTables) -> DataFrame:
    return latest.latest_queued(t.submissions())


def _json_rows(t: StarTables) -> DataFrame:
    folder = new_folder(t.spark, "payloads")
    derived.submission_payloads(t).write.text(folder)
    return coerce_submissions(read_submission_json(t.spark, folder))


@query
def evaluations_from_json(t: StarTables) -> DataFrame:
    return latest.latest_evaluations(_json_rows(t))


@query
def submissions_from_json(t: StarTables) -> DataFrame:
    rows = _json_rows(t)
    faults = quality.submission_faults(rows.columns)
    return rows.select(
        "arrival_seq",
        "session_id",
        "player_id",
        "skill_index",
        "score",
        "queued_at",
        F.concat_ws(",", faults).alias("reasons"),
    )


@query
def my_all_scores(t: StarTables) -> DataFrame:
    mine = results.visible_evaluations(_evaluations(t), COACH, SESSION)
    return mine.select("skill_index", "player_id", "score")


@query
def review_list(t: StarTables) -> DataFrame:
    return coverage.review_list(_evaluations(t), t.players(), _session_divisions(t), SESSION, COACH)


@query
def my_skill_scores(t: StarTables) -> DataFrame:
    mine = results.visible_evaluations(_evaluations(t), COACH, SESSION)
    return mine.filter(F.col("skill_index") == SKILL).select("player_id").distinct()


@query
def my_score_lookup(t: StarTables) -> DataFrame:
    """For every submitted key, valid or not: is there a score, and which."""
    keys = t.submissions().select(*EVALUATION_KEY).distinct()
    stored = _evaluations(t).select(*EVALUATION_KEY, "score")
    return keys.join(stored, EVALUATION_KEY, "left").select(
        *EVALUATION_KEY, F.col("score").isNotNull().alias("scored"), "score"
    )


@query
def my_score_lookup_keyed(t: StarTables) -> DataFrame:
    """The lookup on a version bucketed by key: only the keys asked for are shuffled."""
    folder = new_folder(t.spark, "keyed")
    scores = latest.latest_evaluations(t.submissions(), keep_order=True)
    keyed.publish_keyed(scores, folder, 1, KEYED_BUCKETS)
    keys = t.submissions().select(*EVALUATION_KEY).distinct()
    stored = keyed.read_keyed(t.spark, folder).select(*EVALUATION_KEY, "score")
    return stored.join(keys, EVALUATION_KEY, "right").select(
        *EVALUATION_KEY, F.col("score").isNotNull().alias("scored"), "score"
    )


@query
def skill_labels(t: StarTables) -> DataFrame:
    name = skill_name(F.col("skill_index"))
    return (
        t.submissions()
        .groupBy("skill_index")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("skill_index", name.alias("skill_name"), F.upper(name).alias("label"), "n")
    )


def _pending(t: StarTables) -> DataFrame:
    queued = t.submissions().filter(F.col("queued_at") >= F.lit(PENDING_FROM).cast("timestamp_ntz"))
    return quality.valid_submissions(queued)


@query
def pending_overlay(t: StarTables) -> DataFrame:
    sent = t.submissions().filter(F.col("queued_at") < F.lit(PENDING_FROM).cast("timestamp_ntz"))
    return latest.pending_overlay(latest.latest_evaluations(sent), _pending(t))


@query
def pending_counts(t: StarTables) -> DataFrame:
    return latest.pending_counts(_pending(t))


# --- results ---------------------------------------------------------------------


@query
def results_admin(t: StarTables) -> DataFrame:
    return _results(t)


@query
def results_ordered(t: StarTables) -> DataFrame:
    return results.ordered_results(_results(t))


@query
def results_coach(t: StarTables) -> DataFrame:
    return _results(t, viewer_coach_id=COACH)


@query
def results_division(t: StarTables) -> DataFrame:
    return _results(t, division_id=DIVISION)


@query
def results_json(t: StarTables) -> DataFrame:
    whole, rest = F.floor(F.col("avg_e4") / 10000), F.col("avg_e4") % 10000
    rows = _results(t).select(
        "player_id",
        "player_name",
        "age",
        "position",
        "division_id",
        "division_name",
        "skill_index",
        "skill_name",
        F.format_string("%d.%04d", whole, rest).alias("avg_score"),
        "eval_count",
    )
    return as_json(rows, keep=("player_id", "skill_index"))


@query
def results_wide(t: StarTables) -> DataFrame:
    return results.results_wide(_results(t))


@query
def score_bands(t: StarTables) -> DataFrame:
    return results.score_bands(_results(t))


@query
def player_overall(t: StarTables) -> DataFrame:
    return results.player_overall(_results(t))


@query
def leaderboard(t: StarTables) -> DataFrame:
    return results.leaderboard(results.player_overall(_results(t)))


@query
def leaderboard_by_division(t: StarTables) -> DataFrame:
    return results.leaderboard(results.player_overall(_results(t)), by_division=True)


@query
def podium(t: StarTables) -> DataFrame:
    return results.podium(results.player_overall(_results(t)))


@query
def podium_by_division(t: StarTables) -> DataFrame:
    return results.podium_by_division(results.player_overall(_results(t)))


@query
def session_progress(t: StarTables) -> DataFrame:
    return results.session_progress(_evaluations(t))


@query
def progress_grid(t: StarTables) -> DataFrame:
    return results.progress_grid(_evaluations(t), t.players(), _scored_sessions(t))


@query
def progress_grid_session(t: StarTables) -> DataFrame:
    return results.progress_grid(_evaluations(t), t.players(), _scored_sessions(t), SESSION)


@query
def progress_grid_scored(t: StarTables) -> DataFrame:
    """The grid without the players nobody has scored."""
    return results.progress_grid(_evaluations(t), t.players(), _scored_sessions(t), scored_only=True)


@query
def scores_as_map(t: StarTables) -> DataFrame:
    maps = results.scores_as_map(_evaluations(t))
    return maps.withColumn("scores", F.to_json("scores"))


@query
def scores_unpivot(t: StarTables) -> DataFrame:
    return results.scores_from_map(results.scores_as_map(_evaluations(t)))


# --- coverage --------------------------------------------------------------------


@query
def roster_positions(t: StarTables) -> DataFrame:
    return coverage.roster_positions(t.players())


@query
def roster_neighbours(t: StarTables) -> DataFrame:
    mine = results.visible_evaluations(_evaluations(t), COACH, SESSION).filter(
        F.col("skill_index") == SKILL
    )
    return coverage.neighbour_scores(coverage.roster_neighbours(t.players()), mine)


@query
def first_unscored(t: StarTables) -> DataFrame:
    positions = coverage.roster_positions(t.players())
    return coverage.first_unscored(_evaluations(t), positions, _session_divisions(t))


@query
def unscored_players(t: StarTables) -> DataFrame:
    return coverage.unscored_players(
        _evaluations(t), t.players(), _session_divisions(t), SESSION, COACH, SKILL
    )


@query
def remaining_counts(t: StarTables) -> DataFrame:
    return coverage.remaining_counts(_evaluations(t), t.players(), _session_divisions(t))


def _coverage(t: StarTables) -> DataFrame:
    return coverage.skill_coverage(_evaluations(t), t.players(), _session_divisions(t))


@query
def skill_coverage(t: StarTables) -> DataFrame:
    return _coverage(t)


@query
def session_complete(t: StarTables) -> DataFrame:
    return coverage.session_complete(_coverage(t))


@query
def next_unfinished_skill(t: StarTables) -> DataFrame:
    return coverage.next_unfinished_skill(_coverage(t))


# --- lists -----------------------------------------------------------------------


@query
def player_positions(t: StarTables) -> DataFrame:
    return roster.player_positions(t.players())


@query
def player_list(t: StarTables) -> DataFrame:
    return roster.numbered_players(t.players(), t.divisions())


@query
def player_list_division(t: StarTables) -> DataFrame:
    return roster.numbered_players(t.players(), t.divisions(), DIVISION)


@query
def player_search(t: StarTables) -> DataFrame:
    return roster.player_search(t.players(), PLAYER_QUERY)


@query
def player_search_scored(t: StarTables) -> DataFrame:
    """The matches, each with a mark if the coach has scored it in this session for this skill."""
    mine = results.visible_evaluations(_evaluations(t), COACH, SESSION).filter(F.col("skill_index") == SKILL)
    return roster.player_search(t.players(), PLAYER_QUERY, SESSION % 100, scored=mine)


@query
def player_search_number(t: StarTables) -> DataFrame:
    """A shown number, which finds a player whose name does not have it."""
    return roster.player_search(t.players(), PLAYER_NUMBER)


def _search_index(t: StarTables) -> str:
    folder = new_folder(t.spark, "search-index")
    search_index.save_index(t.players(), folder, version=1)
    return folder


@query
def player_search_indexed(t: StarTables) -> DataFrame:
    return search_index.search(t.spark, _search_index(t), PLAYER_QUERY)


@query
def player_search_letters(t: StarTables) -> DataFrame:
    """Every match of a text shorter than the pieces of the index."""
    return search_index.matches(t.spark, _search_index(t), PLAYER_LETTERS)


@query
def division_counts(t: StarTables) -> DataFrame:
    return roster.division_counts(t.divisions(), t.players())


@query
def coach_list(t: StarTables) -> DataFrame:
    return roster.coach_list(t.coaches())


@query
def coach_by_name(t: StarTables) -> DataFrame:
    """Look up every customer-numbered supplier name, typed in capitals."""
    typed = F.concat(F.lit(" "), F.upper(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))))
    return roster.coach_by_name(t.coaches(), t.raw("customer").select(typed.alias("name")))


# --- roster import ---------------------------------------------------------------


def _parsed_lines(t: StarTables, numbered: bool = False) -> DataFrame:
    folder = new_folder(t.spark, "roster")
    derived.write_roster_lines(t, folder, files=_files(t))
    lines = read_roster_lines(t.spark, folder)
    return parse_roster(number_lines(lines) if numbered else lines)


def _resolved(t: StarTables) -> DataFrame:
    return roster.resolve_roster(_parsed_lines(t), t.divisions(), DEFAULT_DIVISION)


@query
def roster_parse(t: StarTables) -> DataFrame:
    return _parsed_lines(t).select("name", "age_text", "position_text", "division_text")


@query
def roster_rejects(t: StarTables) -> DataFrame:
    _, rejected = roster.split_roster(_resolved(t))
    return rejected.select("name", "age", "division_id", "reason")


@query
def roster_import(t: StarTables) -> DataFrame:
    parsed = _parsed_lines(t, numbered=True)
    return roster.roster_import(parsed, t.players(), t.divisions(), DEFAULT_DIVISION)


@query
def import_summary(t: StarTables) -> DataFrame:
    return roster.import_summary(_resolved(t))


# --- sessions --------------------------------------------------------------------


@query
def session_history(t: StarTables) -> DataFrame:
    return _history(t).select("id", "division_id", "started_at", "ended_at", "active")


@query
def session_history_by_league(t: StarTables) -> DataFrame:
    history = sessions_ops.session_history(t.league_commands())
    return history.select("lane", "id", "division_id", "started_at", "ended_at", "active")


@query
def session_cursor(t: StarTables) -> DataFrame:
    return _sessions(t).drop("lane")


@query
def active_session(t: StarTables) -> DataFrame:
    return sessions_ops.active_session(_sessions(t), t.divisions())


@query
def field_snapshot(t: StarTables) -> DataFrame:
    active = _history(t).filter("active")
    folder = new_folder(t.spark, "snapshot")
    save_snapshot(take_snapshot(active, t.players(), _evaluations(t)), folder, version=1)
    return load_snapshot(t.spark, folder)


def _snapshots(t: StarTables) -> list[DataFrame]:
    """Three snapshots of the active sessions: by some of the scores, by the others, by all."""
    active = materialize(_history(t).filter("active"), "active")
    some = F.shiftright("arrival_seq", 4) % 2 == 0
    batches = (t.submissions().filter(some), t.submissions().filter(~some), t.submissions())
    return [take_snapshot(active, t.players(), latest.latest_evaluations(b)) for b in batches]


@query
def field_snapshot_chain(t: StarTables) -> DataFrame:
    """The third version, read from a full copy and two change sets."""
    folder = new_folder(t.spark, "snapshot-chain")
    for version, table in enumerate(_snapshots(t), 1):
        changes.save_version(table, folder, version, SNAPSHOT_KEY, partition_by=("session_id",))
    return changes.read_version(t.spark, folder, SNAPSHOT, SNAPSHOT_KEY)


@query
def snapshot_changes(t: StarTables) -> DataFrame:
    """What is added, changed and gone from the second snapshot to the third, and back to the first."""
    one, two, three = _snapshots(t)
    steps = [("2-3", two, three), ("3-1", three, one)]
    found = [changes.change_set(a, b, SNAPSHOT_KEY).withColumn("step", F.lit(n)) for n, a, b in steps]
    return reduce(DataFrame.union, found).withColumnRenamed(changes.OP, "op")


# --- maintenance -----------------------------------------------------------------


@query
def append_with_ids(t: StarTables) -> DataFrame:
    new = t.raw("supplier").select(
        F.when(F.col("s_suppkey") % 9 == 4, " 0 ")
        .otherwise(F.concat(F.lit("\t"), "s_name", F.lit(" ")))
        .alias("name"),
        "s_suppkey",
    )
    return roster.create_named(t.players(), new, ["s_suppkey"]).select("id", "name")


@query
def insert_if_absent(t: StarTables) -> DataFrame:
    """Demo, nation and region names against the divisions there are."""
    seeds = t.spark.createDataFrame(
        [(i, n) for i, n in enumerate(synth.DEMO_DIVISIONS)], "seq long, name string"
    )
    nations = t.raw("nation").select(
        (F.col("n_nationkey") + 100).cast("bigint").alias("seq"), F.lower("n_name").alias("name")
    )
    regions = t.raw("region").select(
        (F.col("r_regionkey") + 1000).cast("bigint").alias("seq"), F.col("r_name").alias("name")
    )
    candidates = seeds.unionByName(nations).unionByName(regions)
    return roster.insert_if_absent(t.divisions(), candidates, ["seq"])


@query
def apply_player_updates(t: StarTables) -> DataFrame:
    return maintenance.apply_player_updates(t.players(), derived.player_changes(t), "seq")


def _update_requests(t: StarTables) -> DataFrame:
    folder = new_folder(t.spark, "updates")
    derived.player_update_payloads(t).write.text(folder)
    return read_update_json(t.spark, folder)


@query
def player_updates_from_json(t: StarTables) -> DataFrame:
    """Players after loosely typed requests; the last request taken counts."""
    return maintenance.apply_player_updates(t.players(), _update_requests(t), "seq")


@query
def player_update_rejects(t: StarTables) -> DataFrame:
    requests = _update_requests(t)
    refused = requests.withColumn("reason", maintenance.update_fault(requests.columns))
    return refused.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("requests"))


@query
def delete_divisions(t: StarTables) -> DataFrame:
    """Ask for every division to go; those with sessions stay."""
    more_divisions, more_players = derived.affiliates(t)
    divisions = t.divisions().unionByName(more_divisions)
    players = t.players().unionByName(more_players)
    left, released = maintenance.delete_divisions(
        divisions, players, _scored_sessions(t), divisions
    )
    kept = left.select(F.lit("division").alias("kind"), "id", F.col("id").alias("division_id"))
    return kept.unionByName(released.select(F.lit("player").alias("kind"), "id", "division_id"))


@query
def delete_restricted(t: StarTables) -> DataFrame:
    """Ask for every player and coach, and one id past each, to go."""
    evaluations = _evaluations(t)

    def outcomes(kind: str, table: DataFrame, key: str, **options) -> DataFrame:
        requested = table.select("id").union(table.select(F.col("id") + 1))
        return maintenance.delete_outcomes(table, requested, evaluations, key, **options).select(
            F.lit(kind).alias("kind"), "id", "outcome"
        )

    return outcomes("player", t.players(), "player_id").unionByName(
        outcomes("coach", t.coaches(), "coach_id", protect_admins=True)
    )


@query
def reset_players(t: StarTables) -> DataFrame:
    """Stream and batch scores after every player with a division is removed."""
    scores = _evaluations(t).unionByName(latest.latest_evaluations(t.stream_submissions()))
    placed = t.players().filter(F.col("division_id").isNotNull())
    left, _ = maintenance.reset_players(scores, placed)
    return left


@query
def reset_every_player(t: StarTables) -> DataFrame:
    """What a reset of all players takes from scores and players, and what it leaves."""
    scores = _evaluations(t).unionByName(latest.latest_evaluations(t.stream_submissions()))
    left, players = maintenance.reset_players(scores, t.players())

    def counted(kind: str, table: DataFrame, column: str, other: str) -> DataFrame:
        n = F.count(F.lit(1))
        return table.agg(n.alias(column)).select(
            F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias(other), column
        )

    parts = [
        counted("evaluations", scores, "before", "left"),
        counted("evaluations", left, "left", "before"),
        counted("players", t.players(), "before", "left"),
        counted("players", players, "left", "before"),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("kind").agg(
        F.sum("before").alias("before"), F.sum("left").alias("left")
    )


@query
def reset_coaches(t: StarTables) -> DataFrame:
    left, _ = maintenance.reset_coaches(_evaluations(t), t.coaches())
    return left


@query
def integrity_report(t: StarTables) -> DataFrame:
    submissions = t.submissions().unionByName(t.stream_submissions())
    return quality.integrity_report(
        t.divisions(),
        t.players(),
        t.coaches(),
        materialize(_sessions(t), "sessions"),
        submissions,
    )


@query
def synth_roster(t: StarTables) -> DataFrame:
    return synth.synth_roster(t.divisions())


@query
def synth_coaches(t: StarTables) -> DataFrame:
    return synth.synth_coaches(t.divisions())


# --- streams ---------------------------------------------------------------------

def _files(t: StarTables) -> int:
    """As many files as the cluster is set to have partitions."""
    return int(t.spark.conf.get("spark.sql.shuffle.partitions"))


def _queue(
    t: StarTables, again: Column | None = None, dequeue: str | None = None
) -> tuple[DataFrame, str]:
    """The events as a queue of JSON files in two rounds, so that keys come back late.

    What ``again`` is true for comes a second time, in a third round.
    """
    root, files = new_folder(t.spark, "queue"), _files(t)
    rounds = list(_halves(t.stream_submissions()))
    if again is not None:
        rounds.append(t.stream_submissions().filter(again))
    for part in rounds:
        submission_stream.drop_submissions(part, f"{root}/in", files)
    return submission_stream.submission_stream(t.spark, f"{root}/in", files, dequeue=dequeue), root


def _replayed_payloads(t: StarTables) -> str:
    """Loosely typed events, broken lines among them, replayed into a log."""
    root = new_folder(t.spark, "queue")
    derived.submission_payloads(t).write.text(f"{root}/in")
    stream = submission_stream.payload_stream(t.spark, f"{root}/in", _files(t))
    submission_stream.start_replay(stream, f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return f"{root}/log"


@query
def stream_evaluations_from_json(t: StarTables) -> DataFrame:
    return submission_stream.replayed_latest(t.spark, _replayed_payloads(t), PAYLOADS)


@query
def stream_quarantine_from_json(t: StarTables) -> DataFrame:
    """Refused payloads; the event is read from the line that was kept."""
    rows = submission_stream.quarantined_submissions(t.spark, _replayed_payloads(t), PAYLOADS)
    return rows.select(
        F.regexp_extract("payload", '"id": ([0-9]+)', 1).cast("bigint").alias("event_id"),
        "arrival_seq",
        "session_id",
        "player_id",
        "skill_index",
        "score",
        "queued_at",
        "reasons",
    )


def _replayed(t: StarTables) -> str:
    stream, root = _queue(t)
    submission_stream.start_replay(stream, f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return f"{root}/log"


@query
def stream_submissions_latest(t: StarTables) -> DataFrame:
    return submission_stream.replayed_latest(t.spark, _replayed(t))


@query
def stream_quarantine(t: StarTables) -> DataFrame:
    return submission_stream.quarantined_submissions(t.spark, _replayed(t))


@query
def stream_progress(t: StarTables) -> DataFrame:
    stream, root = _queue(t)
    submission_stream.start_progress(
        stream, f"{root}/changes", f"{root}/checkpoint", interval=None
    ).awaitTermination()
    return submission_stream.progress_so_far(t.spark, f"{root}/changes")


@query
def stream_pending_overlay(t: StarTables) -> DataFrame:
    """Queued scores over versions: some are sent, and a version published, before others are queued."""
    root, rows = new_folder(t.spark, "overlay"), t.stream_submissions()
    part = [rows.filter(F.col("arrival_seq") % 3 == i) for i in range(3)]
    first = latest.latest_evaluations(part[0], keep_order=True)
    keyed.publish_keyed(first, f"{root}/stored", 1, KEYED_BUCKETS)
    for version, queued in enumerate(part[1:], 2):
        submission_stream.drop_submissions(queued, f"{root}/in", _files(t))
        stream = submission_stream.submission_stream(t.spark, f"{root}/in")
        overlay.start_live_overlay(
            stream, f"{root}/stored", f"{root}/state", f"{root}/checkpoint"
        ).awaitTermination()
        if version == 2:
            keyed.upsert_keyed(queued, f"{root}/stored", version)
    return overlay.live_overlay(t.spark, f"{root}/stored", f"{root}/state")


@query
def stream_keyed_latest(t: StarTables) -> DataFrame:
    """Sessions end while the queue is read, some before their last scores have come."""
    stream, root = _queue(t)
    session_stream.drop_commands(derived.session_ends(t), f"{root}/ends", _files(t))
    ends = session_stream.command_stream(t.spark, f"{root}/ends")
    keyed_state.start_keyed_latest(
        stream, f"{root}/updates", f"{root}/checkpoint", ends=ends
    ).awaitTermination()
    return keyed_state.keyed_latest(t.spark, f"{root}/updates")


@query
def stream_active_session(t: StarTables) -> DataFrame:
    root, files = new_folder(t.spark, "commands"), _files(t)
    session_stream.drop_commands(t.league_commands(), f"{root}/in", files)
    stream = session_stream.command_stream(t.spark, f"{root}/in", max(1, files // 2))
    session_stream.start_monitor(
        stream, f"{root}/log", f"{root}/checkpoint", interval=None
    ).awaitTermination()
    return session_stream.active_sessions(t.spark, f"{root}/log")


@query
def stream_session_history(t: StarTables) -> DataFrame:
    """Commands in no order, over two batches: some come after what followed them."""
    root, files = new_folder(t.spark, "commands"), _files(t)
    session_stream.drop_commands(t.league_commands(), f"{root}/in", files, mixed=True)
    stream = session_stream.command_stream(t.spark, f"{root}/in", max(1, files // 2))
    lanes.start_lanes(stream, f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return lanes.live_history(t.spark, f"{root}/log")


@query
def stream_replay_summary(t: StarTables) -> DataFrame:
    """A queue emptied as it is read, some of it sent again: counts by submission and by delivery."""
    stream, root = _queue(t, again=F.col("arrival_seq") % 10 == 0, dequeue="delete")
    submission_stream.start_replay(
        stream, f"{root}/log", f"{root}/checkpoint", counters=f"{root}/counters"
    ).awaitTermination()
    summary = submission_stream.replay_summary(t.spark, f"{root}/log")
    came = submission_stream.delivered(t.spark, f"{root}/counters")
    rows = [summary.select(F.lit("submissions").alias("kind"), *summary.columns)]
    rows.append(came.select(F.lit("deliveries").alias("kind"), *came.columns, F.lit(0).cast("bigint").alias("repeated")))
    return reduce(DataFrame.unionByName, rows)
