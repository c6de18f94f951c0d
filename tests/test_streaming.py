"""Streams against batch results, with replays and restarts."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rateline.operators.latest import latest_evaluations, pending_overlay
from rateline.operators.results import session_progress
from rateline.operators.sessions import session_history
from rateline.schemas import EVALUATION_KEY
from rateline.sources import keyed
from rateline.streaming import keyed_state, lanes, overlay, packed, runs
from rateline.streaming import sessions as session_stream
from rateline.streaming import submissions as stream_ops


@pytest.fixture(scope="module")
def submitted(spark):
    """Two of three rows go to one session, with corrections and invalid scores."""
    i = F.col("id")
    return spark.range(1200).select(
        F.when(i % 3 == 0, 5 + i % 4).otherwise(1).cast("long").alias("session_id"),
        (1 + i % 13).alias("player_id"),
        (1 + i % 5).alias("coach_id"),
        (i % 5).cast("int").alias("skill_index"),
        ((i * 7) % 12).cast("int").alias("score"),
        i.alias("arrival_seq"),
        F.timestamp_micros(i * 1_000_001).cast("timestamp_ntz").alias("created_at"),
        F.timestamp_micros(i * 1_000_001).cast("timestamp_ntz").alias("queued_at"),
    )


@pytest.fixture
def queue(spark, submitted, tmp_path):
    folder = str(tmp_path / "in")
    stream_ops.drop_submissions(submitted, folder, 6)
    return folder, str(tmp_path)


def equal(a, b, *columns):
    columns = columns or a.columns
    a, b = a.select(*columns), b.select(*columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_replay_equals_batch(spark, submitted, queue):
    folder, root = queue
    stream = stream_ops.submission_stream(spark, folder, 2)
    stream_ops.start_replay(stream, f"{root}/log", f"{root}/cp").awaitTermination()
    assert equal(stream_ops.replayed_latest(spark, f"{root}/log"), latest_evaluations(submitted))
    bad = stream_ops.quarantined_submissions(spark, f"{root}/log")
    assert bad.count() == submitted.filter("score not between 1 and 10").count()
    assert {r.reasons for r in bad.collect()} == {"bad_score"}


def test_queue_is_emptied_after_commit_and_copies_count_once(spark, submitted, tmp_path):
    """A batch fails after its write and is run again; nothing leaves the queue before its commit."""
    folder, root = str(tmp_path / "in"), str(tmp_path)
    stream_ops.drop_submissions(submitted, folder, 4)
    stream_ops.drop_submissions(submitted.filter("arrival_seq % 3 = 0"), folder, 2)  # sent again

    def files():
        return len(list((tmp_path / "in").glob("part-*")))

    def replay(stream):
        return stream_ops.start_replay(stream, f"{root}/log", f"{root}/cp", counters=f"{root}/n")

    stream = stream_ops.submission_stream(spark, folder, 2, dequeue=f"{root}/done")
    failing = stream.withColumn("score", F.when(F.col("arrival_seq") == 700, F.raise_error(F.lit("lost"))).otherwise(F.col("score")))
    with pytest.raises(Exception, match="lost"):
        replay(failing).awaitTermination()
    assert files() >= 4  # one of three batches at most has been committed
    replay(stream).awaitTermination()
    deadline = time.time() + 30
    while files() > 2 and time.time() < deadline:  # the last batch leaves on the way to the next one
        time.sleep(0.2)
    assert files() == 2
    good = submitted.filter("score between 1 and 10")
    n, all_, thirds = good.count(), submitted.count(), submitted.filter("arrival_seq % 3 = 0").count()
    assert tuple(stream_ops.replay_summary(spark, f"{root}/log").first()) == (n, all_ - n, thirds)
    came = stream_ops.delivered(spark, f"{root}/n").first()
    assert came.accepted == n + good.filter("arrival_seq % 3 = 0").count()
    assert came.accepted + came.rejected == all_ + thirds
    assert stream_ops.quarantined_submissions(spark, f"{root}/log").count() == all_ - n
    assert equal(stream_ops.replayed_latest(spark, f"{root}/log"), latest_evaluations(submitted))


def test_restart_goes_on_where_it_stopped(spark, submitted, tmp_path):
    root, folder = str(tmp_path), str(tmp_path / "in")
    half = submitted.filter("arrival_seq < 700"), submitted.filter("arrival_seq >= 700")
    for part in half:
        part.repartitionByRange(2, "arrival_seq").write.mode("append").options(
            **stream_ops.JSON_TIMES
        ).json(folder)
        stream = stream_ops.submission_stream(spark, folder, 1)
        stream_ops.start_progress(stream, f"{root}/ch", f"{root}/cp", None).awaitTermination()
    want = session_progress(latest_evaluations(submitted))
    assert equal(stream_ops.progress_so_far(spark, f"{root}/ch"), want)


def test_out_of_order_files_and_repeated_batch(spark, submitted, tmp_path):
    """Corrections that arrive late do not win, and a batch run twice counts once."""
    changes = str(tmp_path / "ch")
    parts = [
        submitted.filter("arrival_seq >= 800"),
        submitted.filter("arrival_seq < 400"),
        submitted.filter("arrival_seq between 400 and 799"),
    ]

    log = stream_ops.progress_log(spark, changes)

    def run(batch, number):
        valid = batch.filter("score between 1 and 10")
        latest = valid.groupBy(*EVALUATION_KEY).agg(
            F.max_by("score", "arrival_seq").alias("score"),
            F.max("arrival_seq").alias("arrival_seq"),
        ).withColumn(
            "session_bucket",
            F.pmod(F.xxhash64("session_id"), F.lit(stream_ops.SESSION_BUCKETS)).cast("int"),
        )
        return log.commit("queue", number, stream_ops._change(log, latest))

    assert [run(batch, number) for number, batch in enumerate(parts)] == [True] * 3
    assert not run(parts[2], 2)
    want = session_progress(latest_evaluations(submitted))
    assert equal(stream_ops.progress_so_far(spark, changes), want)

    compact = str(tmp_path / "compact")
    stream_ops.compact_changes(spark, changes, compact)
    assert equal(stream_ops.progress_so_far(spark, compact), want)


def test_a_log_folds_itself_and_survives_a_crash(spark, submitted, tmp_path, monkeypatch):
    """17 batches in runs of three: few runs are read, a crash before the manifest loses nothing."""
    root = str(tmp_path)
    stream_ops.drop_submissions(submitted, f"{root}/in", 17)
    log = stream_ops.progress_log(spark, f"{root}/ch", 3)
    publish, crashes = runs.RunLog._publish, []

    def failing(self, manifest):
        if manifest.version == 7 and not crashes:
            crashes.append(manifest)
            raise OSError("lost")
        publish(self, manifest)

    monkeypatch.setattr(runs.RunLog, "_publish", failing)

    def start():
        stream = stream_ops.submission_stream(spark, f"{root}/in", 1)
        stream_ops.start_progress(stream, f"{root}/ch", f"{root}/cp", None, 3).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        start()
    assert crashes and log.last().version == 6
    start()
    last = log.last()
    assert last.version == 16 and [r.level for r in last.runs] == [2, 1, 1, 0, 0]  # 9 + 3 + 3 + 1 + 1
    read = {f.split("/run=")[1].split("/")[0] for f in log.read().inputFiles()}
    assert read == {r.path for r in last.runs}
    assert len(log._versions()) == runs.KEPT  # older manifests and their runs are gone
    assert len(log._names("runs")) <= 5 + 3 * runs.KEPT
    want = session_progress(latest_evaluations(submitted))
    assert equal(stream_ops.progress_so_far(spark, f"{root}/ch"), want)


def test_a_batch_reads_its_sessions_only(spark, submitted, tmp_path):
    """The scan is pruned to the buckets of the sessions that the batch has."""
    changes = str(tmp_path / "ch")
    stream_ops.drop_submissions(submitted, str(tmp_path / "in"), 2)
    stream = stream_ops.submission_stream(spark, str(tmp_path / "in"))
    stream_ops.start_progress(stream, changes, str(tmp_path / "cp"), None).awaitTermination()
    one = submitted.filter("session_id = 5").limit(3).withColumn(
        "session_bucket", F.pmod(F.xxhash64("session_id"), F.lit(stream_ops.SESSION_BUCKETS)).cast("int")
    )
    change = stream_ops._change(stream_ops.progress_log(spark, changes), one)
    plan = change._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "session_bucket" in line)
    assert "PartitionFilters: [isnotnull(session_bucket" in scan and "EqualTo(session_id,5)" in scan


def test_keyed_state_keeps_the_last_score(spark, submitted, queue):
    folder, root = queue
    stream = stream_ops.submission_stream(spark, folder, 2)
    keyed_state.start_keyed_latest(stream, f"{root}/up", f"{root}/cp").awaitTermination()
    want = latest_evaluations(submitted)
    assert equal(keyed_state.keyed_latest(spark, f"{root}/up"), want, *EVALUATION_KEY, "score")


def _state_rows(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_state_goes_when_sessions_end_and_late_scores_follow_the_rule(spark, submitted, tmp_path):
    """After an end no state is left; a score that is late then still counts if it arrived last."""
    root = str(tmp_path)
    sessions = [r[0] for r in submitted.select("session_id").distinct().collect()]

    def run(rows, ended):
        if rows is not None:
            stream_ops.drop_submissions(rows, f"{root}/in", 2)
        commands = spark.createDataFrame(
            [(1, k, "end", None, s) for k, s in enumerate(ended)],
            "lane long, seq long, command string, division_id long, session_id long",
        ).withColumn("ts", F.timestamp_micros("seq").cast("timestamp_ntz"))
        session_stream.drop_commands(commands, f"{root}/ends", 1)
        query = keyed_state.start_keyed_latest(
            stream_ops.submission_stream(spark, f"{root}/in"), f"{root}/up", f"{root}/cp",
            ends=session_stream.command_stream(spark, f"{root}/ends"), buckets=4,
        )
        query.awaitTermination()
        return query

    first = submitted.filter("arrival_seq < 800 and arrival_seq <> 3")
    assert _state_rows(run(first, [])) > 0
    assert _state_rows(run(None, sessions)) == 0
    late = submitted.filter("arrival_seq >= 800 or arrival_seq = 3")  # one of them older than what is known
    query = run(late, [])
    assert 0 < _state_rows(query)
    want = latest_evaluations(submitted)
    assert equal(keyed_state.keyed_latest(spark, f"{root}/up"), want, *EVALUATION_KEY, "score")
    assert _state_rows(run(None, sessions)) == 0


def test_idle_state_is_released_by_its_timer(spark, submitted, queue):
    folder, root = queue
    stream = stream_ops.submission_stream(spark, folder)
    query = keyed_state.start_keyed_latest(
        stream, f"{root}/up", f"{root}/cp", interval="1 second", idle_ms=3_000, buckets=2
    )
    try:
        rows, deadline = [], time.time() + 90
        while time.time() < deadline:
            rows += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:] if p["stateOperators"]]
            if rows and max(rows) > 0 and rows[-1] == 0:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert max(rows) > 0 and rows[-1] == 0
    want = latest_evaluations(submitted)
    assert equal(keyed_state.keyed_latest(spark, f"{root}/up"), want, *EVALUATION_KEY, "score")


def test_monitor_follows_each_lane(spark, tmp_path):
    listed = [
        (1, 1, "start", 5, 10), (1, 2, "advance", None, 10), (1, 3, "start", 6, 11),
        (2, 4, "start", 5, 12), (2, 5, "end", None, None), (3, 6, "end", None, None),
    ]
    commands = spark.createDataFrame(
        listed, "lane long, seq long, command string, division_id long, session_id long"
    ).withColumn("ts", F.timestamp_micros("seq").cast("timestamp_ntz"))
    root = str(tmp_path)
    session_stream.drop_commands(commands, f"{root}/in", 3)
    stream = session_stream.command_stream(spark, f"{root}/in", 1)
    session_stream.start_monitor(stream, f"{root}/log", f"{root}/cp", None).awaitTermination()
    active = session_stream.active_sessions(spark, f"{root}/log")
    assert [(r.lane, r.id, r.division_id) for r in active.collect()] == [(1, 11, 6)]


@pytest.fixture(scope="module")
def commanded(spark):
    """Half of all commands in one lane, over five days; some starts are refused, some ends end nothing."""
    i = F.col("id")
    command = F.when(i % 7 == 3, "end").when(i % 7 == 5, "advance").otherwise("start")
    return spark.range(600).select(
        F.when(i % 2 == 0, 1).otherwise(2 + i % 9).cast("long").alias("lane"),
        i.alias("seq"),
        F.timestamp_micros(i.cast("long") * 700_000_000).cast("timestamp_ntz").alias("ts"),
        command.alias("command"),
        F.when(i % 11 != 0, i % 5 + 1).alias("division_id"),
        (i + 1000).alias("session_id"),
    )


HISTORY = ["lane", "id", "division_id", "started_at", "ended_at", "active"]


def test_lanes_in_no_order_equal_the_batch_history(spark, commanded, tmp_path):
    root = str(tmp_path)
    session_stream.drop_commands(commanded, f"{root}/in", 5, mixed=True)
    session_stream.drop_commands(commanded.filter("seq % 50 = 0"), f"{root}/in", 1)  # come twice
    stream = session_stream.command_stream(spark, f"{root}/in", 1)
    lanes.start_lanes(stream, f"{root}/log", f"{root}/cp").awaitTermination()
    assert equal(lanes.live_history(spark, f"{root}/log"), session_history(commanded), *HISTORY)


def test_released_lanes_are_put_in_order_when_commands_come_late(spark, commanded, tmp_path):
    """State goes to nothing after the idle time, and what comes then still finds its place."""
    root = str(tmp_path)
    session_stream.drop_commands(commanded.filter("seq % 3 > 0"), f"{root}/in", 1)
    stream = session_stream.command_stream(spark, f"{root}/in")

    def run():
        query = lanes.start_lanes(stream, f"{root}/log", f"{root}/cp", interval="1 second", idle_ms=3_000)
        try:
            rows, deadline = [], time.time() + 90
            while time.time() < deadline and not (rows and max(rows) > 0 and rows[-1] == 0):
                rows += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:] if p["stateOperators"]]
                time.sleep(0.5)
        finally:
            query.stop()
        assert max(rows) > 0 and rows[-1] == 0

    run()
    session_stream.drop_commands(commanded.filter("seq % 3 = 0"), f"{root}/in", 1)
    run()
    assert equal(lanes.live_history(spark, f"{root}/log"), session_history(commanded), *HISTORY)


def test_log_of_monitor_stays_bounded(spark, commanded, tmp_path):
    root = str(tmp_path)
    session_stream.drop_commands(commanded, f"{root}/in", 20, mixed=True)
    stream = session_stream.command_stream(spark, f"{root}/in", 1)
    session_stream.start_monitor(stream, f"{root}/log", f"{root}/cp", None).awaitTermination()
    log = session_stream._log(spark, f"{root}/log")
    lanes_ = commanded.select("lane").distinct().count()
    assert len(log.last().runs) < 2 * runs.FANOUT and log.read().count() < 2 * runs.FANOUT * lanes_
    want = session_history(commanded).filter("active").select("lane", "id", "division_id", "started_at")
    assert equal(session_stream.active_sessions(spark, f"{root}/log"), want)


def test_payloads_are_coerced_and_refused_lines_kept(spark, tmp_path):
    from rateline.schemas import PAYLOADS

    body = '{"id": %d, "session_id": "1", "player_id": 2, "coach_id": "3x", "skill_index": 0, "score": %s, "queued_at": 1500}'
    lines = [body % (1, '"7abc"'), body % (2, "7.9"), body % (3, '"1e1"'), '{"id": 4,', "[]", " "]
    spark.createDataFrame([(x,) for x in lines], "v string").write.text(f"{tmp_path}/in")
    stream = stream_ops.payload_stream(spark, f"{tmp_path}/in")
    stream_ops.start_replay(stream, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    kept = stream_ops.accepted_submissions(spark, f"{tmp_path}/log", PAYLOADS)
    assert sorted((r.arrival_seq, r.coach_id, r.score) for r in kept.collect()) == [(1, 3, 7), (2, 3, 7)]
    assert {r.queued_at.isoformat() for r in kept.collect()} == {"1970-01-01T00:00:01.500000"}
    bad = stream_ops.quarantined_submissions(spark, f"{tmp_path}/log", PAYLOADS).collect()
    assert {r.payload for r in bad} == {lines[2], lines[3], lines[4]}
    assert {r.payload: r.reasons for r in bad}[lines[2]] == "scientific_notation"


def test_periodic_trigger(spark, queue):
    folder, root = queue
    stream = stream_ops.submission_stream(spark, folder, 6)
    running = stream_ops.start_progress(stream, f"{root}/ch", f"{root}/cp")
    running.processAllAvailable()
    running.stop()
    assert stream_ops.progress_so_far(spark, f"{root}/ch").count() > 0


def test_folded_history_is_kept_by_a_new_stream(spark, tmp_path):
    """Fold a log, stream on into it from batch 0: earlier players stay, corrections replace."""
    from rateline.schemas import SUBMISSIONS
    from rateline.streaming import submissions as live

    def rows(*scores):
        values = [
            {"session_id": 1, "player_id": p, "coach_id": 1, "skill_index": 0, "score": s, "arrival_seq": q}
            for p, s, q in scores
        ]
        return spark.createDataFrame([tuple(v.get(n) for n in SUBMISSIONS.names) for v in values], SUBMISSIONS)

    queue, log, folded = (str(tmp_path / n) for n in ("queue", "log", "folded"))
    live.drop_submissions(rows((1, 5, 1), (2, 4, 2)), queue, 1)
    stream = live.submission_stream(spark, queue)
    live.start_progress(stream, log, str(tmp_path / "c1"), None).awaitTermination()
    live.compact_changes(spark, log, folded)
    later = str(tmp_path / "later")
    live.drop_submissions(rows((2, 8, 3)), later, 1)
    live.drop_submissions(rows((3, 7, 4)), later, 1)  # adds to the queue
    stream = live.submission_stream(spark, later, files_per_trigger=1)
    live.start_progress(stream, folded, str(tmp_path / "c2"), None).awaitTermination()
    got = {r.player_id: r.avg_score for r in live.progress_so_far(spark, folded).collect()}
    assert got == {1: 5.0, 2: 8.0, 3: 7.0}


def test_live_overlay_equals_the_batch_one_after_each_version(spark, submitted, tmp_path, monkeypatch):
    """Versions are published under the stream; a batch fails after its write and is run again."""
    root = str(tmp_path)
    stored, state, checkpoint = f"{root}/stored", f"{root}/state", f"{root}/cp"
    part = [submitted.filter(F.col("arrival_seq") % 4 == i) for i in range(4)]
    keyed.publish_keyed(latest_evaluations(part[0], keep_order=True), stored, 1, 4)
    assert equal(
        overlay.live_overlay(spark, stored, state), pending_overlay(latest_evaluations(part[0]), submitted.limit(0))
    )

    def run():
        stream = stream_ops.submission_stream(spark, f"{root}/in", 2)
        overlay.start_live_overlay(stream, stored, state, checkpoint).awaitTermination()

    def expected(sent, queued):
        held = latest_evaluations(sent, keep_order=True)
        newer = queued.filter("score between 1 and 10").join(
            held.select(*EVALUATION_KEY, F.col("arrival_seq").alias("held")), EVALUATION_KEY, "left"
        ).filter("held is null or arrival_seq > held")
        return pending_overlay(held, newer)

    stream_ops.drop_submissions(part[1], f"{root}/in", 4)
    write, failed = overlay.publish, []

    def fails_once(*args):
        write(*args)
        if not failed:
            failed.append(True)
            raise RuntimeError("lost")

    monkeypatch.setattr(overlay, "publish", fails_once)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert equal(overlay.live_overlay(spark, stored, state), expected(part[0], part[1]))
    many = overlay.live_pending(spark, stored, state).count()
    keyed.upsert_keyed(part[1], stored, 2)
    assert many > 0 == overlay.live_pending(spark, stored, state).count()
    sent = part[0].union(part[1])
    assert equal(overlay.live_overlay(spark, stored, state), expected(sent, submitted.limit(0)))
    stream_ops.drop_submissions(part[2].union(part[3]), f"{root}/in", 4)
    run()
    assert equal(overlay.live_overlay(spark, stored, state), expected(sent, part[2].union(part[3])))
    queued = part[2].union(part[3]).filter("score between 1 and 10").select(*EVALUATION_KEY).distinct()
    assert overlay._before(spark, state, None).count() <= queued.count(), "sent scores leave the state"
    keyed.upsert_keyed(part[3], stored, 3)
    assert equal(overlay.live_overlay(spark, stored, state), expected(sent.union(part[3]), part[2]))


class Held:
    """A state variable, map or value, that counts the calls."""

    calls = 0

    def __init__(self):
        self.rows = {}

    def _called(self, result=None):
        Held.calls += 1
        return result

    def getValue(self, key):
        return self._called(self.rows.get(key))

    def updateValue(self, key, value):
        self._called(self.rows.update({key: value}))

    def removeKey(self, key):
        self._called(self.rows.pop(key))

    def iterator(self):
        return self._called(iter(list(self.rows.items())))

    def clear(self):
        self._called(self.rows.clear())

    def exists(self):
        return self._called(bool(self.rows))

    def get(self):
        return self._called(self.rows[()])

    def update(self, value):
        self._called(self.rows.update({(): value}))


class Handle:
    """What a processor needs of the state store, for one group."""

    def __init__(self):
        self.states, self.timers, self.now = [], [], 0

    def _state(self, *_):
        self.states.append(Held())
        return self.states[-1]

    getMapState = getValueState = _state

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now


def _machines(idle_ms=None):
    handle, machines = Handle(), lanes.LaneMachines(idle_ms)
    machines.init(handle)

    def run(steps):
        frame = pd.DataFrame(steps, columns=lanes._NUMBERS)
        out = list(machines.handleInputRows((0, 9), iter([frame]), handle))
        return pd.concat(out) if out else pd.DataFrame(columns=lanes._NEWS.names)

    return handle, machines, run


def test_many_lanes_take_few_state_calls_and_are_logged_like_each_alone(monkeypatch):
    """Parts are few, grow with the bucket, and hold each lane's steps, whatever batch they came in."""
    monkeypatch.setattr(packed, "FULL", 64)
    rng = np.random.default_rng(1)
    steps = [
        (int(rng.integers(400)), int(rng.integers(50)), int(rng.integers(3)), int(rng.choice([0, 2, 3, 7])), i + 2**60, i)
        for i in range(3000)
    ]
    handle, machines, run = _machines()
    logged, known, was = {}, {}, {}
    for batch in (steps[:1000], steps[1000:1010], steps[1010:], steps[:40]):
        Held.calls = 0
        news = run(batch)
        assert Held.calls < 3 * 64  # a lane has some calls of its own, if each is kept alone
        for lane, at, seq, kind, session, division in batch:
            known[lane, at, seq] = (kind, session, division)
        order = sorted(known)
        want = {k: (*known[k], *(n[1:] if n and n[0] == k[0] else (None, None))) for k, n in zip(order, [*order[1:], None])}
        got = {
            (r.lane, r.at, r.seq): (
                r.kind & ~lanes.HAS_NEXT, r.session_id, r.division_id,
                *((r.next_at, r.next_seq) if r.kind & lanes.HAS_NEXT else (None, None)),
            )
            for r in news.itertuples()
        }
        assert len(got) == len(news) and got == {k: v for k, v in want.items() if was.get(k) != v}
        logged, was = {**logged, **got}, want
    assert logged == was
    assert len(handle.states[0].rows) > 16


def test_lanes_of_a_bucket_are_released_each_in_its_time():
    handle, machines, run = _machines(idle_ms=800)
    assert list(run([(1, 5, 0, 3, 1, 1), (2, 5, 0, 3, 2, 1)])["epoch"]) == [0, 0]
    handle.now = 500
    assert list(run([(2, 6, 0, 3, 3, 1)])["revision"]) == [2, 2]  # the lane's earlier step has a successor now
    assert handle.timers == [800]
    handle.now = 900
    assert list(machines.handleExpiredTimer((0, 9), handle, None)) == [] and handle.timers == [800, 1300]
    again = run([(1, 7, 0, 0, 0, 0), (2, 7, 0, 0, 0, 0)])
    assert list(zip(again["lane"], again["epoch"], again["revision"])) == [(1, 900, 1), (2, 0, 3), (2, 0, 3)]
    handle.now = 1800
    list(machines.handleExpiredTimer((0, 9), handle, None))
    assert not any(s.rows for s in handle.states)


def test_lanes_that_share_a_bucket_share_state_rows_and_timers(spark, tmp_path):
    """A lane that waits longer than the bucket's first timer is released by a later one."""
    root = str(tmp_path)
    commands = spark.range(300).select(
        (F.col("id") + 1).alias("lane"), F.col("id").alias("seq"),
        F.timestamp_micros("id").cast("timestamp_ntz").alias("ts"), F.lit("start").alias("command"),
        F.lit(1).cast("long").alias("division_id"), (F.col("id") + 2**60 + 1).alias("session_id"),
    )
    ends = commands.filter("lane = 3").selectExpr(
        "lane", "seq + 1 as seq", "ts", "'end' as command", "null as division_id", "null as session_id"
    )
    session_stream.drop_commands(commands.filter("lane > 1").unionByName(ends), f"{root}/in", 2, mixed=True)
    stream = session_stream.command_stream(spark, f"{root}/in")
    query = lanes.start_lanes(stream, f"{root}/log", f"{root}/cp", interval="1 second", idle_ms=8_000, buckets=2)
    try:
        rows, deadline, dropped = [], time.time() + 90, False
        while time.time() < deadline and not (rows and max(rows) > 0 and rows[-1] == 0):
            rows += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:] if p["stateOperators"]]
            if rows and max(rows) > 0 and not dropped:
                time.sleep(2)
                session_stream.drop_commands(commands.filter("lane = 1"), f"{root}/in", 1)
                dropped = True
            time.sleep(0.5)
    finally:
        query.stop()
    assert 0 < max(rows) < 30 and rows[-1] == 0
    want = session_history(commands.unionByName(ends))
    assert equal(lanes.live_history(spark, f"{root}/log"), want, *HISTORY)


def test_many_keys_take_few_state_calls_and_let_through_what_is_news(monkeypatch):
    monkeypatch.setattr(packed, "FULL", 64)
    rng = np.random.default_rng(2)
    handle, scores = Handle(), keyed_state.LastScores(None)
    scores.init(handle)
    columns = ["player_id", "coach_id", "skill_index", "score", "arrival_seq"]
    keys = np.column_stack([rng.integers(-5, 300, 4000), 2**60 + rng.integers(3, size=4000), rng.integers(-1, 3, 4000)])
    rows = [(*map(int, k), i % 11, int(a)) for i, (k, a) in enumerate(zip(keys, rng.permutation(4000)))]
    known = {}
    for batch in (rows[:2000], rows[2000:2010], rows[2010:], rows[:50]):
        Held.calls = 0
        frame = pd.DataFrame(batch, columns=columns).assign(ended=False)
        out = list(scores.handleInputRows((7, 0), iter([frame]), handle))
        assert Held.calls < 3 * 64  # two for each key, if it is kept alone
        last = {}
        for *key, score, arrival in batch:
            last[tuple(key)] = max(last.get(tuple(key), (-1, 0)), (arrival, score))
        want = {(7, *k, s, a, k not in known) for k, (a, s) in last.items() if k not in known or a > known[k][0]}
        got = [tuple(r) for frame in out for r in frame[keyed_state._NEWS.names].itertuples(index=False)]
        assert len(got) == len(want) and set(got) == want
        known |= {k: v for k, v in last.items() if k not in known or v[0] > known[k][0]}
    assert len(handle.states[0].rows) > 16
    end = pd.DataFrame([(0, 0, 0, 0, 0)], columns=columns).assign(ended=True)
    assert list(scores.handleInputRows((7, 0), iter([end]), handle)) == []
    assert not any(s.rows for s in handle.states)


def test_keys_share_state_rows(spark, tmp_path):
    """Scores of 2,000 keys lie in few rows, two batches' worth."""
    root = str(tmp_path)
    rows = spark.range(4000).select(
        F.lit(1).cast("long").alias("session_id"), (F.col("id") % 2000 + 1).alias("player_id"),
        F.lit(1).cast("long").alias("coach_id"), F.lit(0).alias("skill_index"), (F.col("id") % 10 + 1).cast("int").alias("score"),
        F.pmod(F.col("id") * 7, F.lit(4000)).alias("arrival_seq"), F.timestamp_micros("id").cast("timestamp_ntz").alias("created_at"),
        F.timestamp_micros("id").cast("timestamp_ntz").alias("queued_at"),
    )
    stream_ops.drop_submissions(rows, f"{root}/in", 4)
    query = keyed_state.start_keyed_latest(stream_ops.submission_stream(spark, f"{root}/in", 2), f"{root}/up", f"{root}/cp", buckets=4)
    query.awaitTermination()
    assert 0 < _state_rows(query) < 200
    assert equal(keyed_state.keyed_latest(spark, f"{root}/up"), latest_evaluations(rows), *EVALUATION_KEY, "score")
