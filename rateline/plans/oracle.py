"""Equivalent SQL for the named queries, for a single-node engine to check them."""

from __future__ import annotations

from rateline.operators.synth import (
    CATCHER_SHARE,
    DEMO_COACHES,
    DEMO_DIVISIONS,
    FAMILY_NAMES,
    GIVEN_NAMES,
    MAX_AGE,
    MIN_AGE,
    PITCHER_SHARE,
    PLAYERS_PER_DIVISION,
    _stride,
)
from rateline.plans.parameters import (
    COACH,
    DEFAULT_DIVISION,
    DIVISION,
    PENDING_FROM,
    PLAYER_LETTERS,
    PLAYER_NUMBER,
    PLAYER_QUERY,
    SESSION,
    SKILL,
)

KEY = "session_id, player_id, coach_id, skill_index"


def _label(pitcher: str = "is_pitcher", catcher: str = "is_catcher") -> str:
    return (
        f"CASE WHEN {pitcher} AND {catcher} THEN 'Pitcher/Catcher' WHEN {pitcher} THEN 'Pitcher' "
        f"WHEN {catcher} THEN 'Catcher' ELSE 'Player' END"
    )


def _skill(column: str = "skill_index") -> str:
    return (
        f"CASE {column} WHEN 0 THEN 'Running' WHEN 1 THEN 'Fielding' WHEN 2 THEN 'Pitching' "
        f"WHEN 3 THEN 'Hitting' ELSE 'Unknown' END"
    )


def _band(column: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL THEN NULL WHEN {column} >= 8 THEN 'high' "
        f"WHEN {column} >= 6 THEN 'mid' WHEN {column} >= 4 THEN 'low' ELSE 'poor' END"
    )


def _number(column: str) -> str:
    return f"CASE WHEN {column} < 1000 THEN lpad(CAST({column} AS VARCHAR), 3, '0') ELSE CAST({column} AS VARCHAR) END"


def _latest(source: str, order: str = "arrival_seq") -> str:
    return f"""
        SELECT {KEY}, {_skill()} AS skill_name, arg_max(score, {order}) AS score,
               arg_min(created_at, {order}) AS created_at
        FROM {source} GROUP BY {KEY}"""


_VALID = "session_id <> 0 AND player_id <> 0 AND skill_index >= 0 AND score BETWEEN 1 AND 10"
_E4 = "CAST((20000 * sum(score) + count(*)) // (2 * count(*)) AS BIGINT)"
_TENTHS = "((avg_e4 + 500) // 1000) / CAST(10 AS DOUBLE)"
_JS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

_SESSION_ORDERS = """
    SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority,
           CAST(year(o_orderdate) * 100 + c_nationkey + 1 AS BIGINT) AS session_id
    FROM orders JOIN customer ON o_custkey = c_custkey"""


def _results(where: str = "TRUE", having: str = "TRUE") -> str:
    return f"""
        SELECT a.player_id, p.name AS player_name, p.age, {_label()} AS position, p.division_id,
               d.name AS division_name, a.skill_index, {_skill("a.skill_index")} AS skill_name,
               a.avg_e4, a.avg_e4 / CAST(10000 AS DOUBLE) AS avg_score, a.eval_count
        FROM (SELECT player_id, skill_index, {_E4} AS avg_e4, count(*) AS eval_count
              FROM evaluations WHERE {where} GROUP BY player_id, skill_index) a
        JOIN players p ON p.id = a.player_id
        JOIN divisions d ON d.id = p.division_id
        WHERE {having}"""


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "divisions": (
        (),
        "SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name FROM nation",
    ),
    "players": (
        (),
        """
        SELECT c_custkey + 1 AS id, c_name AS name,
               CASE WHEN c_custkey % 10 <> 0 THEN 8 + c_custkey % 7 END AS age,
               c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_pitcher,
               c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') AS is_catcher,
               CAST(nullif(c_nationkey + 1, 25) AS BIGINT) AS division_id
        FROM customer""",
    ),
    "coaches": (
        (),
        """SELECT s_suppkey + 1 AS id, s_name AS name, s_suppkey = 0 AS is_admin,
                  TIMESTAMP '1992-01-01' + to_seconds(s_suppkey) AS created_at FROM supplier""",
    ),
    "submissions": (
        (),
        f"""
        SELECT session_id, o_custkey + 1 AS player_id, l_suppkey + 1 AS coach_id,
               (l_linenumber - 1) % 5 AS skill_index, CAST(l_quantity AS INTEGER) % 12 AS score,
               (l_orderkey * 8 + l_linenumber) * 16 + CAST(l_quantity AS INTEGER) % 12 AS arrival_seq,
               o_orderdate AS created_at, l_shipdate AS queued_at
        FROM lineitem JOIN ({_SESSION_ORDERS}) ON l_orderkey = o_orderkey""",
    ),
    "valid": (("submissions",), f"SELECT * FROM submissions WHERE {_VALID}"),
    "evaluations": (("valid",), _latest("valid")),
    "streamed": (
        (),
        """
        SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS session_id, user_id + 1 AS player_id,
               CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 + 1 AS coach_id,
               CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2
                    WHEN 'signup' THEN 3 ELSE 4 END AS skill_index,
               CAST(CAST(floor(value) AS BIGINT) % 12 AS INTEGER) AS score,
               event_id AS arrival_seq, ts AS created_at, ts AS queued_at
        FROM events""",
    ),
    "streamed_latest": (
        ("streamed",),
        _latest(f"(SELECT * FROM streamed WHERE {_VALID})"),
    ),
    "starts": (
        (),
        f"""
        SELECT session_id AS id, session_id % 100 AS division_id, min(o_orderdate) AS started_at
        FROM ({_SESSION_ORDERS})
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY session_id""",
    ),
    "history": (
        ("starts",),
        """
        SELECT id, division_id, started_at,
               lead(started_at) OVER (ORDER BY started_at, id) AS ended_at,
               lead(id) OVER (ORDER BY started_at, id) AS next_id,
               lead(id) OVER (ORDER BY started_at, id) IS NULL AS active
        FROM starts""",
    ),
    "sessions": (
        ("history",),
        f"""
        SELECT h.id, h.division_id, CAST(coalesce(a.n, 0) AS INTEGER) AS current_skill_index,
               CAST(0 AS INTEGER) AS current_player_index, h.active, h.started_at, h.ended_at
        FROM history h LEFT JOIN (
            SELECT h.id, count(*) AS n FROM history h
            JOIN ({_SESSION_ORDERS}) o ON o.session_id = h.id
            WHERE o.o_orderpriority = '1-URGENT' AND o.o_orderdate >= h.started_at
              AND (h.active OR o.o_orderdate < h.ended_at)
            GROUP BY h.id) a ON a.id = h.id""",
    ),
    "results": (("evaluations", "players", "divisions"), _results()),
    "overall": (
        ("results",),
        """
        SELECT player_id, any_value(player_name) AS player_name, any_value(age) AS age,
               any_value(position) AS position, any_value(division_id) AS division_id,
               any_value(division_name) AS division_name, count(*) AS skills,
               CAST(sum(avg_e4) AS BIGINT) / CAST(count(*) * 10000 AS DOUBLE) AS overall,
               CAST((2 * sum(avg_e4) + 1000 * count(*)) // (2000 * count(*)) AS BIGINT)
                   / CAST(10 AS DOUBLE) AS overall_1dp
        FROM results GROUP BY player_id""",
    ),
    "roster": (
        ("players",),
        """
        SELECT division_id, id AS player_id, name,
               row_number() OVER (PARTITION BY division_id ORDER BY lower(name), id) AS position,
               count(*) OVER (PARTITION BY division_id) AS roster_size
        FROM players WHERE division_id IS NOT NULL""",
    ),
    "member_scores": (
        ("evaluations", "starts", "players"),
        """
        SELECT e.session_id, e.coach_id, e.skill_index, e.player_id, p.division_id
        FROM evaluations e JOIN starts s ON s.id = e.session_id
        JOIN players p ON p.id = e.player_id AND p.division_id = s.division_id""",
    ),
    "coverage": (
        ("member_scores", "evaluations", "starts", "players"),
        """
        SELECT g.session_id, g.coach_id, k.skill_index, coalesce(m.scored, 0) AS scored,
               coalesce(r.n, 0) AS roster_size,
               coalesce(r.n, 0) > 0 AND coalesce(m.scored, 0) = coalesce(r.n, 0) AS all_done,
               coalesce(m.scored, 0) = coalesce(r.n, 0) AS none_missing
        FROM (SELECT DISTINCT e.session_id, e.coach_id, s.division_id
              FROM evaluations e JOIN starts s ON s.id = e.session_id) g
        CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS skill_index) k
        LEFT JOIN (SELECT session_id, coach_id, skill_index, count(*) AS scored
                   FROM member_scores GROUP BY ALL) m
          ON m.session_id = g.session_id AND m.coach_id = g.coach_id
             AND m.skill_index = k.skill_index
        LEFT JOIN (SELECT division_id, count(*) AS n FROM players GROUP BY division_id) r
          ON r.division_id = g.division_id""",
    ),
    "lines": (
        (),
        """
        SELECT c_custkey,
               CASE WHEN c_custkey % 97 = 5 THEN '  ' || chr(9) || ' '
                    WHEN c_custkey % 13 = 0 THEN f_name
                    WHEN c_custkey % 17 = 0 THEN whole || ', extra, fields'
                    WHEN c_custkey % 29 = 0 THEN whole || chr(13) ELSE whole END AS line
        FROM (SELECT *, f_name || ',' || f_age || ',' || f_role || ',' || f_division AS whole
              FROM (SELECT c_custkey,
                CASE c_custkey % 50 WHEN 0 THEN '' WHEN 1 THEN '0'
                     WHEN 2 THEN '  ' || c_name || ' ' || chr(9) ELSE c_name END AS f_name,
                CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'abc'
                     WHEN 2 THEN CAST(8 + c_custkey % 7 AS VARCHAR) || 'yrs'
                     ELSE CAST(8 + c_custkey % 7 AS VARCHAR) END AS f_age,
                CASE c_mktsegment WHEN 'BUILDING' THEN ' Pitcher'
                     WHEN 'MACHINERY' THEN 'pitcher/CATCHER ' WHEN 'HOUSEHOLD' THEN 'Catcher'
                     WHEN 'FURNITURE' THEN 'Player' ELSE '' END AS f_role,
                CASE c_custkey % 6 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'Unlisted'
                     WHEN 2 THEN '' ELSE n_name END AS f_division
              FROM customer JOIN nation ON c_nationkey = n_nationkey))""",
    ),
    "parsed": (
        ("lines",),
        f"""
        SELECT c_custkey, trim(parts[1], {_JS}) AS name, trim(parts[2], {_JS}) AS age_text,
               trim(parts[3], {_JS}) AS position_text, trim(parts[4], {_JS}) AS division_text
        FROM (SELECT c_custkey, string_split(line, ',') AS parts FROM lines
              WHERE trim(line, {_JS}) <> '')""",
    ),
    "resolved": (
        ("parsed", "divisions"),
        f"""
        SELECT c_custkey, p.name,
               CASE WHEN coalesce(age_text, '') = '' THEN NULL ELSE coalesce(TRY_CAST(
                   regexp_extract(age_text, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) END AS age,
               contains(lower(coalesce(position_text, '')), 'pitcher') AS is_pitcher,
               contains(lower(coalesce(position_text, '')), 'catcher') AS is_catcher,
               coalesce(d.id, {DEFAULT_DIVISION}) AS division_id,
               coalesce(division_text, '') <> '' AND d.id IS NULL AS division_unmatched
        FROM parsed p LEFT JOIN divisions d ON lower(d.name) = lower(p.division_text)""",
    ),
    "demo_names": (
        (),
        "SELECT unnest([{}]) AS name, unnest([{}]) AS seq".format(
            ", ".join(f"'{n}'" for n in DEMO_DIVISIONS),
            ", ".join(str(i) for i in range(len(DEMO_DIVISIONS))),
        ),
    ),
}


def _draw(bound: int, purpose: str, *key: str) -> str:
    text = " || '/' || ".join([f"'1/{purpose}'", *[f"CAST({k} AS VARCHAR)" for k in key]])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {bound})"


def _names(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


SQL: dict[str, str] = {}


def _define(name: str, needs: str, body: str) -> None:
    ordered: list[str] = []

    def visit(cte: str) -> None:
        if cte not in ordered:
            for other in CTES[cte][0]:
                visit(other)
            ordered.append(cte)

    for cte in needs.split():
        visit(cte)
    prefix = ", ".join(f"{c} AS ({CTES[c][1]})" for c in ordered)
    body = body.strip()
    if prefix and body.startswith("WITH "):
        SQL[name] = f"WITH {prefix}, {body.removeprefix('WITH ')}"
    else:
        SQL[name] = (f"WITH {prefix} " if prefix else "") + body


_define("submissions_valid", "valid", "SELECT * FROM valid")
_define(
    "submissions_rejected",
    "submissions",
    f"""SELECT *, concat_ws(',', CASE WHEN session_id = 0 THEN 'missing_session' END,
               CASE WHEN player_id = 0 THEN 'missing_player' END,
               CASE WHEN skill_index < 0 THEN 'bad_skill_index' END,
               CASE WHEN score NOT BETWEEN 1 AND 10 THEN 'bad_score' END) AS reasons
        FROM submissions WHERE NOT ({_VALID})""",
)
_define("evaluations_latest", "evaluations", "SELECT * FROM evaluations")
_define(
    "evaluations_upsert",
    "evaluations valid",
    f"""SELECT * FROM evaluations JOIN (
            SELECT {KEY}, min(arrival_seq) AS first_seq, max(arrival_seq) AS arrival_seq
            FROM valid GROUP BY {KEY}) USING ({KEY})""",
)
SQL["evaluations_upsert_keyed"] = SQL["evaluations_upsert"]
_define(
    "evaluations_latest_queued",
    "valid",
    f"""SELECT {KEY}, {_skill()} AS skill_name, score
        FROM (SELECT *, row_number() OVER (
                  PARTITION BY {KEY} ORDER BY queued_at DESC, arrival_seq DESC) AS nth FROM valid)
        WHERE nth = 1""",
)
CTES["json_rows"] = (
    (),
    """
    WITH payload AS (
        SELECT event_id, event_id % 23 = 0 AS broken, strftime(ts, '%Y%m%d') AS session_text,
               CASE WHEN event_id % 37 = 0 THEN '0' ELSE CAST(user_id + 1 AS VARCHAR) END AS player_text,
               CASE WHEN event_id % 41 <> 0 THEN CAST(
                   CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 - 1 AS VARCHAR) END AS skill_text,
               CASE event_id % 11 WHEN 0 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 'abc'
                    WHEN 2 THEN NULL WHEN 3 THEN '1e1' ELSE CAST(value AS VARCHAR) END AS score_text,
               ts FROM events),
    fields AS (
        SELECT event_id, CASE WHEN broken THEN 0 ELSE event_id END AS arrival_seq,
               CASE WHEN broken THEN 0 ELSE CAST(session_text AS BIGINT) END AS session_id,
               CASE WHEN broken THEN 0 ELSE CAST(player_text AS BIGINT) END AS player_id,
               CASE WHEN broken OR skill_text IS NULL THEN -1 ELSE CAST(skill_text AS BIGINT) END AS skill_index,
               CASE WHEN broken OR score_text IS NULL THEN 0 ELSE coalesce(TRY_CAST(
                   regexp_extract(score_text, '^([+-]?[0-9]+)', 1) AS BIGINT), 0) END AS score,
               CASE WHEN NOT broken THEN date_trunc('millisecond', ts) END AS queued_at, broken,
               NOT broken AND coalesce(score_text = '1e1', FALSE) AS scientific
        FROM payload)
    SELECT event_id, CAST(CASE WHEN arrival_seq IS NULL THEN 0 ELSE arrival_seq END AS BIGINT) AS arrival_seq,
           session_id, player_id, CAST(skill_index AS BIGINT) AS skill_index, score, queued_at,
           concat_ws(',', CASE WHEN session_id = 0 THEN 'missing_session' END,
               CASE WHEN player_id = 0 THEN 'missing_player' END,
               CASE WHEN skill_index < 0 THEN 'bad_skill_index' END,
               CASE WHEN score NOT BETWEEN 1 AND 10 THEN 'bad_score' END,
               CASE WHEN broken THEN 'malformed' END,
               CASE WHEN scientific THEN 'scientific_notation' END) AS reasons
    FROM fields""",
)
_define("submissions_from_json", "json_rows", "SELECT * EXCLUDE (event_id) FROM json_rows")
for _name in ("evaluations_from_json", "stream_evaluations_from_json"):
    _define(
        _name,
        "json_rows",
        f"""SELECT session_id, player_id, CAST(0 AS BIGINT) AS coach_id, skill_index,
                   {_skill()} AS skill_name, arg_max(score, arrival_seq) AS score,
                   arg_min(queued_at, arrival_seq) AS created_at
            FROM json_rows WHERE reasons = '' GROUP BY session_id, player_id, skill_index""",
    )
_define("stream_quarantine_from_json", "json_rows", "SELECT * FROM json_rows WHERE reasons <> ''")
_mine =f"session_id = {SESSION} AND coach_id = {COACH}"
_define(
    "my_all_scores", "evaluations",
    f"SELECT skill_index, player_id, score FROM evaluations WHERE {_mine}",
)
_define(
    "my_skill_scores", "evaluations",
    f"SELECT player_id FROM evaluations WHERE {_mine} AND skill_index = {SKILL}",
)
_define(
    "my_score_lookup",
    "submissions evaluations",
    f"""SELECT k.*, e.score IS NOT NULL AS scored, e.score
        FROM (SELECT DISTINCT {KEY} FROM submissions) k LEFT JOIN evaluations e USING ({KEY})""",
)
SQL["my_score_lookup_keyed"] = SQL["my_score_lookup"]
_define(
    "skill_labels",
    "submissions",
    f"""SELECT skill_index, {_skill()} AS skill_name, upper({_skill()}) AS label, count(*) AS n
        FROM submissions GROUP BY skill_index""",
)
_define(
    "pending_overlay",
    "valid",
    f"""SELECT {KEY}, coalesce(pending_score, stored_score) AS score,
               pending_score IS NOT NULL AS is_pending
        FROM (SELECT {KEY},
                arg_max(score, arrival_seq) FILTER (queued_at < TIMESTAMP '{PENDING_FROM}') AS stored_score,
                arg_max(score, arrival_seq) FILTER (queued_at >= TIMESTAMP '{PENDING_FROM}') AS pending_score
              FROM valid GROUP BY {KEY})""",
)
_define(
    "pending_counts",
    "valid",
    f"""SELECT coach_id, session_id, count(*) AS pending FROM valid
        WHERE queued_at >= TIMESTAMP '{PENDING_FROM}' GROUP BY coach_id, session_id""",
)
_define("results_admin", "results", "SELECT * FROM results")
_define(
    "results_ordered",
    "results",
    """SELECT *, row_number() OVER (ORDER BY lower(player_name), player_id, skill_index) AS place
       FROM results""",
)
_define(
    "results_coach", "evaluations players divisions", _results(where=f"coach_id = {COACH}")
)
_define(
    "results_division", "evaluations players divisions", _results(having=f"p.division_id = {DIVISION}")
)
_define(
    "results_json",
    "results",
    """SELECT player_id, skill_index,
        '{"player_id":' || player_id || ',"player_name":"' || player_name || '","age":' ||
        coalesce(CAST(age AS VARCHAR), 'null') || ',"position":"' || position ||
        '","division_id":' || division_id || ',"division_name":"' || division_name ||
        '","skill_index":' || skill_index || ',"skill_name":"' || skill_name ||
        '","avg_score":"' || avg_e4 // 10000 || '.' || lpad(CAST(avg_e4 % 10000 AS VARCHAR), 4, '0') ||
        '","eval_count":' || eval_count || '}' AS record
       FROM results""",
)


def _cells(value: str) -> str:
    names = ("running", "fielding", "pitching", "hitting")
    return ", ".join(
        f"max(CASE WHEN skill_index = {i} THEN {value} END) AS {n}" for i, n in enumerate(names)
    )


_define(
    "results_wide",
    "overall results",
    f"""SELECT * FROM overall JOIN (
            SELECT player_id, {_cells(_TENTHS)} FROM results GROUP BY player_id) USING (player_id)""",
)
_define(
    "score_bands",
    "results",
    f"""SELECT player_id, skill_index, avg_score, {_TENTHS} AS avg_1dp,
               {_band("avg_score")} AS band, {_band(_TENTHS)} AS rounded_band FROM results""",
)
_define("player_overall", "overall", "SELECT * FROM overall")

_BOARD = f"""player_id, player_name,
    concat_ws(', ', CASE WHEN position <> 'Player' THEN position END,
              CASE WHEN age <> 0 THEN 'Age ' || age END) AS subtitle,
    division_id, division_name, skills, overall, overall_1dp, {_band("overall")} AS band,
    CASE rank WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' END AS medal"""
_ALL = "row_number() OVER (ORDER BY overall DESC, player_id)"
_EACH = "row_number() OVER (PARTITION BY division_id ORDER BY overall DESC, player_id)"
for _name, _rank, _where in (
    ("leaderboard", _ALL, "TRUE"),
    ("leaderboard_by_division", _EACH, "TRUE"),
    ("podium", _ALL, "rank <= 3"),
    ("podium_by_division", _EACH, "rank <= 3"),
):
    _define(
        _name,
        "overall",
        f"SELECT rank, {_BOARD} FROM (SELECT *, {_rank} AS rank FROM overall) WHERE {_where}",
    )

_PROGRESS = """
    SELECT session_id, player_id, skill_index, avg_e4,
           avg_e4 / CAST(10000 AS DOUBLE) AS avg_score, coach_count
    FROM (SELECT session_id, player_id, skill_index, {e4} AS avg_e4, count(*) AS coach_count
          FROM {source} GROUP BY session_id, player_id, skill_index)"""
_define("session_progress", "evaluations", _PROGRESS.format(e4=_E4, source="evaluations"))
_define("stream_progress", "streamed_latest", _PROGRESS.format(e4=_E4, source="streamed_latest"))


def _grid(join: str = "LEFT JOIN", where: str = "TRUE") -> str:
    return f"""SELECT session_id, player_id, {_number("player_id")} AS number, name,
               running, fielding, pitching, hitting, {_band("running")} AS running_band,
               {_band("fielding")} AS fielding_band, {_band("pitching")} AS pitching_band,
               {_band("hitting")} AS hitting_band
        FROM (SELECT s.id AS session_id, p.id AS player_id, p.name
              FROM starts s JOIN players p ON p.division_id = s.division_id)
        {join} (SELECT session_id, player_id, {_cells(_TENTHS)}
                   FROM (SELECT session_id, player_id, skill_index, {_E4} AS avg_e4
                         FROM evaluations GROUP BY session_id, player_id, skill_index)
                   GROUP BY session_id, player_id) USING (session_id, player_id)
        WHERE {where}"""


_define("progress_grid", "evaluations starts players", _grid())
_define("progress_grid_session", "evaluations starts players", _grid(where=f"session_id = {SESSION}"))
_define("progress_grid_scored", "evaluations starts players", _grid("JOIN"))
_define(
    "scores_as_map",
    "evaluations",
    """SELECT session_id, coach_id, player_id,
              '{' || string_agg('"' || skill_index || '":' || score, ',' ORDER BY skill_index) || '}' AS scores
       FROM evaluations GROUP BY session_id, coach_id, player_id""",
)
_define(
    "scores_unpivot", "evaluations",
    "SELECT session_id, coach_id, player_id, skill_index, score FROM evaluations",
)

_define("roster_positions", "roster", "SELECT * FROM roster")
_define(
    "roster_neighbours",
    "roster evaluations",
    f"""WITH mine AS (SELECT player_id, score FROM evaluations
                     WHERE {_mine} AND skill_index = {SKILL}),
        around AS (SELECT division_id, player_id, name,
                    lag(player_id) OVER w AS previous_id, lead(player_id) OVER w AS next_id
                   FROM roster WINDOW w AS (PARTITION BY division_id ORDER BY position))
        SELECT a.*, m.score, b.score AS previous_score, n.score AS next_score
        FROM around a LEFT JOIN mine m ON m.player_id = a.player_id
        LEFT JOIN mine b ON b.player_id = a.previous_id
        LEFT JOIN mine n ON n.player_id = a.next_id""",
)
_define(
    "first_unscored",
    "evaluations starts roster",
    """SELECT session_id, coach_id, skill_index,
              coalesce(min(nth) FILTER (place <> nth), count(*)) AS first_unscored,
              any_value(roster_size) - count(*) AS remaining
       FROM (SELECT e.session_id, e.coach_id, e.skill_index, r.roster_size, r.position - 1 AS place,
                    row_number() OVER (PARTITION BY e.session_id, e.coach_id, e.skill_index
                                       ORDER BY r.position) - 1 AS nth
             FROM evaluations e JOIN starts s ON s.id = e.session_id
             JOIN roster r ON r.player_id = e.player_id AND r.division_id = s.division_id)
       GROUP BY session_id, coach_id, skill_index""",
)
_define(
    "unscored_players",
    "players evaluations",
    f"""SELECT id AS player_id, name FROM players WHERE division_id = {SESSION % 100}
        AND id NOT IN (SELECT player_id FROM evaluations WHERE {_mine} AND skill_index = {SKILL})""",
)
_define(
    "remaining_counts",
    "member_scores players",
    """SELECT session_id, coach_id, skill_index, scored, n AS roster_size, n - scored AS remaining
       FROM (SELECT session_id, coach_id, skill_index, division_id, count(*) AS scored
             FROM member_scores GROUP BY ALL)
       JOIN (SELECT division_id, count(*) AS n FROM players GROUP BY division_id) USING (division_id)""",
)
_define("skill_coverage", "coverage", "SELECT * FROM coverage")
_define(
    "session_complete",
    "coverage",
    """SELECT session_id, coach_id, bool_and(none_missing) AS complete,
              bool_and(all_done) AS complete_with_roster, count(*) FILTER (all_done) AS skills_done
       FROM coverage GROUP BY session_id, coach_id""",
)
_define(
    "next_unfinished_skill",
    "coverage",
    """SELECT g.session_id, g.coach_id, k.current_skill,
              coalesce(min(c.skill_index), -1) AS next_skill
       FROM (SELECT DISTINCT session_id, coach_id FROM coverage) g
       CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS current_skill) k
       LEFT JOIN coverage c ON c.session_id = g.session_id AND c.coach_id = g.coach_id
            AND c.skill_index <> k.current_skill AND NOT c.none_missing
       GROUP BY ALL""",
)

_define(
    "player_positions",
    "players",
    f"""SELECT id, {_number("id")} AS number, {_label()} AS position,
               'pos-' || replace({_label()}, '/', '') AS position_code FROM players""",
)
_LIST = f"""SELECT p.id, p.name, p.age, p.is_pitcher, p.is_catcher, p.division_id,
                   d.name AS division_name, {_label()} AS position,
                   row_number() OVER (ORDER BY lower(d.name) NULLS FIRST, lower(p.name), p.id) AS place
            FROM players p LEFT JOIN divisions d ON d.id = p.division_id"""
_define("player_list", "players divisions", _LIST)
_define("player_list_division", "players divisions", f"{_LIST} WHERE p.division_id = {DIVISION}")
for _name, _typed in (("player_search", PLAYER_QUERY), ("player_search_number", PLAYER_NUMBER)):
    _q = _typed.strip().lower()
    _define(
        _name,
        "players",
        f"""SELECT id, {_number("id")} AS number, name FROM players
            WHERE contains(lower(name), '{_q}') OR contains({_number("id")}, '{_q}')
            ORDER BY lower(name), id LIMIT 8""",
    )
SQL["player_search_indexed"] = SQL["player_search"]
_define(
    "player_search_letters",
    "players",
    f"""SELECT id, {_number("id")} AS number, name FROM players
        WHERE contains(lower(name), '{PLAYER_LETTERS}') OR contains({_number("id")}, '{PLAYER_LETTERS}')""",
)
_define(
    "player_search_scored",
    "players evaluations",
    f"""SELECT id, {_number("id")} AS number, name,
               id IN (SELECT player_id FROM evaluations WHERE {_mine} AND skill_index = {SKILL}) AS scored
        FROM players
        WHERE division_id = {SESSION % 100}
          AND (contains(lower(name), '{PLAYER_QUERY.strip()}') OR contains({_number("id")}, '{PLAYER_QUERY.strip()}'))
        ORDER BY lower(name), id LIMIT 8""",
)
_define(
    "review_list",
    "players evaluations",
    f"""SELECT s.skill_index, {_skill("s.skill_index")} AS skill_name, p.place, p.id AS player_id,
               {_number("p.id")} AS number, p.name, nullif({_label()}, 'Player') AS position,
               e.score, {_band("e.score")} AS band
        FROM (SELECT *, row_number() OVER (ORDER BY lower(name), id) AS place
              FROM players WHERE division_id = {SESSION % 100}) p
        CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS skill_index) s
        LEFT JOIN (SELECT * FROM evaluations WHERE {_mine}) e
               ON e.player_id = p.id AND e.skill_index = s.skill_index
        WHERE {SESSION} IN (SELECT year(o_orderdate) * 100 + c_nationkey + 1
                            FROM orders JOIN customer ON o_custkey = c_custkey)""",
)
_define(
    "division_counts",
    "divisions players",
    """SELECT d.id, d.name, count(p.id) AS player_count,
              row_number() OVER (ORDER BY lower(d.name), d.id) AS place
       FROM divisions d LEFT JOIN players p ON p.division_id = d.id GROUP BY d.id, d.name""",
)
_define(
    "coach_list",
    "coaches",
    """SELECT id, name, is_admin, created_at,
              row_number() OVER (ORDER BY is_admin DESC, lower(name), id) AS place FROM coaches""",
)
_define(
    "coach_by_name",
    "coaches",
    """SELECT * FROM coaches WHERE lower(name) IN (
           SELECT lower(trim(' ' || upper(replace(c_name, 'Customer', 'Supplier')))) FROM customer)""",
)

_define(
    "roster_parse", "parsed", "SELECT name, age_text, position_text, division_text FROM parsed"
)
_define(
    "roster_rejects",
    "resolved",
    """SELECT name, age, division_id, CASE WHEN name = '' THEN 'blank_name' ELSE 'zero_name' END AS reason
       FROM resolved WHERE name IN ('', '0')""",
)
_define(
    "roster_import",
    "resolved players",
    """SELECT (SELECT max(id) FROM players) + row_number() OVER (ORDER BY c_custkey) AS id,
              name, age, is_pitcher, is_catcher, division_id, division_unmatched
       FROM resolved WHERE name NOT IN ('', '0')""",
)
_define(
    "import_summary",
    "resolved",
    """SELECT *, 'Imported ' || imported || ' players' AS message FROM (
         SELECT count(*) FILTER (name NOT IN ('', '0')) AS imported,
                count(*) FILTER (name IN ('', '0')) AS rejected,
                count(*) FILTER (name NOT IN ('', '0') AND division_unmatched) AS unmatched
         FROM resolved)""",
)

_define(
    "session_history", "history",
    "SELECT id, division_id, started_at, ended_at, active FROM history",
)
_LEAGUE = """
    SELECT user_id + 1 AS lane, event_id + 1 AS id, user_id % 24 + 1 AS division_id,
           ts AS started_at, lead(ts) OVER w AS ended_at, lead(event_id) OVER w IS NULL AS active,
           event_type
    FROM events WHERE event_type IN ('signup', 'error')
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
_define(
    "session_history_by_league", "",
    f"SELECT * EXCLUDE (event_type) FROM ({_LEAGUE}) WHERE event_type = 'signup'",
)
_define(
    "stream_session_history", "",
    f"SELECT * EXCLUDE (event_type) FROM ({_LEAGUE}) WHERE event_type = 'signup'",
)
_define(
    "stream_active_session", "",
    f"""SELECT lane, id, division_id, started_at FROM ({_LEAGUE})
        WHERE event_type = 'signup' AND active""",
)
_define("session_cursor", "sessions", "SELECT * FROM sessions")
_define(
    "active_session",
    "sessions divisions",
    """SELECT s.id, s.division_id, d.name AS division_name, s.current_skill_index,
              s.current_player_index, s.started_at
       FROM sessions s JOIN divisions d ON d.id = s.division_id
       WHERE s.active ORDER BY s.id DESC LIMIT 1""",
)
_define(
    "field_snapshot",
    "history players evaluations",
    f"""SELECT h.id AS session_id, p.id AS player_id, {_number("p.id")} AS number, p.name,
               {_label()} AS position, e.coach_id, e.skill_index, e.score
        FROM history h JOIN players p ON p.division_id = h.division_id
        LEFT JOIN evaluations e ON e.session_id = h.id AND e.player_id = p.id
        WHERE h.active""",
)

_define(
    "stream_pending_overlay",
    "streamed",
    f"""SELECT {KEY}, arg_max(score, arrival_seq) AS score,
               coalesce(max(arrival_seq) FILTER (arrival_seq % 3 = 2)
                        > coalesce(max(arrival_seq) FILTER (arrival_seq % 3 <> 2), -1), false) AS is_pending
        FROM streamed WHERE {_VALID} GROUP BY {KEY}""",
)
SQL["field_snapshot_chain"] = SQL["field_snapshot"]


def _snapshot(where: str) -> str:
    return f"""SELECT h.id AS session_id, p.id AS player_id, {_number("p.id")} AS number, p.name,
               {_label()} AS position, e.coach_id, e.skill_index, e.score
        FROM history h JOIN players p ON p.division_id = h.division_id
        LEFT JOIN ({_latest(f"(SELECT * FROM valid WHERE {where})")}) e
          ON e.session_id = h.id AND e.player_id = p.id
        WHERE h.active"""


def _changes(step: str, old: str, new: str) -> str:
    picked = ", ".join(
        f"CASE WHEN b.player_id IS NULL THEN a.{c} ELSE b.{c} END AS {c}"
        for c in "player_id number name position coach_id skill_index score session_id".split()
    )
    same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in KEY.split(", "))
    return f"""SELECT {picked}, '{step}' AS step,
               CASE WHEN a.player_id IS NULL THEN 'added' WHEN b.player_id IS NULL THEN 'gone'
                    ELSE 'changed' END AS op
        FROM {old} a FULL JOIN {new} b ON {same}
        WHERE a.player_id IS NULL OR b.player_id IS NULL OR a.score IS DISTINCT FROM b.score"""


_define(
    "snapshot_changes",
    "history players valid",
    f"""WITH one AS ({_snapshot("(arrival_seq >> 4) % 2 = 0")}), two AS ({_snapshot("(arrival_seq >> 4) % 2 = 1")}),
             three AS ({_snapshot("TRUE")})
        {_changes("2-3", "two", "three")} UNION ALL {_changes("3-1", "three", "one")}""",
)

_define(
    "append_with_ids",
    "players",
    """SELECT (SELECT max(id) FROM players) + row_number() OVER (ORDER BY s_suppkey) AS id,
              s_name AS name FROM supplier WHERE s_suppkey % 9 <> 4""",
)
_define(
    "insert_if_absent",
    "divisions demo_names",
    """SELECT (SELECT max(id) FROM divisions) + row_number() OVER (ORDER BY seq) AS id, name
       FROM (SELECT name, seq FROM demo_names
             UNION ALL SELECT lower(n_name), n_nationkey + 100 FROM nation
             UNION ALL SELECT r_name, r_regionkey + 1000 FROM region)
       WHERE lower(name) NOT IN (SELECT lower(name) FROM divisions)""",
)
_define(
    "apply_player_updates",
    "players",
    """SELECT p.id, CASE WHEN c.id IS NULL THEN p.name ELSE upper(p.name) END AS name,
              CASE WHEN c.id IS NULL THEN p.age ELSE p.age + 1 END AS age,
              CASE WHEN c.id IS NULL THEN p.is_pitcher ELSE NOT p.is_pitcher END AS is_pitcher,
              p.is_catcher, CASE WHEN c.id IS NULL THEN p.division_id END AS division_id
       FROM players p LEFT JOIN (SELECT c_custkey + 1 AS id FROM customer
            WHERE c_acctbal < 0 AND (c_custkey + 1) % 10 <> 3) c ON c.id = p.id""",
)
_REQUESTED = """
    SELECT c_custkey AS seq, c_custkey % 37 = 5 AS malformed,
           CASE WHEN c_custkey % 23 <> 1 AND c_custkey % 29 = 2 THEN 0 ELSE c_custkey + 1 END AS id,
           CASE c_custkey % 10 WHEN 2 THEN '' WHEN 3 THEN '0' ELSE upper(c_name) END AS name,
           CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 0 WHEN 3 THEN 9
                ELSE 8 + c_custkey % 7 END AS age,
           c_custkey % 3 = 2 AS is_pitcher, c_custkey % 4 = 1 AS is_catcher,
           CASE WHEN c_custkey % 6 > 2 THEN c_custkey % 24 + 1 END AS division_id,
           c_custkey % 7 = 4 AS scientific
    FROM customer WHERE c_acctbal < 0
    UNION ALL
    SELECT c_custkey + 1099511627776, FALSE, c_custkey + 1, upper(c_name) || ' II', NULL, FALSE, FALSE, 1, FALSE
    FROM customer WHERE c_acctbal < 0 AND c_custkey % 4 = 0"""
_REASON = """CASE WHEN malformed THEN 'malformed' WHEN id = 0 THEN 'missing_id'
                  WHEN name IN ('', '0') THEN 'missing_name' WHEN scientific THEN 'scientific_notation' END"""
_define(
    "player_updates_from_json",
    "players",
    f"""SELECT p.id, CASE WHEN u.id IS NULL THEN p.name ELSE u.name END AS name,
               CASE WHEN u.id IS NULL THEN p.age ELSE u.age END AS age,
               CASE WHEN u.id IS NULL THEN p.is_pitcher ELSE u.is_pitcher END AS is_pitcher,
               CASE WHEN u.id IS NULL THEN p.is_catcher ELSE u.is_catcher END AS is_catcher,
               CAST(CASE WHEN u.id IS NULL THEN p.division_id ELSE u.division_id END AS BIGINT) AS division_id
        FROM players p LEFT JOIN (
            SELECT * FROM ({_REQUESTED}) WHERE {_REASON} IS NULL
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) u ON u.id = p.id""",
)
_define(
    "player_update_rejects",
    "",
    f"""SELECT {_REASON} AS reason, count(*) AS requests FROM ({_REQUESTED})
        WHERE {_REASON} IS NOT NULL GROUP BY 1""",
)
_define(
    "delete_divisions",
    "divisions players starts",
    """SELECT 'division' AS kind, id, id AS division_id FROM divisions
       WHERE id IN (SELECT division_id FROM starts)
       UNION ALL
       SELECT 'player', id, CASE WHEN division_id IN (SELECT division_id FROM starts)
                                 THEN division_id END FROM players
       UNION ALL
       SELECT 'player', s_suppkey + 1099511627776, NULL FROM supplier""",
)


def _outcome(kind: str, table: str, key: str, admin: str) -> str:
    return f"""
        SELECT '{kind}' AS kind, r.id,
               CASE WHEN t.id IS NULL THEN 'missing' WHEN {admin} THEN 'protected'
                    WHEN r.id IN (SELECT {key} FROM evaluations) THEN 'restricted'
                    ELSE 'deleted' END AS outcome
        FROM (SELECT id FROM {table} UNION SELECT id + 1 FROM {table}) r
        LEFT JOIN {table} t ON t.id = r.id"""


_define(
    "delete_restricted",
    "players coaches evaluations",
    _outcome("player", "players", "player_id", "FALSE")
    + " UNION ALL "
    + _outcome("coach", "coaches", "coach_id", "t.is_admin"),
)
_define(
    "reset_players",
    "evaluations streamed_latest players",
    """SELECT * FROM (SELECT * FROM evaluations UNION ALL SELECT * FROM streamed_latest)
       WHERE player_id NOT IN (SELECT id FROM players WHERE division_id IS NOT NULL)""",
)
_define(
    "reset_every_player",
    "evaluations streamed_latest players",
    """SELECT 'evaluations' AS kind, count(*) AS before,
              count(*) FILTER (player_id NOT IN (SELECT id FROM players)) AS left
       FROM (SELECT * FROM evaluations UNION ALL SELECT * FROM streamed_latest)
       UNION ALL SELECT 'players', count(*), 0 FROM players""",
)
_define(
    "reset_coaches",
    "evaluations coaches",
    """SELECT * FROM evaluations
       WHERE coach_id NOT IN (SELECT id FROM coaches WHERE NOT is_admin)""",
)
_KEY_TEXT = "concat_ws('/', session_id, player_id, coach_id, skill_index)"
_define(
    "integrity_report",
    "evaluations streamed_latest submissions streamed players coaches sessions divisions",
    f"""
    WITH e AS (SELECT * FROM evaluations UNION ALL SELECT * FROM streamed_latest),
    sub AS (SELECT * FROM submissions UNION ALL SELECT * FROM streamed)
    SELECT 'orphan_session' AS rule, {_KEY_TEXT} AS key, CAST(session_id AS VARCHAR) AS detail
    FROM e WHERE session_id NOT IN (SELECT id FROM sessions)
    UNION ALL SELECT 'orphan_player', {_KEY_TEXT}, CAST(player_id AS VARCHAR)
    FROM e WHERE player_id NOT IN (SELECT id FROM players)
    UNION ALL SELECT 'orphan_coach', {_KEY_TEXT}, CAST(coach_id AS VARCHAR)
    FROM e WHERE coach_id NOT IN (SELECT id FROM coaches)
    UNION ALL SELECT 'unknown_skill', {_KEY_TEXT}, CAST(skill_index AS VARCHAR)
    FROM e WHERE skill_index >= 4
    UNION ALL SELECT 'inactive_session_score', {_KEY_TEXT}, CAST(session_id AS VARCHAR)
    FROM e JOIN sessions s ON s.id = e.session_id
    WHERE e.created_at < s.started_at OR e.created_at >= s.ended_at
    UNION ALL SELECT 'player_division_mismatch', {_KEY_TEXT}, CAST(p.division_id AS VARCHAR)
    FROM e JOIN sessions s ON s.id = e.session_id JOIN players p ON p.id = e.player_id
    WHERE s.division_id IS DISTINCT FROM p.division_id
    UNION ALL SELECT 'score_out_of_range', {_KEY_TEXT}, CAST(score AS VARCHAR)
    FROM sub WHERE score NOT BETWEEN 1 AND 10
    UNION ALL SELECT 'duplicate_key', {_KEY_TEXT}, CAST(count(*) AS VARCHAR)
    FROM sub WHERE {_VALID} GROUP BY {KEY} HAVING count(*) > 1
    UNION ALL SELECT 'orphan_player_division', CAST(id AS VARCHAR), 'division ' || division_id
    FROM players WHERE division_id NOT IN (SELECT id FROM divisions)
    UNION ALL SELECT 'orphan_session_division', CAST(id AS VARCHAR), 'division ' || division_id
    FROM sessions WHERE division_id NOT IN (SELECT id FROM divisions)
    UNION ALL SELECT 'session_skill_out_of_range', CAST(id AS VARCHAR), CAST(current_skill_index AS VARCHAR)
    FROM sessions WHERE current_skill_index >= 4
    UNION ALL SELECT 'several_active_sessions', 'sessions', CAST(count(*) AS VARCHAR)
    FROM sessions WHERE active HAVING count(*) > 1""",
)
_define(
    "synth_roster",
    "divisions",
    f"""
    WITH drawn AS (
        SELECT id AS division_id, n,
               {_names(GIVEN_NAMES)}[{_draw(len(GIVEN_NAMES), "given", "id", "n")} + 1] || ' ' ||
               {_names(FAMILY_NAMES)}[{_draw(len(FAMILY_NAMES), "family", "id", "n")} + 1] AS name,
               {MIN_AGE} + {_draw(MAX_AGE - MIN_AGE + 1, "age", "id", "n")} AS age,
               1 + {_draw(100, "role", "id", "n")} AS roll
        FROM (SELECT id, CAST(unnest(range(1, {PLAYERS_PER_DIVISION + 1})) AS INTEGER) AS n FROM divisions))
    SELECT division_id, n,
           CASE WHEN row_number() OVER (PARTITION BY division_id, name ORDER BY n) = 1 THEN name
                ELSE name || ' ' || n END AS name,
           age, roll <= {PITCHER_SHARE} AS is_pitcher,
           roll > {PITCHER_SHARE} AND roll <= {PITCHER_SHARE + CATCHER_SHARE} AS is_catcher
    FROM drawn""",
)
_PAIRS = len(GIVEN_NAMES) * len(FAMILY_NAMES)
_define(
    "synth_coaches",
    "divisions",
    f"""
    SELECT id AS group_id, n,
           {_names(GIVEN_NAMES)}[pair // {len(FAMILY_NAMES)} + 1] || ' ' ||
           {_names(FAMILY_NAMES)}[pair % {len(FAMILY_NAMES)} + 1] ||
           CASE WHEN place >= {_PAIRS} THEN ' ' || (place // {_PAIRS} + 1) ELSE '' END AS name,
           FALSE AS is_admin
    FROM (SELECT *, ({_draw(_PAIRS, "coach")} + place % {_PAIRS} * {_stride(_PAIRS)}) % {_PAIRS} AS pair
          FROM (SELECT id, n, id * {DEMO_COACHES} + n - 1 AS place FROM (
              SELECT id, CAST(unnest(range(1, {DEMO_COACHES + 1})) AS INTEGER) AS n FROM divisions)))""",
)

_define("stream_submissions_latest", "streamed_latest", "SELECT * FROM streamed_latest")
_define(
    "stream_quarantine",
    "streamed",
    f"""SELECT *, concat_ws(',', CASE WHEN session_id = 0 THEN 'missing_session' END,
               CASE WHEN player_id = 0 THEN 'missing_player' END,
               CASE WHEN skill_index < 0 THEN 'bad_skill_index' END,
               CASE WHEN score NOT BETWEEN 1 AND 10 THEN 'bad_score' END) AS reasons
        FROM streamed WHERE NOT ({_VALID})""",
)
_define(
    "stream_replay_summary",
    "streamed",
    f"""SELECT 'submissions' AS kind, count(*) FILTER ({_VALID}) AS accepted,
               count(*) FILTER (NOT ({_VALID})) AS rejected,
               count(*) FILTER (arrival_seq % 10 = 0) AS repeated
        FROM streamed
        UNION ALL
        SELECT 'deliveries', count(*) FILTER ({_VALID}), count(*) FILTER (NOT ({_VALID})), 0
        FROM (SELECT * FROM streamed UNION ALL SELECT * FROM streamed WHERE arrival_seq % 10 = 0)""",
)
_define("stream_keyed_latest", "streamed_latest", f"SELECT {KEY}, score FROM streamed_latest")
