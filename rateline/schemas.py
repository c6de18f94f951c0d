"""Declared schemas. Ids are 64-bit, so that large deployments do not overflow."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S, _B = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
_TS = T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


DIVISIONS = _struct(id=_L, name=_S)
COACHES = _struct(id=_L, name=_S, is_admin=_B, created_at=_TS)
PLAYERS = _struct(id=_L, name=_S, age=_L, is_pitcher=_B, is_catcher=_B, division_id=_L)
SESSIONS = _struct(
    id=_L,
    division_id=_L,
    current_skill_index=_I,
    current_player_index=_I,
    active=_B,
    started_at=_TS,
    ended_at=_TS,
)
SUBMISSIONS = _struct(
    session_id=_L,
    player_id=_L,
    coach_id=_L,
    skill_index=_I,
    score=_I,
    arrival_seq=_L,
    created_at=_TS,
    queued_at=_TS,
)
EVALUATIONS = _struct(
    session_id=_L,
    player_id=_L,
    coach_id=_L,
    skill_index=_I,
    skill_name=_S,
    score=_I,
    created_at=_TS,
)
COMMANDS = _struct(
    lane=_L, seq=_L, ts=_TS, command=_S, division_id=_L, session_id=_L
)

# Loosely typed JSON input: every field is read as text and coerced afterwards.
SUBMISSION_JSON = _struct(
    id=_S,
    session_id=_S,
    player_id=_S,
    coach_id=_S,
    skill_index=_S,
    score=_S,
    queued_at=_L,
    _corrupt_record=_S,
)
# What coercion makes of it, with the line it came from.
PAYLOADS = _struct(
    payload=_S,
    arrival_seq=_L,
    session_id=_L,
    player_id=_L,
    skill_index=_L,
    score=_L,
    coach_id=_L,
    queued_at=_TS,
    created_at=_TS,
    malformed=_B,
    scientific=_B,
)
#: ``seq`` numbers the requests as they came.
UPDATE_JSON = _struct(
    seq=_L,
    id=_S,
    name=_S,
    age=_S,
    is_pitcher=_S,
    is_catcher=_S,
    division_id=_S,
    _corrupt_record=_S,
)
_PLAYER_JSON = _struct(name=_S, age=_S, is_pitcher=_S, is_catcher=_S, division_id=_S)
IMPORT_JSON = _struct(
    players=T.ArrayType(_PLAYER_JSON), default_division_id=_S, _corrupt_record=_S
)

# JSON would keep milliseconds only.
JSON_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

EVALUATION_KEY = ["session_id", "player_id", "coach_id", "skill_index"]
