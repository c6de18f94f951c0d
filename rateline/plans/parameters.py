"""Arguments the registered queries are run with; the SQL uses the same ones."""

COACH = 7
DIVISION = 3
SESSION = 199603
SKILL = 1
DEFAULT_DIVISION = 4
PLAYER_QUERY = " 00012 "
PENDING_FROM = "2001-01-01"
PLAYER_NUMBER = "014"
PLAYER_LETTERS = "9"
KEYED_BUCKETS = 16
