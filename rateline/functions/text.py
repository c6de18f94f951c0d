"""Text cleaning and coercion of loosely typed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters each side of the input path strips.
SERVER_BLANKS = " \t\n\r\x00\x0b"
CLIENT_BLANKS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Equality and order of names ignore case, accents and trailing spaces.
NAME_COLLATION = "UNICODE_CI_AI_RTRIM"

_LEADING_INT = r"^[ \t\n\r\x0B\f]*([+-]?[0-9]+)"
_SCIENTIFIC = r"^[ \t\n\r\x0B\f]*[+-]?[0-9]+(\.[0-9]*)?[eE][+-]?[0-9]"
MAX_INT = 2147483647


def trim_client(c: Column) -> Column:
    return F.btrim(c, F.lit(CLIENT_BLANKS))


def trim_server(c: Column) -> Column:
    return F.btrim(c, F.lit(SERVER_BLANKS))


def name_key(c: Column) -> Column:
    return F.collate(c, NAME_COLLATION)


def valid_name(c: Column) -> Column:
    """A name counts unless it is missing, blank, or the text "0"."""
    return ~F.coalesce(trim_server(c), F.lit("")).isin("", "0")


def leading_int(c: Column) -> Column:
    """The integer a text starts with, else 0.

    Too long a run of digits stays out of range (the largest bigint) rather
    than becoming 0, so that it cannot turn into a valid index.
    """
    digits = F.regexp_extract(c, _LEADING_INT, 1)
    number = digits.try_cast("bigint")
    return (
        F.when(number.isNotNull(), number)
        .when(digits.startswith("-"), F.lit(-9223372036854775807))
        .when(F.length(digits) > 0, F.lit(9223372036854775807))
        .otherwise(F.lit(0).cast("bigint"))
    )


def is_scientific(c: Column) -> Column:
    return F.coalesce(c.rlike(_SCIENTIFIC), F.lit(False))


def optional_int(c: Column) -> Column:
    """Missing or empty stays missing; any other text is coerced, "abc" to 0."""
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("bigint")).otherwise(leading_int(c))


def reference_id(c: Column) -> Column:
    """An id from text, where 0 means none."""
    return F.nullif(leading_int(c), F.lit(0).cast("bigint"))


def truthy(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).isin("", "0", "false")
