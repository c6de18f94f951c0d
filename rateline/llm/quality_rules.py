"""Quality rules: a threshold table compiled into one projection.

Every measure is a Column over the text and every rule compares integers, so
the whole operator is one scan without shuffles, Python or rounding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages. Fixed values.
STOP_WORDS = (
    "the of to and in a is that for it was on are with as be this have from or an at by not "
    "der die das und in zu den von mit ist des sich auf für im dem nicht ein eine als auch "
    "el la de que y en un ser se no por con su para como los las del una "
    "le les et des est pas pour qui dans sur au avec ce il elle une du"
).split()


@dataclass(frozen=True)
class Threshold:
    """Keep a text when ``low * over <= scale * measure <= high * over``."""

    name: str
    measure: str
    over: str
    scale: int
    low: int | None
    high: int | None


#: Ratios in hundredths unless the scale says otherwise.
THRESHOLDS = (
    Threshold("length", "n_words", "one", 1, 50, 1_000_000),
    Threshold("mean_word", "word_chars", "n_words", 10, 20, 150),
    Threshold("symbols", "n_symbols", "n_words", 100, None, 10),
    Threshold("stop_words", "n_stop_words", "n_words", 100, 2, None),
    Threshold("repeated_lines", "n_dup_lines", "n_lines", 100, None, 50),
)


def _length_of(text: Column, *, without: str) -> Column:
    return F.length(F.translate(text, without, ""))


def words_of(text: Column) -> Column:
    """Maximal runs of anything but the six ASCII blanks; none for blank text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once.

    The optimizer writes a column into every place that names it, lambdas included, which
    would split a text anew for each of its words. It leaves a lambda's variable alone.
    """
    return F.transform(F.array(value), body)[0]


_POSITION_BITS = 20


def _repeats(words: Column, n: Column) -> Column:
    """How many words stand in windows of three that are found twice or more.

    Windows are sorted as longs (44 hash bits, 20 bits of place) and neighbours
    compared. Neighbours with equal hashes but different words send that text
    to the exact branch, which sorts the words themselves; so do longer texts.
    """
    mask = (1 << _POSITION_BITS) - 1
    starts = F.sequence(F.lit(1), n.cast("int") - 2)
    at = lambda i: F.get(words, i)

    def key(i: Column) -> Column:
        return F.xxhash64(at(i - 1), at(i), at(i + 1)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint"))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(mask)).cast("int")

    def neighbours(keys: Column) -> Column:
        def pair(x: Column, y: Column) -> Column:
            same = F.shiftright(x, _POSITION_BITS) == F.shiftright(y, _POSITION_BITS)
            return F.when(same, F.struct(place(x).alias("a"), place(y).alias("b")))

        following = F.slice(keys, 2, F.greatest(F.size(keys), F.lit(1)))
        return F.filter(F.zip_with(keys, following, pair), lambda z: z.isNotNull())

    def differ(z: Column) -> Column:
        return (
            (at(z.a - 1) != at(z.b - 1)) | (at(z.a) != at(z.b)) | (at(z.a + 1) != at(z.b + 1))
        )

    def covered(pairs: Column) -> Column:
        spread = F.transform(pairs, lambda z: F.array(z.a, z.a + 1, z.a + 2, z.b, z.b + 1, z.b + 2))
        return F.size(F.array_distinct(F.flatten(spread)))

    def alike(x: Column, y: Column) -> Column:
        same = (x.p == y.p) & (x.q == y.q) & (x.r == y.r)
        return F.when(same, F.struct(x.a.alias("a"), y.a.alias("b")))

    windows = F.sort_array(F.transform(starts, lambda i: F.struct(
        at(i - 1).alias("p"), at(i).alias("q"), at(i + 1).alias("r"), i.alias("a"))))
    exact = _bound(windows, lambda s: covered(F.filter(
        F.zip_with(s, F.slice(s, 2, F.size(s)), alike), lambda z: z.isNotNull())))
    hashed = _bound(F.sort_array(F.transform(starts, key)), lambda keys: _bound(
        neighbours(keys), lambda pairs: F.when(F.exists(pairs, differ), exact).otherwise(covered(pairs))))
    return F.when(n < 3, 0).when(n > mask, exact).otherwise(hashed).cast("bigint")


def measures(text: Column) -> Column:
    """The measures of a text that is not null, as a struct."""
    stop = list(dict.fromkeys(STOP_WORDS))

    def of_words(text: Column, words: Column, lines: Column) -> Column:
        found = {
            "n_words": F.size(words),
            "n_repeat_words": _repeats(words, F.size(words)),
            "word_chars": _length_of(text, without=SPACES),
            "n_symbols": F.length(text) - _length_of(text, without=SYMBOLS),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stop))),
        }
        return F.struct(F.lit(1).alias("one"), *[c.cast("bigint").alias(k) for k, c in found.items()])

    full_lines = lambda t: F.filter(F.split(t, "\n"), lambda s: F.btrim(s, F.lit(SPACES)) != "")
    return _bound(text, lambda t: _bound(
        words_of(t), lambda w: _bound(full_lines(t), lambda lines: of_words(t, w, lines))))


def compile_thresholds(table: tuple[Threshold, ...], of: Callable[[str], Column] = F.col) -> Column:
    """The names of the rules that a row breaks, as an array column; ``of`` gives a measure."""
    broken = []
    for t in table:
        scaled, over, fails = of(t.measure) * t.scale, of(t.over), F.lit(False)
        if t.low is not None:
            fails |= scaled < over * t.low
        if t.high is not None:
            fails |= scaled > over * t.high
        broken.append(F.when(fails, F.lit(t.name)))
    return F.filter(F.array(*broken), lambda n: n.isNotNull())


MEASURES = ("n_words", "n_repeat_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words")


def judge(docs: DataFrame, table: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: measures, broken rules, verdict.

    base_failed: under 50 words, or more than half of the words in repeated
    windows of three. kept: neither base_failed nor any broken threshold. Null
    and blank texts have no words and fail. Repeated rows are judged each, and
    other columns of ``docs``, whatever their names, are left out. All of it is one
    expression, so that a filter on the verdict works out a text twice at most.
    """

    def verdict(m: Column) -> Column:
        failed = (m.n_words < 50) | (m.n_repeat_words * 100 > m.n_words * 50)
        return _bound(compile_thresholds(table, m.getField), lambda broken: F.struct(
            *[m.getField(name).alias(name) for name in MEASURES],
            failed.alias("base_failed"),
            broken.alias("broken"),
            (~failed & (F.size(broken) == 0)).alias("kept"),
        ))

    judged = _bound(measures(F.coalesce(F.col("text"), F.lit(""))), verdict)
    return docs.select("doc_id", judged.alias("judged")).select("doc_id", "judged.*")
