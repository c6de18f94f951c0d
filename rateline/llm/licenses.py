"""Licence notices, found by the Dice coefficient over word bigrams.

A text is normalised to lower-case letter and digit runs, whatever its lines, and compared with
every template in windows of consecutive words. With c of a template's m different bigrams in a window
and n bigrams there, 2c / (n + m) >= t needs c >= m t / (2 - t) and n <= m (2 - t) / t: these
bounds prune texts, templates and windows before any of them is compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rateline.sources.workspace import materialize

THRESHOLD = 0.75

#: Short notices of common licences. Fixed values.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:"
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction"
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ),
}


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), "[^\\p{L}\\p{N}]+"), "")


def pairs_of(words: Column) -> Column:
    """Each neighbouring pair, in order."""
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(
            F.slice(words, 1, F.size(words) - 1),
            F.slice(words, 2, F.size(words) - 1),
            lambda a, b: F.concat_ws(" ", a, b),
        )
    )


def template_bigrams(spark, templates: dict[str, str], threshold: float) -> DataFrame:
    """bigram, template, size, least, longest; as long as the given templates.

    ``least`` is the number of shared bigrams a window needs, ``longest`` the number of
    bigrams, repeated ones too, it may have.
    """
    rows = spark.createDataFrame(sorted(templates.items()), "template string, text string")
    pairs = rows.select("template", pairs_of(words_of(F.col("text"))).alias("pairs"))
    size = F.size(F.array_distinct("pairs"))
    return pairs.select(
        F.explode(F.array_distinct("pairs")).alias("bigram"),
        "template",
        size.alias("size"),
        F.ceil(size * F.lit(threshold / (2 - threshold)) - 1e-9).alias("least"),
        F.floor(F.size("pairs") * F.lit((2 - threshold) / threshold) + 1e-9).alias("longest"),
    )


def _may_hold(text: Column, known: DataFrame) -> Column:
    """False only where no window can reach the threshold.

    A window has ``least`` of a template's bigrams, and each of them has two places for words: the words
    that the text and the template share must have twice ``least`` places or more.
    """
    templates: dict[str, tuple[dict[str, int], int]] = {}
    for row in known.collect():  # as long as the given templates
        places, _ = templates.setdefault(row.template, ({}, row.least))
        for word in row.bigram.split(" "):
            places[word] = places.get(word, 0) + 1
    if not templates:
        return F.lit(False)
    every = sorted({w for places, _ in templates.values() for w in places})

    def possible(shared: Column, places: dict[str, int], least: int) -> Column:
        there = [F.when(F.array_contains(shared, w), n).otherwise(0) for w, n in places.items()]
        return reduce(lambda a, b: a + b, there) >= 2 * least

    # Bound to a variable, the shared words are found once.
    return F.exists(
        F.array(F.array_intersect(words_of(text), F.array(*[F.lit(w) for w in every]))),
        lambda shared: reduce(lambda a, b: a | b, [possible(shared, *t) for t in templates.values()]),
    )


def _hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_key, template, at, bigram, first, last: where a text has a template's bigram.

    ``at`` counts bigrams from 0; ``first`` and ``last`` are the lines of its two words.
    """
    lines = F.transform(F.split("text", "\n"), words_of)
    numbers = F.flatten(F.transform("lines", lambda l, i: F.array_repeat(i, F.size(l))))
    many = F.greatest(F.size("words") - 1, F.lit(0))
    placed = (
        docs.filter(_may_hold(F.col("text"), known))
        .select("doc_id", F.xxhash64("text").alias("text_key"), lines.alias("lines"))
        .select("doc_id", "text_key", F.flatten("lines").alias("words"), numbers.alias("line"))
        .select(
            "doc_id",
            "text_key",
            F.posexplode(
                F.arrays_zip(
                    pairs_of(F.col("words")).alias("bigram"),
                    F.slice("line", F.lit(1), many).alias("first"),
                    F.slice("line", F.lit(2), many).alias("last"),
                )
            ).alias("at", "_pair"),
        )
        .select("doc_id", "text_key", "at", "_pair.*")
    )
    # The templates given, a few hundred rows. Equal rows of the table give equal hits.
    return placed.join(F.broadcast(known), "bigram").dropDuplicates(["doc_id", "text_key", "template", "at"])


def _windows(hits: DataFrame, threshold: float) -> DataFrame:
    """The best window from each hit on, if it reaches the threshold.

    A window that starts or ends with another bigram is beaten by the shorter one without it, so only those
    from hit to hit are compared. A bigram of the template counts once in a
    window, every other one as often as it stands there.
    """
    text = Window.partitionBy("doc_id", "text_key", "template").orderBy("at")
    # A frame's bounds are constants: the longest template's. Each start drops what its own excludes.
    longest = hits.agg(F.max("longest")).first()[0] or 1
    ahead = text.rangeBetween(Window.currentRow, longest - 1)
    within = F.filter("ahead", lambda h: h["at"] < F.col("at") + F.col("longest"))
    shared = F.size(F.array_distinct(F.slice("within", F.lit(1), F.col("k")).getField("bigram")))
    end = F.element_at("within", F.col("k"))
    n = F.col("shared") + (F.col("end.at") - F.col("at") + 1 - F.col("k"))
    return (
        hits.withColumn("ahead", F.collect_list(F.struct("at", "bigram", "last")).over(ahead))
        .withColumn("within", within)
        .filter(F.size(F.array_distinct(F.col("within").getField("bigram"))) >= F.col("least"))
        .select(
            "doc_id", "text_key", "template", "at", "first", "size", "least", "within",
            F.explode(F.sequence(F.col("least").cast("int"), F.size("within"))).alias("k"),
        )
        .select("*", shared.alias("shared"), end.alias("end"))
        .withColumn("bigrams", n)
        .withColumn("dice", 2.0 * F.col("shared") / (F.col("bigrams") + F.col("size")))
        .filter(F.col("dice") >= threshold)
        .groupBy("doc_id", "text_key", "template", "at", "first")
        .agg(
            F.min_by(
                F.struct("shared", "bigrams", "dice", F.col("end.at").alias("to"), "end.last"),
                F.struct((-F.col("dice")).alias("d"), F.col("end.at").alias("to")),
            ).alias("best")
        )
        .select("doc_id", "text_key", "template", "at", "first", "best.*")
    )


def scan(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, line_no, last_line (from 0), word_no, license, shared, bigrams, dice of each notice.

    A notice may be part of a line or go over lines; ``word_no`` is its first word. Of windows that
    overlap, the one that shares most bigrams stays, then the one with the higher
    coefficient, the smaller name, the earlier start; then the next that overlaps none that stays, and so on. Null
    and empty texts have no rows; equal rows of ``docs`` are reported once;
    other columns are left out. Templates of fewer than two words match nothing.
    """
    known = template_bigrams(docs.sparkSession, templates, threshold)
    hits = materialize(_hits(docs, known), "license-hits")
    # Runs of overlapping windows of a text are independent of each other.
    before = Window.partitionBy("doc_id", "text_key").orderBy("at", "to", "template")
    reached = F.max("to").over(before.rowsBetween(Window.unboundedPreceding, -1))
    windows = (
        _windows(hits, threshold)
        .withColumn("_new", F.coalesce(F.col("at") > reached, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("_new").over(before))
    )
    ordered = F.struct(
        (-F.col("shared")).alias("less"), (-F.col("dice")).alias("worse"), "template", "at", "to",
        "first", "last", "shared", "bigrams", "dice",
    )
    runs = windows.groupBy("doc_id", "text_key", "run").agg(
        F.array_sort(F.collect_list(ordered)).alias("found")
    )
    none = F.filter("found", lambda w: F.lit(False))
    stay = F.aggregate(
        "found",
        none,
        lambda kept, w: F.when(
            F.exists(kept, lambda k: (k["at"] <= w["to"]) & (w["at"] <= k["to"])), kept
        ).otherwise(F.concat(kept, F.array(w))),
    )
    return runs.select("doc_id", F.explode(stay).alias("w")).select(
        "doc_id",
        F.col("w.first").alias("line_no"),
        F.col("w.last").alias("last_line"),
        F.col("w.at").alias("word_no"),
        F.col("w.template").alias("license"),
        "w.shared",
        "w.bigrams",
        "w.dice",
    )
