"""How far the words of each source stray from the other sources of its language.

A term is a run of letters (A-Z, a-z and everything beyond ASCII), with only A-Z lower-cased.

Counting. A task holds its rows as Arrow buffers and never cuts them into words: it
keeps a pointer to the start of each word and sorts the pointers by what they point to, a
multikey quicksort whose digit is eight bytes. Pointers that a digit leaves tied are
sorted by the next eight bytes, until the words end. Equal words then form runs; of a
run, changes of document give the document frequency, and documents by source the counts.
Spark adds the runs of all slices up.

Comparing. Shares are whole numbers (``SCALE`` is one). For every two sources of a
language all its terms are compared in tables of sources by terms of bounded size, so no
row is made for a term and two sources; only the sums of a table leave its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rateline.sources.workspace import materialize

MIN_DOCUMENTS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
#: Bytes of text whose words are sorted at once; a longer text is taken in such pieces.
SLICE = 4 << 20
#: Cells of a table of sources by terms, and sources in a block; a table has two blocks at most.
TABLE = 1 << 17
SOURCES = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True
#: Masks of the first 0 to 8 bytes of a big-endian digit.
_KEEP = np.array([0] + [(0xFFFFFFFFFFFFFFFF << (64 - 8 * n)) & 0xFFFFFFFFFFFFFFFF for n in range(1, 9)], np.uint64)


def word_starts(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in lower-cased bytes; no word goes over an edge of a text."""
    letter = np.zeros(len(data) + 1, bool)
    letter[:-1] = _LETTER[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = letter[:-1]
    edges = edges[edges < len(data)]
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    starts = np.flatnonzero(letter & (~before | cut))
    ends = np.flatnonzero(before & (~letter | cut))
    return starts, ends


def _digits(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each pointer on as a number; bytes past the word count as zero."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)[at]
    return np.ascontiguousarray(eight).view(">u8").reshape(-1).astype(np.uint64) & _KEEP[np.minimum(left, 8)]


def sort_pointers(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the words, equal ones as they stand in the text, and where runs of equal ones begin.

    ``data`` ends in eight spare bytes. Words hold no zero byte, so a shorter word comes before
    those that go on from it.
    """
    order = np.arange(len(starts))
    new = np.zeros(len(starts), bool)
    new[:1] = True
    open_, depth = np.arange(len(starts)), 0  # places in the order that are still tied
    group = np.zeros(len(starts), np.int64)
    while len(open_):
        words = order[open_]
        left = np.maximum(lengths[words] - depth, 0)
        digit = _digits(data, np.where(left > 0, starts[words] + depth, 0), left)
        by = np.lexsort((digit, group)) if depth else np.argsort(digit, kind="stable")
        order[open_] = words[by]
        digit, group, left = digit[by], group[by], left[by]
        apart = np.ones(len(by), bool)
        apart[1:] = (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])
        new[open_[apart]] = True
        # Ties whose words go on past this digit are sorted by the next one.
        group = np.cumsum(apart) - 1
        tied = (np.bincount(group)[group] > 1) & (np.bincount(group, weights=left > 8)[group] > 0)
        open_, group, depth = open_[tied], group[tied], depth + 8
    return order, np.flatnonzero(new)


def count_slice(data: bytes | np.ndarray, edges: np.ndarray, groups: np.ndarray):
    """Of texts that begin at ``edges``: (group, word, occurrences, documents), a row per group and word.

    ``groups`` numbers the group of each text.
    """
    low = np.zeros(len(data) + 8, np.uint8)
    low[: len(data)] = _LOWER[np.frombuffer(data, np.uint8)]
    starts, ends = word_starts(low[: len(data)], edges)
    if not len(starts):
        return []
    order, runs = sort_pointers(low, starts, ends - starts)
    text_of = np.searchsorted(edges, starts[order], side="right") - 1
    word_of = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(order))))
    change = np.ones(len(order), bool)
    change[1:] = (text_of[1:] != text_of[:-1]) | (word_of[1:] != word_of[:-1])
    met = np.flatnonzero(change)  # the first place of a word in each text that has it
    times = np.diff(np.append(met, len(order)))
    n_groups = int(groups.max()) + 1
    key = word_of[met] * n_groups + groups[text_of[met]]
    by = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(key[by]) > 0))
    found, raw = key[by][first], low.tobytes()
    at = order[runs]
    words = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
    return list(zip(
        (found % n_groups).tolist(),
        [words[w] for w in (found // n_groups).tolist()],
        np.add.reduceat(times[by], first).tolist(),
        np.diff(np.append(first, len(by))).tolist(),
    ))


def _long_text(text: bytes):
    """Rows as of ``count_slice`` for one text, piece by piece; a document counts once a word."""
    seen: set[bytes] = set()
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and _LETTER[_LOWER[text[end]]] and _LETTER[_LOWER[text[end - 1]]]:
            end += 1
        rows = count_slice(text[at:end], np.zeros(1, np.int64), np.zeros(1, np.int64))
        yield [(0, word, n, int(word not in seen)) for _, word, n, _ in rows]
        seen.update(word for _, word, _, _ in rows)
        at = end


_COUNTED = "lang string, source string, term binary, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows, names: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([names[r[0]][0] for r in rows], pa.string()),
                pa.array([names[r[0]][1] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.binary()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
            ],
            ["lang", "source", "term", "n", "docs"],
        )

    for batch in batches:
        pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
        texts = batch.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
        data = texts.buffers()[2] or pa.py_buffer(b"")
        at = 0
        while at < len(texts):
            if offsets[at + 1] - offsets[at] > SLICE:
                for rows in _long_text(data[int(offsets[at]) : int(offsets[at + 1])].to_pybytes()):
                    yield out(rows, [pairs[at]])
                at += 1
                continue
            # Texts in a row, up to SLICE bytes in all.
            end = int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1
            end = min(max(end, at + 1), len(texts))
            names = list(dict.fromkeys(pairs[at:end]))
            number = {name: i for i, name in enumerate(names)}
            groups = np.array([number[p] for p in pairs[at:end]], np.int64)
            edges = offsets[at:end] - offsets[at]
            yield out(count_slice(data[int(offsets[at]) : int(offsets[end])], edges, groups), names)
            at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have it)."""
    return (
        docs.mapInArrow(_count, _COUNTED)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("term", F.col("term").cast("string"))
    )


def _share(n: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), in whole numbers of any size; null without terms."""
    return F.expr(
        f"1 + (cast({n} + 2 as decimal(19,0)) * cast({SCALE} as decimal(10,0)))"
        " div nullif(cast(total as decimal(19,0)) + 2 * cast(kept as decimal(19,0)), 0)"
    )


def strays(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so that squares fit."""
    return (p - q) * (p - q) // (p + q)


def _compare(table: pa.Table) -> pa.Table:
    """Sums over the terms of one table, for two sources each: a row for both orders.

    ``table`` has a row per source with its share without occurrences, and the places and
    shares of the terms that it has. Its sources are those of one block, or of two, and then only
    sources of different blocks are compared.
    """
    whole = {c: table[c].to_numpy() for c in ("side", "i", "j", "p_none", "width")}
    shares = np.repeat(whole["p_none"][:, None], int(whole["width"][0]), axis=1)
    for i, (places, values) in enumerate(zip(table["places"], table["shares"])):
        shares[i, places.values.to_numpy()] = values.values.to_numpy()
    side, within = whole["side"], whole["i"][0] == whole["j"][0]
    one, other, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(shares) - 1):
        later = np.arange(i + 1, len(shares))
        at = later if within else later[side[later] != side[i]]
        one.append(np.full(len(at), i))
        other.append(at)
        values.append(strays(shares[i], shares[at]).sum(1))
    a, b, v = (np.concatenate(x) for x in (one, other, values))
    names = table["source"].combine_chunks()
    return pa.table({
        "lang": table["lang"].combine_chunks().take(pa.array(np.append(a, b))),
        "source": names.take(pa.array(np.append(a, b))),
        "item": names.take(pa.array(np.append(b, a))),
        "value": np.append(v, v),
    })


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of ``docs(text, lang, source)``.

    A language keeps the terms in at least ``min_documents`` of its rows. A share is
    1 + floor(SCALE * (n + 2) / (all occurrences + 2 * kept terms)), of a source or of the whole language.

    Part ``pair``: item is each other source of the language, value the sum over all kept
    terms of floor((p - q)^2 / (p + q)), 0 without kept terms. Part ``term``: item is a kept term
    that the source has and uses more than the language does; the ``top`` best values. Ranks go from the
    largest value on, equal ones by item in byte order.

    Nulls count as empty strings, in all three columns; rows count each, whatever their
    doc_id; other columns are left out. A table without rows gives none.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = materialize(term_counts(rows), "term-counts")
    sources = materialize(rows.select("lang", "source").distinct(), "sources")

    often = materialize(
        counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= min_documents).select("lang", "term", "n"),
        "frequent-terms",
    )
    langs = materialize(
        often.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total"))
        .join(sources.groupBy("lang").agg(F.count("*").alias("sources")), "lang", "right")
        .withColumn("kept", F.coalesce("kept", F.lit(0)))
        .withColumn("blocks", F.ceil(F.col("sources") / SOURCES))
        .withColumn("width", F.floor(F.lit(TABLE) / F.least(F.col("sources"), F.lit(2 * SOURCES))))
        .withColumn("tables", F.greatest(F.lit(1), F.ceil(F.col("kept") / F.col("width")))),
        "languages",
    )
    # Places in a table follow the order of its terms; a table holds about ``width`` of them.
    in_table = Window.partitionBy("lang", "table").orderBy("term")
    terms = materialize(
        often.join(langs.select("lang", "total", "kept", "tables"), "lang")
        .select("lang", "term", _share("n").alias("q"), F.pmod(F.xxhash64("term"), "tables").alias("table"))
        .withColumn("place", F.row_number().over(in_table) - 1),
        "kept-terms",
    )
    has = materialize(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "kept-counts")
    totals = has.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = materialize(
        sources.join(totals, ["lang", "source"], "left").join(langs.select("lang", "kept", "blocks"), "lang")
        .withColumn("total", F.coalesce("total", F.lit(0)))
        .withColumn("p_none", _share("0")),
        "source-sizes",
    )
    shares = has.join(sizes.select("lang", "source", "total", "kept"), ["lang", "source"]).withColumn("p", _share("n"))

    rank = lambda of: F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), of)
    )
    best = (
        shares.filter("p > q")
        .select(
            "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
            F.expr("((p - q) * (p - q)) div (p + q)").alias("value"),
        )
        .withColumn("rank", rank("item"))
        .filter(F.col("rank") <= top)
    )
    pairs = _pairs(shares, terms, sizes).withColumn("rank", rank("item"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(best)


def _pairs(shares: DataFrame, terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, item, value: the sums over all kept terms, for every two sources of a language."""
    widths = terms.groupBy("lang", "table").agg(F.count("*").alias("width"))
    own = (
        shares.groupBy("lang", "source", "table")
        .agg(F.collect_list("place").alias("places"), F.collect_list("p").alias("shares"))
    )
    # Every source takes part in every table of its language, with or without terms there.
    slots = (
        sizes.select("lang", "source", "blocks", "p_none").join(widths, "lang")
        .join(own, ["lang", "source", "table"], "left")
        .withColumn("side", F.pmod(F.xxhash64("source"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .select(
            "lang", "table", "source", "p_none", "width", "side",
            F.least("side", "other").alias("i"),
            F.greatest("side", "other").alias("j"),
            F.coalesce("places", F.array().cast("array<int>")).alias("places"),
            F.coalesce("shares", F.array().cast("array<bigint>")).alias("shares"),
        )
    )
    sums = (
        slots.groupBy("lang", "table", "i", "j")
        .applyInArrow(_compare, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    # Languages without kept terms have no table; their sources are as far apart as 0.
    bare = sizes.filter("kept = 0").select("lang", "source")
    zero = (
        bare.join(bare.select("lang", F.col("source").alias("item")), "lang")
        .filter("source <> item").withColumn("value", F.lit(0).cast("bigint"))
    )
    return sums.unionByName(zero)
