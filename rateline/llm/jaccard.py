"""Near duplicates: exact Jaccard links over word shingles, by a parity-sketch join.

A text is the set of its different five-word shingles, held as 64-bit hashes.
Equal sets form a class, and classes are joined.

Candidates. Sets with a similarity of 0.8 or more differ in at most (a + b) / 9
shingles, a and b their sizes. A level of sizes deals shingles into more parts than
that and XORs the hashes in each: a part without a difference has the same
parity on both sides, and there must be one. Parts of fewer than ``LIGHT`` shingles
say little and are left out, unless a set has too few others for the
argument; two such sets meet in their light parts. Levels double in size, and
pairs across an edge meet in a band of their own.

Checks. Candidates are compared by bit sketches, whose Hamming distance is at most the
size of the symmetric difference, and what is left by the sets themselves.

A part shared by many classes is first resolved as a star around its best
connected member. Only classes that are still in different components meet in
pairs, in blocks of bounded size, and by their sketches: first each with its nearest
in another component, then all that are left. So large groups of copies cost
their size, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rateline.llm.names import unused
from rateline.llm.urls import WORDS as BLOCK_WORDS
from rateline.llm.urls import _probe, blocked_bloom
from rateline.sources.workspace import materialize, scope

SHINGLE = 5
#: Similarity of 0.8: in percent, and as the bound (a + b) / 9 on differences.
PERCENT = 80
#: Sizes below are joined by single shingles, larger ones by levels that double.
SMALL = 16
LIGHT = 2
#: More parts than differences, so that parts lost as light do not matter.
SLACK, SPARE = 1.2, 4
BLOCK = 512
#: Rows in Python at once, and words or classes remembered by a task.
_ROWS = 256
_CACHE = 100_000
_LONG = np.uint64


class _Hashes(dict):
    """Word to hash, filled as words come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _LONG(30))) * _LONG(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _LONG(27))) * _LONG(0x94D049BB133111EB)
    return x ^ (x >> _LONG(31))


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted different shingle hashes of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, _LONG)
    if len(hashes) > _CACHE:
        hashes.clear()
    one = np.array(list(map(hashes.__getitem__, words)), _LONG)
    width = min(SHINGLE, len(words))
    total = np.full(len(words) - width + 1, width, _LONG)
    for k in range(width):
        total = total * _LONG(0x9E3779B97F4A7C15) + one[k : len(one) - width + 1 + k]
    return np.unique(_mix(total))


def class_of(tokens: np.ndarray) -> int:
    """A 64-bit fingerprint of a set."""
    whole = np.array([np.bitwise_xor.reduce(tokens), tokens.sum(dtype=_LONG), len(tokens)], _LONG)
    return xxhash.xxh3_64_intdigest(whole.tobytes()) - (1 << 63)


def level_of(size: int) -> int:
    """0 below SMALL, then one more for each doubling."""
    return max(0, int(size).bit_length() - SMALL.bit_length() + 1)


def bands_of(size: int) -> list[tuple[int, int, int]]:
    """(band, parts, most differences) for each band that a set of this size is joined in."""
    level, found = level_of(size), []
    if level == 0:
        found.append((0, 0, 0))
    else:
        top = SMALL << level
        largest = min(top - 1, size * 100 // PERCENT)
        found.append((2 * level, int(SLACK * 2 * top / 9) + SPARE, (size + largest) // 9))
    for edge in {SMALL << max(level - 1, 0), SMALL << level}:
        if size < edge and size * 100 >= PERCENT * edge:
            differ = (size + size * 100 // PERCENT) // 9
        elif size >= edge and PERCENT * size <= 100 * (edge - 1):
            differ = (size + edge - 1) // 9
        else:
            continue
        found.append((2 * level_of(edge) - 1, int(SLACK * edge / 4) + SPARE, differ))
    return found


def signatures(tokens: np.ndarray) -> np.ndarray:
    """Keys of which two linked sets share at least one."""
    keys = []
    for band, parts, differ in bands_of(len(tokens)):
        if not parts:  # every shingle is a part of its own
            keys.append(_mix(tokens ^ _LONG(band + 1)))
            continue
        part = ((tokens >> _LONG(32)) * _LONG(parts)) >> _LONG(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        counts = np.diff(np.append(starts, len(part)))
        place = part[starts] + _LONG(band << 40)
        keys_of = _mix(np.bitwise_xor.reduceat(tokens, starts) ^ _mix(place + _LONG(1)))
        heavy = counts >= LIGHT
        keys.append(keys_of[heavy])
        if heavy.sum() <= differ:
            keys.append(_mix(keys_of[~heavy] + _LONG(1)))
            if len(starts) <= differ:  # nor are there enough parts with shingles
                empty = np.setdiff1d(np.arange(parts, dtype=_LONG), part[starts])
                keys.append(_mix(_mix(empty + _LONG(band << 40) + _LONG(1)) + _LONG(2)))
    return np.concatenate(keys)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the shingles by their low bits, in 64-bit words; twice the bits a level."""
    bits = 4 * SMALL << level_of(len(tokens))
    odd = np.bincount((tokens % _LONG(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _texts(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, ...]]:
    """A few rows at a time, so that a batch of long texts is never in Python objects whole."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            some = batch.slice(at, _ROWS)
            yield tuple(some.column(c).to_pylist() for c in columns)


_MARKS = "doc_id long, text_key long, n_shingles long, cls long, sigs array<long>"


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int64), *[a.view(np.int64) for a in arrays]])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and signatures of each text; of copies in one task the first has the signatures."""
    hashes, seen = _Hashes(), set()
    for ids, keys, texts in _texts(batches, "doc_id", "text_key", "text"):
        sizes, names, sigs = [], [], []
        for text in texts:
            tokens = shingles(text, hashes)
            name = class_of(tokens) if len(tokens) else None
            new = name is not None and name not in seen
            if new:
                if len(seen) > _CACHE:
                    seen.clear()
                seen.add(name)
            sizes.append(len(tokens))
            names.append(name)
            sigs.append(signatures(tokens) if new else np.zeros(0, _LONG))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()),
             pa.array(names, pa.int64()), _lists(sigs)],
            ["doc_id", "text_key", "n_shingles", "cls", "sigs"],
        )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for (texts,) in _texts(batches, "text"):
        sets = [s for s in (shingles(t, hashes) for t in texts) if len(s)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
             _lists([sketch(s) for s in sets]), _lists(sets)],
            ["cls", "n", "sketch", "tokens"],
        )


def _close(n_a: Column, n_b: Column) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT


_HAMMING = """
  aggregate(
    zip_with(
      if(size(x) > size(y), zip_with(slice(x, 1, size(y)), slice(x, size(y) + 1, size(y)), (p, q) -> p ^ q), x),
      if(size(y) > size(x), zip_with(slice(y, 1, size(x)), slice(y, size(x) + 1, size(x)), (p, q) -> p ^ q), y),
      (p, q) -> bit_count(p ^ q)),
    0, (s, v) -> s + v)"""


def verify(edges: DataFrame, features: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""
    small = features.select("cls", "n", "sketch")
    near = materialize(
        edges.join(small.toDF("a", "n_a", "x"), "a")
        .join(small.toDF("b", "n_b", "y"), "b")
        .filter(_close(F.col("n_a"), F.col("n_b")))
        .filter(F.expr(_HAMMING) * 9 <= F.col("n_a") + F.col("n_b"))
        .select("a", "b", "n_a", "n_b")
        .distinct(),
        "near-pairs",
    )
    sets = features.select("cls", "tokens")
    common = F.size(F.array_intersect("s", "t"))
    return (
        near.join(sets.toDF("a", "s"), "a")
        .join(sets.toDF("b", "t"), "b")
        .withColumn("common", common)
        .filter(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * PERCENT)
        .select("a", "b")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """cls and comp, the smallest class that links lead to, for every class in ``edges(a, b)``.

    Each round a class takes the smallest label around it, and then that
    label's label; the tables of a round are written, so a lost executor costs a round at most.
    """
    both = materialize(
        edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links"
    )
    labels = materialize(
        both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("comp")),
        "labels",
    )
    while True:
        around = (
            both.join(labels.toDF("b", "near"), "b").groupBy(F.col("a").alias("cls"))
            .agg(F.min("near").alias("near"))
        )
        lower = labels.join(around, "cls").select(
            "cls", F.least("comp", "near").alias("next"), F.col("comp").alias("before")
        )
        jump = labels.toDF("next", "far")
        moved = materialize(
            lower.join(jump, "next").select(
                "cls", F.least("next", "far").alias("comp"), (F.least("next", "far") < F.col("before")).alias("moved")
            ),
            "labels",
        )
        labels = moved.select("cls", "comp")
        if not moved.filter("moved").limit(1).count():
            return labels


def _nearest_in_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of ``_pairs_in_block``, for each class its nearest one in each other component."""
    return _pairs_in_block(batches, nearest=True)


def _pairs_in_block(
    batches: Iterator[pd.DataFrame], nearest: bool = False
) -> Iterator[pd.DataFrame]:
    """Pairs of different components that the sketches allow; a row is a block."""
    for batch in batches:
        found_a, found_b = [], []
        for row in batch.itertuples(index=False):
            cls, comp, n = (np.asarray(v) for v in (row.cls, row.comp, row.n))
            side = np.asarray(row.side)
            width = min(len(s) for s in row.sketch)
            bits = np.stack(
                [np.bitwise_xor.reduce(np.asarray(s).reshape(-1, width), axis=0) for s in row.sketch]
            ).view(_LONG)
            names, sizes = np.unique(comp, return_counts=True)
            # Two classes of the largest component are no pair, so all others have their turn.
            for k in np.flatnonzero(comp != names[sizes.argmax()]):
                near = comp != comp[k]
                if row.i != row.j:
                    near &= side != side[k]
                near &= np.minimum(n, n[k]) * 100 >= np.maximum(n, n[k]) * PERCENT
                at = np.flatnonzero(near)
                if len(at):
                    apart = np.bitwise_count(bits[at] ^ bits[k]).sum(1, dtype=np.int64)
                    allowed = apart * 9 <= n[at] + n[k]
                    at = at[allowed]
                    if nearest and len(at):
                        at = at[np.lexsort((apart[allowed], comp[at]))]
                        at = at[np.concatenate([[True], comp[at][1:] != comp[at][:-1]])]
                    found_a.append(np.minimum(cls[at], cls[k]))
                    found_b.append(np.maximum(cls[at], cls[k]))
        none = [np.zeros(0, np.int64)]
        pairs = np.unique(
            np.stack([np.concatenate(none + found_a), np.concatenate(none + found_b)], axis=1), axis=0
        )
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _open_pairs(members: DataFrame, labels: DataFrame, features: DataFrame, read) -> DataFrame:
    """Candidates between components that share a part: a, b, as ``read`` finds them."""
    named = members.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    split = (
        named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"))
        .filter("lo <> hi").select("sig", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    )
    rows = (
        named.join(split, "sig")
        .join(features.select("cls", "n", "sketch"), "cls")
        .withColumn("side", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("side", "other"))
        .withColumn("j", F.greatest("side", "other"))
    )
    lists = [F.collect_list(c).alias(c) for c in ("cls", "comp", "n", "side", "sketch")]
    # A block holds about twice BLOCK classes, whatever the part's size.
    blocks = rows.groupBy("sig", "i", "j").agg(*lists).drop("sig")
    return blocks.mapInPandas(read, "a long, b long").distinct()


def shared_parts(marks: DataFrame) -> DataFrame:
    """sig, cls, c: the classes of each part that c > 1 share; a table left to the scope around."""
    rows = marks.select(F.explode("sigs").alias("sig"), "cls")
    part = Window.partitionBy("sig")
    shared = (
        rows.withColumn("lo", F.min("cls").over(part)).withColumn("hi", F.max("cls").over(part))
        .filter("lo <> hi").distinct()
    )
    # Parts with the same members say the same; one of them is kept. Members are the same if
    # their least, greatest, number and two digests (of 44 and 64 bits) are.
    alike = ["lo", "hi", "c", "whole", "digest"]
    listed = materialize(
        shared.withColumn("c", F.count("*").over(part))
        .withColumn("whole", F.sum(F.shiftright(F.xxhash64("cls"), 20)).over(part))
        .withColumn("digest", F.bit_xor(F.xxhash64("cls", F.lit("digest"))).over(part)),
        "shared-parts",
    )
    once = listed.groupBy(*alike).agg(F.min("sig").alias("sig")).select("sig")
    return materialize(
        listed.join(once, "sig", "left_semi").select("sig", "cls", "c"), "members", keep=True
    )


def link_classes(docs: DataFrame, marks: DataFrame, members: DataFrame) -> DataFrame:
    """cls and comp of every class that is linked with another one."""
    # Sets of the classes concerned, from one text each: a filter of bounded size keeps most
    # other texts from being read again, and what it lets through does no harm.
    wanted = materialize(
        marks.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
        .join(members.select("cls").distinct(), "cls", "left_semi").select("doc_id"),
        "wanted",
    )
    bloom, blocks = blocked_bloom(wanted.filter("doc_id is not null"), "doc_id", wanted.count())
    inside = F.lit(True)
    for w in range(BLOCK_WORDS):
        inside &= F.col(f"_w{w}").bitwiseAND(F.col(f"_m{w}")) == F.col(f"_m{w}")
    texts = (
        docs.select("doc_id", "text", *_probe("doc_id", blocks))
        .join(F.broadcast(bloom), "_block", "left")
        .filter(F.coalesce(inside, F.lit(False)) | F.col("doc_id").isNull())
        .select("text")
    )
    features = materialize(
        texts.mapInArrow(_features, "cls long, n long, sketch array<long>, tokens array<long>"),
        "sets",
    )

    weight = members.groupBy("cls").agg(F.sum("c").alias("weight"))
    hubs = members.join(weight, "cls").groupBy("sig").agg(
        F.max_by("cls", F.struct("weight", "cls")).alias("a")
    )
    star = (
        members.join(hubs, "sig").filter("cls <> a").select("a", F.col("cls").alias("b")).distinct()
    )
    links = materialize(verify(star, features), "star-links")
    labels = components(links)
    # Nearest pairs first: they join most of what is linked, so that few pairs are left.
    for read in (_nearest_in_block, _pairs_in_block):
        more = verify(_open_pairs(members, labels, features, read), features)
        links = links.union(materialize(more, "more-links"))
        labels = components(links)
    return labels


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles and comp, the component as a class, a row per row: a table.

    comp is null for texts without words; text_key is xxhash64 of the text.
    """
    docs, spark = docs.select("doc_id", "text"), docs.sparkSession
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    with scope(spark):
        # Signatures are nearly as large as the texts: they go once the shared ones are known.
        with scope(spark):
            signed = materialize(keyed.mapInArrow(_mark, _MARKS), "signatures")
            members = shared_parts(signed.filter("cls is not null"))
            marks = materialize(signed.drop("sigs"), "marks", keep=True)
        labels = link_classes(docs, marks.filter("cls is not null"), members)
        named = marks.join(labels, "cls", "left").select(
            "doc_id", "text_key", "n_shingles", F.coalesce("comp", "cls").alias("comp")
        )
        return materialize(named, "classes", keep=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs(doc_id, text)``.

    Two documents link when 100 * common >= 80 * union of their shingles;
    component_id is the smallest doc_id that links lead to, the row's own included.
    Documents without words link with nothing, nor do null ids give a component its
    name: a component of null ids alone has a null one. Rows are judged each,
    whatever their doc_id; other columns are left out. Classes are told apart by
    64-bit fingerprints.
    """
    named = classes(docs)
    found = named.filter("comp is not null")
    least = found.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = found.join(least, "comp").select("doc_id", "n_shingles", "component_id")
    alone = named.filter("comp is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return linked.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, and of each component the row with the smallest doc_id.

    A null id comes after all others, and of rows with one id the smaller
    text_key is kept; rows equal in doc_id and text stay once. Texts without
    words stay.
    """
    named = classes(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("f")
    kept = (
        named.filter("comp is not null").groupBy("comp").agg(first).select("f.doc_id", "f.text_key")
        .unionByName(named.filter("comp is null").select("doc_id", "text_key"))
    )
    # Plain columns as keys: the join and the removal of equal rows share one shuffle.
    id_, none, key = names = unused(docs.columns, "_id", "_none", "_key")
    wanted = kept.select(
        F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("doc_id").isNull().alias(none), F.col("text_key").alias(key)
    )
    keyed = docs.select(
        "*",
        F.coalesce("doc_id", F.lit(0)).alias(id_),
        F.col("doc_id").isNull().alias(none),
        F.xxhash64("text").alias(key),
    )
    return (
        keyed.join(wanted, names, "left_semi")
        .dropDuplicates(names)
        .select(*[f"`{c}`" for c in docs.columns])
    )
