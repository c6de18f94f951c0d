"""Product codes for vectors, with nearest entries looked up by memoised grid cells.

A vector is cut into parts, and each part is coded by the nearest entry of its own
codebook. Space around a codebook is laid out in a grid of boxes. For a box the
least and the greatest distance to every entry are known, so an entry whose least
distance is beyond another one's greatest is nearest to no point in it. A task
remembers, for each box that it meets, the entries that are left, and measures
the distance of a part exactly to those only. All of it is whole numbers, so results
are exact, ties go to the lower index, and no order of rows matters.

A round adds up the parts of each entry: a task sends one row an entry and position,
and the driver holds the codebooks, ``ENTRIES`` numbers a component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateline.sources.workspace import materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Boxes over the range of a part's entries, and boxes that a task remembers for a part.
GRID_CELLS = 1296
_REMEMBERED = 1 << 16
#: Rows in Python at once.
_ROWS = 2048
#: Components and entries are below this, so that a squared distance of 2^12 components fits a long.
LARGEST = 1 << 24


def quantise(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vector`` as whole numbers floor(256 * x), beside ``vec_id`` and ``label``.

    Vectors that are null or hold a null or non-finite component are left out.
    """
    finite = F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select("vec_id", "label", F.col(vector).cast("array<double>").alias("_x"))
        .filter(F.col("_x").isNotNull() & finite)
        .select("vec_id", "label", F.transform("_x", lambda x: F.floor(x * 256)).alias("x"))
    )


@dataclass(frozen=True)
class Codebooks:
    """``entries[part]`` is a table of entries by components."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of all components, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Cells:
    """The nearest entries of one part's codebook, by box.

    ``measured`` counts the distances that were worked out.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        steps = max(1, int(GRID_CELLS ** (1 / max(1, entries.shape[1]))))
        self.low = entries.min(0)
        self.step = np.maximum(1, -(-(entries.max(0) - self.low + 1) // steps))
        self.known: dict[bytes, np.ndarray] = {}
        self.measured = 0

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each box the entries that can be nearest to a point of it, in order."""
        low = (self.low + cells * self.step)[:, None, :]
        below, above = low - self.entries, self.entries - (low + self.step - 1)
        least = np.maximum(0, np.maximum(below, above))
        # The far corner of a box is as far away as its near and its far face, whichever is more.
        most = np.maximum(np.abs(below), np.abs(above))
        bound = (most * most).sum(2).min(1)
        left = (least * least).sum(2) <= bound[:, None]
        return [np.flatnonzero(row) for row in left]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, ties to the lower one, and the squared distance."""
        boxes, of_point = np.unique((points - self.low) // self.step, axis=0, return_inverse=True)
        of_point = of_point.reshape(-1)
        keys = [box.tobytes() for box in boxes]
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        new = [i for i, key in enumerate(keys) if key not in self.known]
        if new:
            self.known.update(zip([keys[i] for i in new], self.candidates(boxes[new])))
        some = [self.known[key] for key in keys]
        sizes = np.array([len(x) for x in some])
        # Boxes with about as many entries are looked at together; a short list repeats its last entry.
        found, error = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        classes = np.ceil(np.log2(sizes)).astype(int)
        for k in np.unique(classes):
            own = np.flatnonzero(classes == k)
            width = int(sizes[own].max())
            lists = np.stack([np.append(some[i], np.repeat(some[i][-1], width - sizes[i])) for i in own])
            place = np.zeros(len(boxes), np.int64)
            place[own] = np.arange(len(own))
            at = np.flatnonzero(classes[of_point] == k)
            mine = lists[place[of_point[at]]]
            apart = points[at][:, None, :] - self.entries[mine]
            distances = (apart * apart).sum(2)
            best = distances.argmin(1)
            rows = np.arange(len(at))
            found[at], error[at] = mine[rows, best], distances[rows, best]
            self.measured += int(sizes[of_point[at]].sum())
        return found, error


def _points(batches: Iterator[pa.RecordBatch], parts: int, width: int):
    """Slices of a batch with its vectors as rows by parts by components."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            some = batch.slice(at, _ROWS)
            flat = some.column("x").flatten().to_numpy(zero_copy_only=False)
            if flat.size and max(-int(flat.min()), int(flat.max())) >= LARGEST:
                raise OverflowError(f"components beyond {LARGEST // 256} cannot be coded exactly")
            yield some, flat.reshape(some.num_rows, parts, width)


def assign(
    batches: Iterator[pa.RecordBatch], books: Codebooks
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows at a time: they, their points, the entry of each part, its error."""
    grids = [Cells(e) for e in books.entries]
    for some, points in _points(batches, len(grids), books.width):
        near = [grid.nearest(points[:, p, :]) for p, grid in enumerate(grids)]
        yield some, points, np.stack([n for n, _ in near], 1), np.stack([e for _, e in near], 1)


def _sums(books: Codebooks):
    """Of one task's rows: how many parts each entry has, and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.entries.shape
        sums = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for _, points, codes, _ in assign(batches, books):
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=entries)
                for c in range(width):
                    # Doubles are exact: a slice's sums are below _ROWS * LARGEST.
                    sums[p, :, c] += np.bincount(
                        codes[:, p], weights=points[:, p, c], minlength=entries
                    ).astype(np.int64)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(part, width).astype(np.int32)),
                pa.array(np.repeat(entry, width).astype(np.int32)),
                pa.array(np.tile(np.arange(width, dtype=np.int32), len(part))),
                pa.array(np.repeat(counts[part, entry], width)),
                pa.array(sums[part, entry].ravel()),
            ],
            ["part", "entry", "place", "n", "total"],
        )

    return run


def _codes(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _, codes, errors in assign(batches, books):
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("vec_id"),
                    some.column("label"),
                    pa.array([bytes(row).hex() for row in codes.astype(np.uint8)], pa.string()),
                    pa.array(errors.sum(1)),
                ],
                ["vec_id", "label", "code", "error"],
            )

    return run


def _prepared(vectors: DataFrame, parts: int, vector: str) -> tuple[DataFrame, list[list[int]]]:
    """Vectors of one length, padded with zeros to whole parts, and the first of them."""
    rows = materialize(quantise(vectors, vector), "vectors")
    first = rows.select("x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(1).collect()
    dim = len(first[0].x) if first else 0
    short = -dim % parts
    rows = rows.filter(F.size("x") == dim)
    if short:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), short)))
    seeds = rows.select("x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()
    return rows, [r.x for r in seeds]


def train(rows: DataFrame, seeds: list[list[int]], parts: int, rounds: int) -> Codebooks:
    """Codebooks that begin as the parts of ``seeds``; each round moves used entries to their mean."""
    start = np.array(seeds, np.int64).reshape(len(seeds), parts, -1)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    if books.entries.size and np.abs(books.entries).max() >= LARGEST:
        raise OverflowError(f"components beyond {LARGEST // 256} cannot be coded exactly")
    for _ in range(rounds if books.width else 0):
        totals = (
            rows.select("x")
            .mapInArrow(_sums(books), "part int, entry int, place int, n long, total long")
            .groupBy("part", "entry", "place")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
            .collect()  # at most ENTRIES rows a component
        )
        entries = books.entries.copy()
        for r in totals:
            entries[r.part, r.entry, r.place] = r.total // r.n
        books = Codebooks(entries)
    return books


def encode(
    vectors: DataFrame, parts: int = PARTS, rounds: int = ROUNDS, vector: str = "embedding"
) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code and error of every vector, and the codebooks.

    Codebooks begin with the vectors of the ``ENTRIES`` smallest vec_ids (of equal ids
    the smaller vector first, null ids last), so fewer rows make fewer entries. Rows
    count each, whatever their vec_id. Vectors are coded if they are as long as the one
    with the smallest vec_id, and end in zeros up to whole parts; others are left out, and so
    are null vectors and those with null or non-finite components. Empty vectors get the
    first entry of every part without error. Components of 65,536 or more raise OverflowError.
    A table without such vectors gives no rows and no codebooks. Other columns are left out.
    """
    rows, seeds = _prepared(vectors, parts, vector)
    if not seeds:
        none = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return none, None
    books = train(rows, seeds, parts, rounds)
    if not books.width:
        blank = F.lit("00" * parts).alias("code")
        return rows.select("vec_id", "label", blank, F.lit(0).cast("bigint").alias("error")), books
    kind = rows.schema["label"].dataType.simpleString()
    coded = rows.mapInArrow(_codes(books), f"vec_id long, label {kind}, code string, error long")
    return coded, books


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the error summed over equal labels; nulls are one label."""
    coded = materialize(coded, "codes")
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("of_label"))
    return coded.join(sums, same, "left").drop("of_label")
