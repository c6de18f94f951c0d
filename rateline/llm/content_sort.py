"""Exact duplicates by sorting the contents.

Sampled splitters deal the rows into ranges of (leading bytes, digest, doc_id), so
that a group of equal texts lies in one range or in neighbouring ones, however large
it is. Spark sorts each range externally, and equal texts then stand side by side:
one walk over a range compares whole neighbouring texts and closes a run where they
differ. Only the first and the last run of a range can go on in another one; their
texts, two a range, are compared once more, and their sizes added up.

Splitters are sampled on the driver, so they hold a few leading bytes and a digest, never
a text. What leaves the walk is narrow: ids, digests, and the place of a run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rateline.llm.names import unused
from rateline.sources.workspace import materialize

#: Bytes of a text that lead the order; texts alike in them are told apart by digest.
LEAD = 32

_WALKED = (
    "doc_id long, text_sha256 string, part int, run long, run_size long, run_keep long,"
    " last boolean, edge_text string"
)


def _normalised(text: Column, normalise: Callable[[Column], Column] | None) -> Column:
    text = F.coalesce(text, F.lit(""))
    return normalise(text) if normalise else text


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range (doc_id, text_sha256, text) to rows with their run.

    The run that is open at the end of a batch is held back, its ids and one text of it.
    """
    part = TaskContext.get().partitionId()
    run = 0
    ids, digests = pa.array([], pa.int64()), pa.array([], pa.string())
    open_text = None

    def closed(starts: np.ndarray, end: int, first: str | None, last: str | None) -> pa.RecordBatch:
        """The rows before ``end``, runs beginning at ``starts``; texts of runs at an edge."""
        sizes = np.diff(np.append(starts, end))
        of_row = np.repeat(np.arange(len(starts)), sizes)
        is_last = np.zeros(end, bool)
        is_last[starts + sizes - 1] = True
        texts: list[str | None] = [None] * end
        if first is not None:
            texts[int(sizes[0]) - 1] = first
        if last is not None:
            texts[-1] = last
        return pa.RecordBatch.from_arrays(
            [
                ids.slice(0, end),
                digests.slice(0, end),
                pa.array(np.full(end, part, np.int32)),
                pa.array(run + of_row),
                pa.array(sizes[of_row]),
                ids.slice(0, end).take(pa.array((starts + sizes - 1)[of_row])),
                pa.array(is_last),
                pa.array(texts, pa.string()),
            ],
            ["doc_id", "text_sha256", "part", "run", "run_size", "run_keep", "last", "edge_text"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        texts, held = batch.column("text"), len(ids)
        differs = np.ones(batch.num_rows, bool)
        differs[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        differs[0] = held > 0 and texts[0].as_py() != open_text
        ids = pa.concat_arrays([ids, batch.column("doc_id")])
        digests = pa.concat_arrays([digests, batch.column("text_sha256")])
        starts = np.append(0, held + np.flatnonzero(differs)).astype(np.int64)
        first = None
        if run == 0 and len(starts) > 1:  # the range's first run ends here
            first = open_text if held else texts[0].as_py()
        if len(starts) > 1:
            yield closed(starts[:-1], int(starts[-1]), first, None)
            run += len(starts) - 1
            ids, digests = ids.slice(int(starts[-1])), digests.slice(int(starts[-1]))
        open_text = texts[batch.num_rows - 1].as_py()
    if len(ids):
        yield closed(np.zeros(1, np.int64), len(ids), None, open_text)


def duplicates(
    docs: DataFrame,
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row per row of ``docs(doc_id, text)``.

    Texts are equal when their normalised forms are (as they are, without
    ``normalise``); null counts as empty, and empty texts are equal to each other. Of a
    group the row with the smallest (or ``keep="largest"``) doc_id stays, one of
    them if rows repeat it; a null id stays only where all are null, and keep_id is null
    then. Other columns, whatever their names, are left out. A table without rows gives none.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    # Of a run the last row stays.
    order = F.asc_nulls_first("doc_id") if keep == "largest" else F.desc_nulls_first("doc_id")
    text = _normalised(F.col("text"), normalise)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    keyed = rows.select(
        "doc_id",
        "text",
        F.substring(F.col("text").cast("binary"), 1, LEAD).alias("lead"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
    ranged = keyed.repartitionByRange("lead", "text_sha256", order)
    ordered = ranged.sortWithinPartitions("lead", "text_sha256", "text", order)
    walked = materialize(
        ordered.select("doc_id", "text_sha256", "text").mapInArrow(_walk, _WALKED), "content-sorted"
    )
    # Two rows a range at most: as many as there are ranges bounds what is broadcast.
    whole = Window.partitionBy("text_sha256", "edge_text")
    spans = (
        walked.filter("edge_text is not null")
        .withColumn("keep_part", F.max("part").over(whole))
        .withColumn("keep_id", F.max_by("run_keep", "part").over(whole))
        .withColumn("group_size", F.sum("run_size").over(whole))
        .filter(F.col("group_size") > F.col("run_size"))
        .select("part", "run", "keep_part", "keep_id", "group_size")
    )
    spread = F.col("group_size").isNotNull()
    return walked.join(F.broadcast(spans), ["part", "run"], "left").select(
        "doc_id",
        F.when(spread, F.col("keep_id")).otherwise(F.col("run_keep")).alias("keep_id"),
        F.coalesce("group_size", "run_size").alias("group_size"),
        (F.col("last") & (F.coalesce("keep_part", "part") == F.col("part"))).alias("kept"),
        "text_sha256",
    )


def keep_one(
    docs: DataFrame, normalise: Callable[[Column], Column] | None = None, keep: str = "smallest"
) -> DataFrame:
    """The columns of ``docs``, one row of each group of equal texts, as ``duplicates`` has it."""
    id_, none, digest = names = unused(docs.columns, "_id", "_none", "_digest")

    def keys(text: Column | None) -> list[Column]:
        own = F.col("text_sha256") if text is None else F.sha2(text.cast("binary"), 256)
        return [
            F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias(id_),
            F.col("doc_id").isNull().alias(none),
            own.alias(digest),
        ]

    wanted = duplicates(docs, normalise, keep).filter("kept").select(*keys(None))
    keyed = docs.select("*", *keys(_normalised(F.col("text"), normalise)))
    return (
        keyed.join(wanted, names, "left_semi")
        .dropDuplicates(names)
        .select(*[f"`{c}`" for c in docs.columns])
    )
