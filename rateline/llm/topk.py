"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are dealt into ``PARTS`` lists; a list's local score is the
inner product over its own components. A task holds one list of a block of rows and of a block
of queries, and so knows no totals.

1. Each list sends, per query, some of its best rows, ``HEADS`` or so. The pairs named by them are
   resolved, and the k-th best of their totals is a safe cutoff, whichever rows they are. More heads
   give a higher cutoff, so that less is sent later.
2. The cutoff goes back to the lists, which send every entry whose local score is at least
   cutoff / PARTS. A row that no list sends has a total below the cutoff.
3. What was sent is added up, and the local scores that a pair still lacks are worked out
   from the parts of its two vectors. Only those pairs are ever resolved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rateline.sources.workspace import materialize

PARTS = 2
HEADS = 64
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
_SLICE = 256
_NO_CUTOFF = -(1 << 63)


def quantise(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, dim and components floor(256 * x); one row an id, the smallest of its vectors.

    Null ids and vectors that are null or hold a null or non-finite component
    are left out.
    """
    return (
        vectors.select("vec_id", F.col(vector).cast("array<double>").alias("_x"))
        .filter("vec_id is not null and _x is not null")
        .filter(
            F.forall(
                "_x",
                lambda x: x.isNotNull()
                & ~F.isnan(x)
                & (F.abs(x) < float("inf")),
            )
        )
        .select("vec_id", F.transform("_x", lambda x: F.floor(x * 256)).alias("x"))
        .groupBy("vec_id")
        .agg(F.min("x").alias("x"))
        .withColumn("dim", F.size("x"))
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles multiply fast and are exact while every partial sum is under 2^53; else whole numbers."""
    biggest = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (a, b)]
    bound = biggest[0] * biggest[1] * a.shape[1]
    if bound >= 1 << 62:
        raise OverflowError("an inner product may not fit into 64 bits")
    return (a.astype(np.float64), b.astype(np.float64)) if bound < 1 << 52 else (a, b)


def _scores(queries: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """For a few queries at a time: they, whose row each is not, local scores."""
    q, c = _common(_matrix(queries["x"]), _matrix(rows["x"]))
    ids = rows["vec_id"].to_numpy()
    for at in range(0, len(queries), _SLICE):
        some = queries.iloc[at : at + _SLICE]
        yield some, some["vec_id"].to_numpy()[:, None] != ids[None, :], (q[at : at + _SLICE] @ c.T).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= edge)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


_ENTRY = "query_id long, vec_id long, part int, score long"


def _heads(k: int):
    """The best rows of a list, per query."""

    def phase(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            ids = rows["vec_id"].to_numpy()
            for some, other, local in _scores(queries, rows):
                for i, query in enumerate(some["vec_id"].to_numpy()):
                    mine = np.flatnonzero(other[i])
                    best = mine[_best(local[i, mine], ids[mine], k)]
                    found.append((np.full(len(best), query), ids[best], local[i, best]))
        return _frame(found, key)

    return phase


def _above(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Every entry of a list that is not below the query's cutoff / PARTS."""
    found = []
    if len(queries) and len(rows):
        ids = rows["vec_id"].to_numpy()
        for some, other, local in _scores(queries, rows):
            # The least whole number that is not below cutoff / PARTS.
            least = -((-some["cutoff"].to_numpy()) // PARTS)
            least = np.where(some["cutoff"].to_numpy() == _NO_CUTOFF, _NO_CUTOFF, least)
            of, at = np.nonzero(other & (local >= least[:, None]))
            found.append((some["vec_id"].to_numpy()[of], ids[at], local[of, at]))
    return _frame(found, key)


def _frame(found: list, key) -> pd.DataFrame:
    """Entries of the list that the second field of ``key`` names."""
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
    query_id, vec_id, score = columns
    part = np.full(len(score), key[1], np.int32)
    return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "part": part, "score": score})


def _part(x: Column, part: Column) -> Column:
    """The components of ``x`` that belong to a list."""
    edge = lambda p: F.floor(F.size(x) * p / F.lit(PARTS)).cast("int")
    return F.slice(x, edge(part) + 1, edge(part + 1) - edge(part))


def _totals(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """Exact totals of the pairs in ``entries``: what lists sent, and the local scores still lacking."""
    sent = entries.groupBy("query_id", "vec_id").agg(
        F.sum("score").alias("score"), F.collect_set("part").alias("_sent")
    )
    sent = materialize(sent, "sent")
    lists = F.array(*[F.lit(p) for p in range(PARTS)])
    lacking = sent.select("query_id", "vec_id", F.explode(F.array_except(lists, "_sent")).alias("part"))
    mine = rows.select(F.col("vec_id").alias("query_id"), F.col("x").alias("_q"))
    theirs = rows.select("vec_id", F.col("x").alias("_x"))
    products = F.zip_with(_part(F.col("_q"), F.col("part")), _part(F.col("_x"), F.col("part")), lambda a, b: a * b)
    fetched = (
        lacking.join(mine, "query_id")
        .join(theirs, "vec_id")
        .select("query_id", "vec_id", F.aggregate(products, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("score"))
    )
    return (
        sent.select("query_id", "vec_id", "score")
        .unionByName(fetched)
        .groupBy("query_id", "vec_id")
        .agg(F.sum("score").alias("score"))
    )


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vector: str = "embedding") -> DataFrame:
    """The ``k`` best other rows for each id divisible by ``every``: query_id, rank, vec_id, score.

    Vectors meet only vectors of their own length. Ids count once (see
    ``quantise``). Ties go to the smaller id; a query with fewer than ``k``
    other rows gets them all, one with none has no row. A score that may not fit into 64 bits
    raises an error.
    """
    rows = materialize(quantise(vectors, vector), "vectors")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    row_blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    query_blocks = max(1, -(-asked.count() // QUERY_ROWS))
    deal = lambda blocks, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(blocks))
    every_block = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    key = ["dim", "part", "query_block", "row_block"]

    def lists(of: DataFrame) -> DataFrame:
        each = of.withColumn("part", F.explode(F.array(*[F.lit(p) for p in range(PARTS)])))
        return each.withColumn("x", _part(F.col("x"), F.col("part")))

    dealt = lists(rows.withColumn("row_block", deal(row_blocks, 1)).withColumn("query_block", every_block(query_blocks)))

    def meet(queries: DataFrame, phase) -> DataFrame:
        sent = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # new columns, not those of dealt
        sent = lists(
            sent.withColumn("query_block", deal(query_blocks, 2)).withColumn("row_block", every_block(row_blocks))
        )
        return sent.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(phase, _ENTRY)

    def ranked(scored: DataFrame, most: int, *of: str) -> DataFrame:
        return scored.withColumn(
            "rank", F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("score"), "vec_id"))
        ).filter(F.col("rank") <= most)

    depth = max(k, -(-HEADS // row_blocks))
    heads = ranked(meet(asked, _heads(depth)), max(k, HEADS), "query_id", "part").drop("rank")
    cutoffs = (
        ranked(_totals(heads, rows), k, "query_id")
        .filter(F.col("rank") == k)
        .select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff"))
    )
    asked = asked.join(cutoffs, "vec_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(_NO_CUTOFF)))
    return ranked(_totals(meet(asked, _above), rows), k, "query_id").select("query_id", "rank", "vec_id", "score")
