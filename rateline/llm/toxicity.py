"""Toxicity by a factorization machine over hashed terms.

A text is the set of its letter runs, lower-cased and hashed into buckets. The
score is sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over the buckets present,
so a pair of terms can weigh more, or less, than the two terms alone.

The model is fitted on a bounded sample of labelled rows (``MAX_LABELLED``, the
first by a hash of doc_id); scoring reads every whole text, in one pass.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateline.llm.names import unused

BUCKETS = 1 << 20
MAX_LABELLED = 20_000
#: Buckets kept in the model: those whose log-odds between the labels are surest.
TERMS = 2_048
FACTORS = 8
#: Steps of the fit, whatever the number of rows.
STEPS = 2_000
BATCH = 256
#: Labelled toxic rows are rarer; each counts for up to so many others.
MOST_WEIGHT = 3.0
RATE = 0.02
DECAY = 1e-4
_CACHE = 100_000
_TEXTS = 512
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def bucket_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def terms_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass(frozen=True)
class FactorizationMachine:
    """``slots`` maps a bucket to its row of ``weights`` and ``factors``; row 0 is the bias."""

    slots: dict[int, int]
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, columns: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of rows whose slots, the bias first, stand in ``columns`` from ``starts`` on."""
        v = self.factors[columns]
        pairs = np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v * v, starts)
        return np.add.reduceat(self.weights[columns], starts) + pairs.sum(1) / 2


def _layout(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate slot lists, each with the bias before it."""
    sizes = np.array([len(r) + 1 for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    columns = np.zeros(int(sizes.sum()), np.int64)
    for at, row in zip(starts, rows):
        columns[at + 1 : at + 1 + len(row)] = row
    return columns, starts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(buckets: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> FactorizationMachine:
    """Adam on the log loss; deterministic for the same rows in the same order."""
    labels = labels.astype(float)
    n = np.array([max(1.0, (labels == 0).sum()), max(1.0, (labels == 1).sum())])
    # Counts a bucket, and rows as short lists of slots: the driver never holds all terms of all rows at once.
    seen, ones = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for own, label in zip(buckets, labels):
        seen[own] += 1
        ones[own] += int(label)
    used = np.flatnonzero(seen)
    a, b = ones[used] + 0.5, seen[used] - ones[used] + 0.5
    surety = np.abs(np.log(a / n[1]) - np.log(b / n[0])) / np.sqrt(1 / a + 1 / b)
    chosen = np.sort(used[np.lexsort((used, -surety))[:TERMS]])
    slots = {int(k): i + 1 for i, k in enumerate(chosen)}
    slot_of = np.zeros(BUCKETS, np.int32)
    slot_of[chosen] = np.arange(1, len(chosen) + 1)
    rows = [found[found > 0] for found in (slot_of[own] for own in buckets)]

    random, width = np.random.default_rng(seed), len(chosen) + 1
    theta = np.zeros((width, 1 + FACTORS))
    theta[1:, 1:] = random.normal(0, 0.02, (width - 1, FACTORS))
    theta[0, 0] = np.log(n[1] / n[0])
    weight = np.where(labels == 1, np.clip(n[0] / n[1], 1, MOST_WEIGHT), 1.0)
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    while rows and step < STEPS:
        order = random.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            some = order[at : at + BATCH]
            columns, starts = _layout([rows[i] for i in some])
            model = FactorizationMachine({}, theta[:, 0], theta[:, 1:])
            error = sigmoid(model.margin(columns, starts)) - labels[some]
            error *= weight[some] / len(some)
            sizes = np.diff(np.append(starts, len(columns)))
            each = np.repeat(error, sizes)
            v = theta[columns, 1:]
            others = np.repeat(np.add.reduceat(v, starts), sizes, axis=0) - v
            change = np.column_stack([each, each[:, None] * others])
            slope = np.stack(
                [np.bincount(columns, weights=change[:, f], minlength=width) for f in range(1 + FACTORS)],
                axis=1,
            )
            slope += DECAY * theta
            slope[0, 1:] = 0  # the bias has no factors
            step += 1
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope * slope
            theta -= (
                RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            )
    return FactorizationMachine(slots, theta[:, 0].copy(), theta[:, 1:].copy())


def _sample_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        hashed = [
            np.unique(np.fromiter(map(bucket_of, terms_of(t)), np.uint32)).tobytes()
            for t in batch["text"]
        ]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "buckets": hashed})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> FactorizationMachine:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0, at most ``max_rows`` of them.

    A doc_id labelled twice counts as toxic if one label says so; of several
    texts of one doc_id the smallest is read. Without usable rows the model
    scores every text one half.
    """
    chosen = (
        labels.filter("doc_id is not null and toxic in (0, 1)")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    sample = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # max_rows pairs of numbers at most
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
        .mapInPandas(_sample_features, "doc_id long, toxic int, buckets binary")
        .toArrow()
        .sort_by("doc_id")
    )
    rows = [np.frombuffer(b.as_buffer(), np.uint32) for b in sample["buckets"]]
    return fit(rows, sample["toxic"].to_numpy())


def score(
    docs: DataFrame,
    model: FactorizationMachine,
    threshold: float = 0.5,
    names: tuple[str, str] = ("score", "predicted"),
) -> DataFrame:
    """The columns of ``docs`` with a score (0 to 1) and a verdict (1 from ``threshold`` on).

    ``names`` are the two new columns; columns of ``docs`` so named are replaced.
    Null and empty texts get the bias alone; rows are scored each, whatever
    their doc_id. Only the texts go to Python, and only the two numbers come back.
    """
    (judged,) = unused(docs.columns, "_judged")

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        slots: dict[str, int] = {}
        for batch in batches:
            chances = [np.zeros(0)]
            for at in range(0, len(batch), _TEXTS):
                rows = []
                for text in batch.iloc[at : at + _TEXTS]:
                    own = []
                    for word in terms_of(text):
                        slot = slots.get(word)
                        if slot is None:
                            if len(slots) >= _CACHE:
                                slots.clear()
                            slot = slots[word] = model.slots.get(bucket_of(word), 0)
                        if slot:
                            own.append(slot)
                    rows.append(np.unique(np.array(own, np.int64)))
                chances.append(sigmoid(model.margin(*_layout(rows))))
            found = np.concatenate(chances)
            yield pd.DataFrame({"score": found, "predicted": (found >= threshold).astype("int32")})

    # Taken as not deterministic, so that a filter on the verdict does not score a text again.
    scorer = F.pandas_udf(scored, "score double, predicted int").asNondeterministic()
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.withColumn(judged, scorer("text")).select(
        *kept,
        F.col(judged).getField("score").alias(names[0]),
        F.col(judged).getField("predicted").alias(names[1]),
    )
