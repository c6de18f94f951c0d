"""Mixing documents to target weights by soft membership.

A naive Bayes classifier over hashed words, fitted on a bounded sample of the
labelled rows, gives every document a posterior over the domains. Nonnegative
rates are then fitted so that the expected tokens of each domain,
sum_i rate_i * tokens_i * posterior_id, meet the targets, each within a share of its
own. The fit is projected gradient descent on the squared gaps in the metric
G^-1, G_de = sum_i tokens_i * posterior_id * posterior_ie, with tokens_i as the metric
of the rates; in it a step of one cannot overshoot. Longer steps, one of them in the
metric of the rates above their floor, are tried with it, and the best is taken. A rate depends on its row and the
steps alone, so an iteration is one aggregation; every ``WRITTEN`` steps the rates are
written, so that a path stays short.

Only DataFrame functions; the driver sees a few numbers per domain and step.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateline.llm.names import unused
from rateline.sources.workspace import materialize

BUCKETS = 1 << 18
MAX_LABELLED = 20_000
#: Buckets kept in the classifier, those that tell domains apart most surely.
TERMS = 65_536
SMOOTHING = 0.5
DAMPING = 0.25
WRITTEN = 20
#: Of each domain's own target, or of its present tokens if the target is 0.
TOLERANCE = 1e-3
#: The fit has ended when a step takes less than this share off the squared gaps.
STILL = 1e-3
#: Of the longer steps.
LEAPS = (8.0, 64.0)

_NO_WORDS = "[^\\p{L}]+"
_SHAPES = "#*$%&|<>!"


def _words() -> Column:
    """Lower-cased letter runs and two words for the share of symbols and of capitals."""
    size, none = F.length("text"), F.array().cast("array<string>")
    share = lambda kept: F.floor((size - F.length(kept)) * 20 / F.greatest(size, F.lit(1)))
    capitals = F.regexp_replace("text", "[A-Z]", "")
    shapes = F.array(
        F.concat(F.lit("#symbols"), share(F.translate("text", _SHAPES, ""))),
        F.concat(F.lit("#capitals"), share(capitals)),
    )
    return F.concat(F.split(F.lower("text"), _NO_WORDS), F.when(size > 0, shapes).otherwise(none))


def _bucket(word: str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@dataclass(frozen=True)
class Classifier:
    """``weights``: bucket, w0, w1, ...; ``priors``: log shares by domain."""

    domains: tuple[str, ...]
    weights: DataFrame
    priors: tuple[float, ...]


def train(
    docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], max_rows: int = MAX_LABELLED
) -> Classifier:
    """Fit on ``labelled(doc_id, domain)``, the first ``max_rows`` ids by hash.

    An id with several domains counts for the first of ``domains`` among them;
    other domains and null ids are left out. Without rows all shares are equal.
    """
    place = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    chosen = (
        labelled.filter("doc_id is not null")
        .select("doc_id", place.cast("int").alias("domain"))
        .filter("domain >= 0")
        .groupBy("doc_id")
        .agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    chosen = materialize(chosen, "mix-labels")
    share = {r["domain"]: r["count"] for r in chosen.groupBy("domain").count().collect()}
    whole = sum(share.values()) + len(domains)
    counts = (
        _texts(docs)
        .join(F.broadcast(chosen), "doc_id")  # max_rows pairs of numbers at most
        .select("domain", F.explode(_words()).alias("word"))
        .filter("word <> ''")
        .groupBy(_bucket("word").alias("bucket"))
        .agg(*[F.count_if(F.col("domain") == i).alias(f"c{i}") for i in range(len(domains))])
    )
    n = range(len(domains))
    counts = materialize(counts, "mix-counts")  # at most BUCKETS rows
    totals = counts.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"t{i}") for i in n]).first()
    logs = [
        F.log((F.col(f"c{i}") + SMOOTHING) / F.lit(totals[i] + SMOOTHING * BUCKETS)) for i in n
    ]
    centre = sum(logs[1:], logs[0]) / len(domains)
    spread = F.greatest(*logs) - F.least(*logs)
    seen = sum([F.col(f"c{i}") for i in n[1:]], F.col("c0"))
    weights = (
        counts.select("bucket", *[(x - centre).alias(f"w{i}") for i, x in enumerate(logs)],
                      (spread * F.sqrt(seen)).alias("surety"))
        .orderBy(F.desc("surety"), "bucket")
        .limit(TERMS)
        .drop("surety")
    )
    from math import log

    priors = tuple(log((share.get(i, 0) + 1) / whole) for i in n)
    return Classifier(domains, materialize(weights, "mix-weights"), priors)


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, text_key, n_rows, tokens and p0, p1, ... for each different (doc_id, text).

    Tokens are words of all ``n_rows`` equal rows. The evidence of the known words is
    divided by a power of their number, since words of one text are not independent. A text without known words, null or empty, gets the shares.
    """
    n = range(len(model.domains))
    sums = (
        _texts(docs)
        .withColumn("text_key", F.xxhash64("text"))
        .select("doc_id", "text_key", F.posexplode(_words()).alias("at", "word"))
        .withColumn("bucket", F.when(F.col("word") != "", _bucket("word")))
        .join(F.broadcast(model.weights), "bucket", "left")  # TERMS rows at most
        .groupBy("doc_id", "text_key")
        .agg(
            F.count_if(F.col("at") == 0).alias("n_rows"),
            F.count_if((F.col("word") != "") & ~F.col("word").startswith("#")).alias("tokens"),
            F.count("w0").alias("known"),
            *[F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in n],
        )
    )
    known = F.greatest(F.col("known") / F.col("n_rows"), F.lit(1.0))
    root = F.pow(known, F.lit(DAMPING)) * F.col("n_rows")
    scored = sums.select(
        "doc_id", "text_key", "n_rows", "tokens",
        *[(F.col(f"s{i}") / root + model.priors[i]).alias(f"l{i}") for i in n],
    ).withColumn("top", F.greatest(*[F.col(f"l{i}") for i in n]))
    chances = [F.exp(F.col(f"l{i}") - F.col("top")) for i in n]
    total = sum(chances[1:], chances[0])
    return scored.select(
        "doc_id", "text_key", "n_rows", "tokens",
        *[(c / total).alias(f"p{i}") for i, c in enumerate(chances)],
    )


def _rate(steps: list[list[float]], floor: Column) -> Column:
    """All steps taken from column ``_start``, each projected onto the rates from ``floor`` on."""
    if not steps:
        return F.greatest(floor, F.col("_start"))
    path = F.array(*[F.array(*map(F.lit, s)) for s in steps])
    return F.aggregate(
        path,
        F.col("_start"),
        lambda r, s: F.greatest(
            floor,
            r - sum([F.col(f"p{i}") * F.get(s, F.lit(i)) for i in range(1, len(steps[0]))],
                    F.col("p0") * F.get(s, F.lit(0))),
        ),
    )


def _sums(table: DataFrame, values: list[Column]) -> list[float]:
    """Of each column, times the tokens."""
    row = table.agg(*[F.coalesce(F.sum(v * F.col("tokens")), F.lit(0.0)) for v in values]).first()
    return [float(x) for x in row]


def _gaps(now: np.ndarray, want: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Off by how much of the target, or of the present tokens if the target is 0."""
    of = np.where(want > 0, want, present)
    return np.divide(np.abs(now - want), of, out=np.zeros(len(of)), where=of > 0)


def mix(
    docs: DataFrame,
    model: Classifier,
    targets: dict[str, float],
    budget: float = 1.0,
    floor: Column | None = None,
) -> DataFrame:
    """Posteriors with ``rate`` and ``copies`` for each different (doc_id, text).

    ``targets`` are shares of ``budget`` times the present tokens. ``floor`` is
    the least rate of a row (0 if none), a Column over p0, p1, .... copies is the
    rate rounded up or down by a hash of the row, so that its expectation is
    the rate. Without tokens the rates stay at one. Targets that no rates meet,
    as may be with a floor, are approached as far as they can be, with a warning
    that names what is missing.
    """
    floor = F.lit(0.0) if floor is None else floor.cast("double")
    table = materialize(posteriors(docs, model).withColumn("_start", F.lit(1.0)), "mix-posteriors")
    shares = [F.col(f"p{i}") for i in range(len(model.domains))]
    n = len(shares)
    present = np.array(_sums(table, shares))
    whole = present.sum()
    products = [a * b for a in shares for b in shares]

    def inverted(sums: list[float]) -> np.ndarray:
        return np.linalg.pinv(np.array(sums).reshape(n, n), hermitian=True)

    inverse = inverted(_sums(table, products))
    want = np.array([targets.get(d, 0.0) for d in model.domains])
    want *= whole * budget / (sum(targets.values()) or 1.0)
    steps: list[list[float]] = []
    tried: list[list[list[float]]] = [[]]
    before = np.inf
    while whole:
        sums = np.array(_sums(table, [
            x for rate in (_rate(path, floor) for path in tried)
            for x in [*[rate * p for p in shares], *[F.when(rate > floor, x) for x in products]]
        ])).reshape(len(tried), -1)
        off = sums[:, :n] - want
        values = ((off @ inverse) * off).sum(1) / 2
        best = int(values.argmin())
        steps, off, value = tried[best], off[best], values[best]
        left = _gaps(off + want, want, present)
        if left.max() <= TOLERANCE:
            break
        if before - value <= STILL * value:
            missed = ", ".join(f"{d} by {x:.2%}" for d, x in zip(model.domains, left) if x > TOLERANCE)
            warnings.warn(f"the rates do not meet all targets; missed: {missed}", stacklevel=2)
            break
        before = value
        if len(steps) >= WRITTEN:
            table, steps = materialize(table.withColumn("_start", _rate(steps, floor)), "mix-rates"), []
        step = inverse @ off
        tried = [[*steps, x.tolist()] for x in (step, *[k * step for k in LEAPS], inverted(sums[best, n:]) @ off)]
    coin = F.pmod(F.xxhash64("doc_id", "text_key", F.lit("copies")), F.lit(1 << 20)) / (1 << 20)
    return (
        table.withColumn("rate", _rate(steps, floor)).drop("_start")
        .withColumn("copies", F.floor(F.col("rate") + coin))
    )


def apply_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """The columns and rows of ``docs``, each row as often as its ``copies`` say."""
    id_, key, n, copy = unused(docs.columns, "_id", "_key", "_n", "_copy")
    known = rates.select(
        F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("copies").alias(n)
    )
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (
        F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(key)
    )
    names = [f"`{c}`" for c in docs.columns]
    return (
        docs.join(known.filter(F.col(n) > 0), same)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
        .select(*names)
    )
