"""Language of pages by Bayesian fusion of four kinds of evidence.

    log P(language | page) = log prior(host) + text + log P(declared | language)
                             + log P(suffix | language) + constant

text is the likelihood of the visible text's byte trigrams, learned from a
bounded sample of documents with known language. The other tables come from
grouped aggregation of the text posteriors over all pages: the markup's declared
language, the address suffix, and the host's counts, smoothed towards its
domain's, smoothed towards all pages'. A page's own count is taken out of its
host's and its domain's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateline.llm.urls import host_of
from rateline.sources.workspace import materialize

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 15
#: Documents of each language that the text model reads, the first by hash of doc_id.
MAX_TRAINING = 2_000
#: Trigrams of one text are not independent: its mean counts for so many at most.
EVIDENCE = 40.0
#: Pages that a smoothing parent counts for.
STRENGTH = 5.0

_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"<[^>]*>")
_LETTERS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b"


def visible(html: str | None) -> str:
    return _TAG.sub(" ", _HIDDEN.sub(" ", html)) if html else ""


def trigrams(text: str) -> np.ndarray:
    """Buckets of the lower-cased text's byte trigrams, anything but letters as one space."""
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS)
    b = np.frombuffer(b" " + b" ".join(raw.split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] * 0x9E3779B1) ^ (b[1:-1] * 0x85EBCA6B) ^ (b[2:] * 0xC2B2AE35)) >> np.uint32(17)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for language, own in batch.groupby("lang"):
            found = np.concatenate([trigrams(t) for t in own["text"]])
            bucket, n = np.unique(found, return_counts=True)
            yield pd.DataFrame({"lang": language, "bucket": bucket.astype("int32"), "n": n})


def train(docs: DataFrame, max_rows: int = MAX_TRAINING) -> np.ndarray:
    """log P(bucket | language), from ``docs(doc_id, text, lang)``.

    Rows with a null or another language or a null text are left out; a
    language without rows gets equal chances.
    """
    ids = docs.filter(F.col("doc_id").isNotNull()).select("lang", "doc_id")
    # A top-k a language keeps max_rows in each task, so no task sorts a language's ids.
    chosen = reduce(
        DataFrame.union,
        [
            ids.filter(F.col("lang") == language).distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
            for language in LANGUAGES
        ],
    )
    counts = (
        docs.filter("text is not null").select("doc_id", "lang", "text")
        .join(F.broadcast(chosen), ["lang", "doc_id"])  # max_rows of each language
        .mapInPandas(_counted, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        .toPandas()  # BUCKETS rows of each language at most
    )
    table = np.full((len(LANGUAGES), BUCKETS), 0.5)
    rows = counts["lang"].map({x: i for i, x in enumerate(LANGUAGES)})
    table[rows.to_numpy(int), counts["bucket"].to_numpy(int)] += counts["n"].to_numpy(float)
    return np.log(table / table.sum(1, keepdims=True))


def evidence(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared and text chances t_de, ... of every page."""
    labels = F.split("host", r"\.")
    known = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), "html",
        F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1)).alias("declared"),
    ).select(
        "page_id", "host",
        F.concat_ws(".", F.slice(labels, -2, 2)).alias("domain"),
        F.element_at(labels, -1).alias("suffix"),
        F.when(F.col("declared").isin(*LANGUAGES), F.col("declared"))
        .when(F.col("declared") == "", F.lit("none")).otherwise(F.lit("other")).alias("declared"),
        "html",
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chances = np.full((len(batch), len(LANGUAGES)), 1 / len(LANGUAGES))
            for i, html in enumerate(batch["html"]):
                found = trigrams(visible(html))
                if len(found):
                    logs = model[:, found].mean(1) * min(len(found), EVIDENCE)
                    chances[i] = np.exp(logs - logs.max())
                    chances[i] /= chances[i].sum()
            out = batch.drop(columns="html")
            for j, language in enumerate(LANGUAGES):
                out[f"t_{language}"] = chances[:, j]
            yield out

    return known.mapInPandas(
        read,
        "page_id long, host string, domain string, suffix string, declared string, "
        + ", ".join(f"t_{x} double" for x in LANGUAGES),
    )


def _sums(table: DataFrame, key: str, prefix: str) -> DataFrame:
    return table.groupBy(key).agg(*[F.sum(f"t_{x}").alias(f"{prefix}_{x}") for x in LANGUAGES])


def _total(prefix: str) -> Column:
    return sum([F.col(f"{prefix}_{x}") for x in LANGUAGES[1:]], F.col(f"{prefix}_{LANGUAGES[0]}"))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: language, confidence and the parts.

    Null or empty pages have no text evidence and get their host's, suffix's and
    declaration's answer; a null URL has the empty host. Ties go to the
    language first in ``LANGUAGES``. Repeated rows are judged each.
    """
    table = materialize(evidence(pages, train(docs)), "page-evidence")
    everywhere = table.agg(
        *[F.coalesce(F.sum(f"t_{x}"), F.lit(0.0)).alias(f"g_{x}") for x in LANGUAGES]
    ).first()
    whole = sum(everywhere)
    share = {x: (everywhere[f"g_{x}"] + 1) / (whole + len(LANGUAGES)) for x in LANGUAGES}
    joined = (
        table.join(_sums(table, "host", "h"), "host")
        .join(_sums(table, "domain", "d"), "domain")
        .join(_sums(table, "suffix", "s"), "suffix")
        .join(_sums(table, "declared", "m"), "declared")
    )
    logs = []
    for x in LANGUAGES:
        own = F.col(f"t_{x}")
        domain = (F.col(f"d_{x}") - own + STRENGTH * share[x]) / (_total("d") - 1 + STRENGTH)
        prior = (F.col(f"h_{x}") - own + STRENGTH * domain) / (_total("h") - 1 + STRENGTH)
        given = lambda prefix: (
            F.col(f"{prefix}_{x}") + STRENGTH * _total(prefix) / (whole or 1)
        ) / (everywhere[f"g_{x}"] + STRENGTH)
        text = F.log(F.greatest(own, F.lit(1e-30)))
        logs.append((F.log(F.greatest(prior, F.lit(1e-9))) + text + F.log(given("m")) + F.log(given("s"))).alias(f"l_{x}"))
    chances = [F.exp(F.col(f"l_{x}") - F.col("top")) for x in LANGUAGES]
    total = sum(chances[1:], chances[0])
    text_top = F.greatest(*[F.col(f"t_{x}") for x in LANGUAGES])

    def first_at(top: Column, prefix: str) -> Column:
        return F.coalesce(*[F.when(F.col(f"{prefix}_{x}") == top, F.lit(x)) for x in LANGUAGES])

    return (
        joined.select("*", *logs)
        .withColumn("top", F.greatest(*[F.col(f"l_{x}") for x in LANGUAGES]))
        .select(
            "page_id", "host", "declared",
            first_at(text_top, "t").alias("text_language"),
            first_at(F.col("top"), "l").alias("language"),
            (F.lit(1.0) / total).alias("confidence"),
        )
    )
