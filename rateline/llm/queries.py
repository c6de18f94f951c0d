"""The named queries over the text tables, and SQL where it can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rateline.llm import (
    content_sort,
    divergence,
    jaccard,
    langid,
    licenses,
    mixing,
    packing,
    pii,
    quality_rules,
    topk,
    toxicity,
    urls,
    vector_codes,
)
from rateline.llm.sql import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op2_exact_top_k(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), k=5, every=50)


@query
def op3_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


@query
def op4_packing(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op5_quality_rules(spark, folder):
    return quality_rules.judge(table(spark, folder, "documents")).select(
        *["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        *["n_stop_words", "base_failed", "kept"],
    )


#: Labels of hosts whose pages make up the example block list. Fixed values.
LISTED_LABELS = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
#: Fixed values.
URL_RULES = (
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
)


@query
def op10_url_filter(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    labels = F.split(urls.host_of(F.col("url")), r"\.")
    listed = pages.filter(F.arrays_overlap(labels, F.array(*map(F.lit, LISTED_LABELS))))
    return urls.filter_urls(pages, listed, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "listed"
    )


@query
def op1_pii(spark, folder):
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("bigint")
    return pii.spans(table(spark, folder, "documents")).select(
        "doc_id",
        *[count(i).alias(f"n_{name}") for i, name in enumerate(pii.KINDS[: pii.BASE])],
        F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.written(F.concat("base", "terms")).alias("spans"),
        F.size("terms").cast("bigint").alias("n_terms"),
    )


@query
def op7_license_scan(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query
def op8_language_id(spark, folder):
    return langid.identify(table(spark, folder, "pages"), table(spark, folder, "documents"))


DOMAINS = ("prose", "rough", "toxic")
TARGETS = {"prose": 0.99, "rough": 0.008, "toxic": 0.002}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """Toxic rows are toxic whatever their quality; the others are prose or rough."""
    domain = (
        F.when(F.col("toxic") == 1, F.lit("toxic"))
        .when(F.col("quality") == 1, F.lit("prose"))
        .when(F.col("quality") == 0, F.lit("rough"))
    )
    return labels.select("doc_id", domain.alias("domain"))


@query
def op9_mixing(spark, folder):
    docs = table(spark, folder, "documents")
    model = mixing.train(docs, labelled_domains(table(spark, folder, "labels")), DOMAINS)
    mixed = mixing.mix(docs, model, TARGETS)
    names = [F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return mixed.select("doc_id", "n_rows", "tokens", *names, "rate", "copies")


@query
def op6_ngram_jaccard(spark, folder):
    return jaccard.near_duplicates(table(spark, folder, "documents"))


@query
def op11_source_divergence(spark, folder):
    return divergence.audit(table(spark, folder, "documents"))


@query
def op12_content_sort(spark, folder):
    return content_sort.duplicates(table(spark, folder, "documents"), keep="largest")


@query
def op13_vector_codes(spark, folder):
    coded, books = vector_codes.encode(table(spark, folder, "embeddings"))
    digest = F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest())
    return vector_codes.label_errors(coded).select(
        "vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256")
    )
