"""The corpus pipeline: stages over documents, each written and read again.

Toxic documents go, one document of each group of near copies stays, personal
data is replaced, documents are repeated or left out towards target weights, and
what remains is packed into token windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rateline.llm import jaccard, mixing, packing, pii, toxicity
from rateline.llm.names import unused
from rateline.llm.queries import DOMAINS, labelled_domains, table
from rateline.sources.workspace import materialize, scope

Docs = DataFrame

#: Toxic documents are gone by then; a share for them would repeat the few missed ones.
TARGETS = {"prose": 0.99, "rough": 0.01, "toxic": 0.0}


def drop_toxic(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score, toxic = unused(docs.columns, "_score", "_toxic")
    scored = toxicity.score(docs, model, names=(score, toxic))
    return scored.filter(F.col(toxic) == 0).select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    return jaccard.keep_one(docs)


def replace_personal_data(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    clean = pii.sanitise(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast("bigint"))


def mix_domains(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Likely prose is never left out: its rate is one at least."""
    model = mixing.train(docs, labelled_domains(table(spark, sf_dir, "labels")), DOMAINS)
    prose = F.col(f"p{DOMAINS.index('prose')}")
    floor = F.when(prose >= 0.5, 1.0).otherwise(0.0)
    return mixing.apply_rates(docs, mixing.mix(docs, model, TARGETS, floor=floor))


def pack_windows(spark: SparkSession, docs: Docs, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("personal data", replace_personal_data),
    ("mixing", mix_domains),
    ("packing", pack_windows),
]

#: Learned models and tokenizers are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage; the tables of the others are written on the way."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
