"""Versions of a table kept as changes: a full copy now and then, change sets between.

A version is either a full copy under ``base`` or the rows added, changed and gone since the
version before it, under ``change``. What is written follows the change, and a reader applies
at most as many change sets as one full copy allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rateline.sources.workspace import announced, publish, published_folder

#: Change sets that may follow a full copy before the next one is written.
CHAIN = 8

OP, VERSION = "_op", "_version"


def _same(left: str, right: str, columns: list[str]) -> Column:
    """Null equals null, also in keys."""
    return reduce(
        lambda a, b: a & b,
        [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in columns],
        F.lit(True),
    )


def change_set(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` that are "added" or "changed", and those "gone", with ``_op``.

    A key names one row on each side. A row that is gone carries its old values.
    """
    values = [c for c in new.columns if c not in keys]
    one = old.select(*[f"`{c}`" for c in new.columns], F.lit(True).alias("_there")).alias("one")
    two = new.select("*", F.lit(True).alias("_there")).alias("two")
    was, now = F.col("one._there"), F.col("two._there")
    op = (
        F.when(was.isNull(), "added")
        .when(now.isNull(), "gone")
        .when(~_same("one", "two", values), "changed")
    )
    picked = [
        F.when(now.isNull(), F.col(f"one.`{c}`")).otherwise(F.col(f"two.`{c}`")).alias(c)
        for c in new.columns
    ]
    return (
        one.join(two, _same("one", "two", keys), "full_outer")
        .select(*picked, op.alias(OP))
        .filter(F.col(OP).isNotNull())
    )


def _versions(spark: SparkSession, root: str) -> list[int]:
    return [r[0] for r in announced(spark, root).select("version").distinct().collect()]


def save_version(
    table: DataFrame,
    root: str,
    version: int,
    keys: list[str],
    chain: int = CHAIN,
    partition_by: tuple[str, ...] = (),
) -> str:
    """Write the next version: a full copy at first and after ``chain`` change sets.

    Returns "base" or "change". The last version may be saved again, as after a failure; an older
    one may not, as later change sets build on it. ``partition_by`` lays out full copies.
    """
    spark = table.sparkSession
    bases, changes = _versions(spark, f"{root}/base"), _versions(spark, f"{root}/change")
    if any(v > version for v in (*bases, *changes)):
        raise ValueError(f"versions after {version} build on it")
    base = max((v for v in bases if v < version), default=None)
    since = [v for v in changes if base is not None and base < v < version]
    if version in bases or base is None or (version not in changes and len(since) >= chain):
        publish(table, f"{root}/base", version, partition_by)
        return "base"
    before = read_version(spark, root, table.schema, keys, max([base, *since]))
    publish(change_set(before, table, keys), f"{root}/change", version)
    return "change"


def read_version(
    spark: SparkSession, root: str, schema: T.StructType, keys: list[str], version: int | None = None
) -> DataFrame:
    """A version, the last one unless named: its full copy with the change sets since on top.

    Of several changes of a row the last one counts. The full copy is not shuffled unless the
    change sets are too large to broadcast, and a filter on it reaches its files.
    """
    bases, changes = _versions(spark, f"{root}/base"), _versions(spark, f"{root}/change")
    if version is None:
        version = max((*bases, *changes), default=None)
    if version is None or version not in (*bases, *changes):
        raise ValueError(f"version {version} is not announced")
    base = max(v for v in bases if v <= version)
    stored = spark.read.schema(schema).parquet(published_folder(spark, f"{root}/base", base))
    since = sorted(v for v in changes if base < v <= version)
    if not since:
        return stored
    logged = T.StructType([*schema.fields, T.StructField(OP, T.StringType())])
    read = [
        spark.read.schema(logged)
        .parquet(published_folder(spark, f"{root}/change", v))
        .withColumn(VERSION, F.lit(v))
        for v in since
    ]
    rows = [*[c for c in schema.names if c not in keys], OP]
    last = (
        reduce(DataFrame.union, read)
        .groupBy(*[f"`{c}`" for c in keys])
        .agg(F.max_by(F.struct(*[f"`{c}`" for c in rows]), VERSION).alias("_last"))
    )
    kept = stored.alias("one").join(last.alias("two"), _same("one", "two", keys), "left_anti")
    names = [F.col(f"`{c}`") if c in keys else F.col(f"_last.`{c}`").alias(c) for c in schema.names]
    return kept.union(last.filter(F.col(f"_last.{OP}") != "gone").select(*names))
