"""The shared folder for intermediate tables, and versioned publishing in it."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session in one process may go without that setting, as in tests, and gets a
    temporary folder: elsewhere a machine-local path would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="rateline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders made inside each open scope, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove the step folders made inside when the block ends.

    Write or collect what is wanted before that: a table read from a step
    cannot be read afterwards.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            remove(spark, folder)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A folder of its own; with ``keep`` it is left to the scope around the innermost one."""
    folder = f"{shared_folder(spark)}/rateline/{name}-{uuid.uuid4().hex}"
    around = _scopes[:-1] if keep else _scopes
    if around:
        around[-1].append(folder)
    return folder


#: Spark's setting to remove the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside go at its end, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str = "step", keep: bool = False) -> DataFrame:
    """Compute once into a table in the shared folder, and go on from there.

    The table cuts the lineage, outlives lost executors, and has a known size,
    so that the planner can tell whether a join may broadcast it. What was shuffled
    for it is removed.
    """
    folder = new_folder(df.sparkSession, name, keep)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_VERSIONS = T.StructType(
    [T.StructField("version", T.LongType()), T.StructField("attempt", T.StringType())]
)


def publish(
    df: DataFrame, root: str, version: int, partition_by: tuple[str, ...] = ()
) -> None:
    """Write one table version into a folder of its own, then announce it.

    Readers look only at announced folders, so a half-written one is never
    seen, and a replay leaves the files of those who already read alone.
    """
    attempt = new_attempt()
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/v={version}/{attempt}")
    announce(df.sparkSession, root, version, attempt)


def new_attempt() -> str:
    """A folder name that sorts after those of earlier attempts."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def announce(spark: SparkSession, root: str, version: int, attempt: str) -> None:
    """Make a written attempt the one that readers of the version take."""
    said = spark.createDataFrame([(version, attempt)], _VERSIONS)
    said.coalesce(1).write.mode("append").parquet(f"{root}/announced")


def announced(spark: SparkSession, root: str) -> DataFrame:
    """Every version and attempt; none where nothing was published yet."""
    if not exists(spark, f"{root}/announced"):
        return spark.createDataFrame([], _VERSIONS)
    return spark.read.schema(_VERSIONS).parquet(f"{root}/announced")


def current_version(spark: SparkSession, root: str) -> int:
    return announced(spark, root).agg(F.max("version")).first()[0]


def read_published(
    spark: SparkSession, root: str, schema: T.StructType, version: int | None = None
) -> DataFrame:
    """The announced version, the last one unless named, by its last attempt."""
    return spark.read.schema(schema).parquet(published_folder(spark, root, version))


def published_folder(spark: SparkSession, root: str, version: int | None = None) -> str:
    if version is None:
        version = current_version(spark, root)
    attempts = announced(spark, root).filter(F.col("version") == version)
    attempt = attempts.agg(F.max("attempt")).first()[0]
    if attempt is None:
        raise ValueError(f"version {version} is not announced")
    return f"{root}/v={version}/{attempt}"
