"""A log of runs that folds itself as it grows.

Each batch of a stream adds one run, a folder of rows. When ``fanout`` runs of a
level have come together they are folded into one run of the next level, so that a row
is written again once a level, and no more than fanout runs of each level are read.

What counts is named by the last manifest, a small file for each version, written
aside and renamed into place. A batch that fails half-way leaves a run that no manifest
names; a batch that is run again after its manifest finds itself there and does nothing.
Sources number their batches each for itself, so a stream with a new checkpoint adds to
the same log. Manifests and runs that are no longer named are removed, but for the last ones,
which readers may still hold.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FANOUT = 8
#: Versions that readers may still be reading.
KEPT = 3


@dataclass(frozen=True)
class Run:
    path: str
    level: int


@dataclass(frozen=True)
class Manifest:
    """``batches`` is the last batch of each source, ``runs`` what to read, the oldest first."""

    version: int = -1
    batches: dict[str, int] = field(default_factory=dict)
    runs: tuple[Run, ...] = ()


class RunLog:
    """``fold`` gives the rows that stand for several runs; ``partition_by`` lays out each run."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: T.StructType,
        fold: Callable[[DataFrame], DataFrame],
        partition_by: tuple[str, ...] = (),
        sort_by: tuple[str, ...] = (),
        fanout: int = FANOUT,
    ):
        self.spark, self.root, self.schema, self.fold = spark, root.rstrip("/"), schema, fold
        self.partition_by, self.sort_by, self.fanout = partition_by, sort_by, fanout

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _remove(self, name: str) -> None:
        path = self._path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[0] != "."]

    def _load(self, version: int) -> Manifest:
        path = self._path(f"manifest/{version:020d}.json")
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        said = json.loads(text)
        return Manifest(said["version"], said["batches"], tuple(Run(**r) for r in said["runs"]))

    def _publish(self, manifest: Manifest) -> None:
        final = self._path(f"manifest/{manifest.version:020d}.json")
        aside = self._path(f"manifest/.{uuid.uuid4().hex}")
        fs = final.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, False)
            raise RuntimeError(f"version {manifest.version} of {self.root} was written by another stream")

    def last(self) -> Manifest:
        versions = self._versions()
        return self._load(versions[-1]) if versions else Manifest()

    def has(self, source: str, batch_id: int) -> bool:
        return self.last().batches.get(source, -1) >= batch_id

    def read(self, runs: tuple[Run, ...] | None = None) -> DataFrame:
        """The rows of all runs, or of ``runs``; several rows may stand for what ``fold`` makes one."""
        runs = self.last().runs if runs is None else runs
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.root}/runs/run={r.path}" for r in runs]
        reader = self.spark.read.schema(self.schema).option("basePath", f"{self.root}/runs")
        return reader.parquet(*paths).select(*self.schema.names)

    def folded(self) -> DataFrame:
        return self.fold(self.read())

    def _write(self, rows: DataFrame, level: int) -> Run:
        run = Run(f"l{level}-{uuid.uuid4().hex}", level)
        rows = rows.select(*self.schema.names)
        if self.partition_by:
            rows = rows.hint("rebalance", *self.partition_by)
        if self.sort_by:
            rows = rows.sortWithinPartitions(*self.partition_by, *self.sort_by)
        writer = rows.write.partitionBy(*self.partition_by) if self.partition_by else rows.write
        writer.parquet(f"{self.root}/runs/run={run.path}")
        return run

    def commit(self, source: str, batch_id: int, rows: DataFrame) -> bool:
        """Add the rows of a batch; False if the log has them."""
        before = self.last()
        if before.batches.get(source, -1) >= batch_id:
            return False
        runs = [*before.runs, self._write(rows, 0)]
        level = 0
        while len(same := [r for r in runs if r.level == level]) >= self.fanout:
            merged = self._write(self.fold(self.read(tuple(same))), level + 1)
            at = runs.index(same[0])
            runs = [r for r in runs if r.level != level]
            runs.insert(at, merged)
            level += 1
        self._publish(Manifest(before.version + 1, {**before.batches, source: batch_id}, tuple(runs)))
        self._sweep()
        return True

    def _sweep(self) -> None:
        """Remove old manifests, and runs that no manifest names."""
        versions = self._versions()
        for version in versions[:-KEPT]:
            self._remove(f"manifest/{version:020d}.json")
        named = {f"run={r.path}" for v in versions[-KEPT:] for r in self._load(v).runs}
        for name in self._names("runs"):
            if name not in named:
                self._remove(f"runs/{name}")
