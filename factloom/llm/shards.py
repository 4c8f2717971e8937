"""Size-tiered compaction of immutable shards under a versioned manifest.

A dataset is a folder. ``data/<run>`` holds the Parquet shards of one append or merge, which are never changed.
``changes/<id>`` is a table of runs that came or went, and ``manifest/v<n>`` a short text that names the tables
which make up version n: a base and the changes since, which become a new base from time to time.

A version's text is written aside and renamed into place without overwriting: where the file system's rename
is atomic, as in HDFS, a version appears whole or not at all, and of two writers that make the same one the
second fails and goes on top of the first. A merge fails if one of its runs is gone by then. Readers take the
highest version; files of no version are invisible.

Arrivals are appended as small shards. A run's tier is the power of ``fanout`` by which it exceeds the
smallest size; once a tier holds ``fanout`` runs, these similarly sized runs are merged into files of the
target size. Each task of a merge reads several small files and writes one, without a shuffle. Between merges
a dataset has ``fanout`` runs in each of a few tiers, and those whose shards have reached the target size.
Everything but listing, renaming and deleting files is DataFrame operations.
"""

from __future__ import annotations

import time
import uuid
from math import ceil

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run string, bytes long, files long, rows long, tier int"
CHANGES = 16


class Shards:
    """``target_bytes``: of merged files. Runs whose shards have half of it on average are finished and never merged again."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, least_bytes: int = 64 << 10, fanout: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.least_bytes, self.fanout = target_bytes, least_bytes, fanout
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> dict[str, int]:
        """Names and times of change in a folder."""
        path = self._path(f"{self.root}/{folder}")
        found = self._fs.listStatus(path) if self._fs.exists(path) else []
        return {s.getPath().getName(): s.getModificationTime() for s in found}

    def version(self) -> int:
        """The highest committed version; 0 where there is none."""
        return max((int(n[1:]) for n in self._listed("manifest") if n.startswith("v") and n[1:].isdigit()), default=0)

    def _changes(self, version: int) -> list[str]:
        """The tables that make up a version, ``CHANGES`` at most."""
        return [r.value for r in self.spark.read.text(f"{self.root}/manifest/v{version:08d}").collect()] if version else []

    def manifest(self, version: int | None = None) -> DataFrame:
        """The runs of a version with their bytes, files, rows and tier."""
        changes = self._changes(self.version() if version is None else version)
        if not changes:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(f"{SCHEMA}, live boolean").parquet(*[f"{self.root}/changes/{c}" for c in changes])
        fields = ("bytes", "files", "rows", "tier")
        last = rows.groupBy("run").agg(*[F.max(c).alias(c) for c in fields], F.min("live").alias("live"))
        return last.where("live").select("run", *fields)

    def _written(self, df: DataFrame, folder: str) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{folder}/{name}")
        return name

    def _described(self, run: str) -> DataFrame:
        """The manifest's row of a run just written: sizes from the listing, rows from the files' footers."""
        folder = f"{self.root}/data/{run}"
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
        one = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))
        one = one.crossJoin(self.spark.read.parquet(folder).agg(F.count("*").alias("rows")))  # two single rows
        steps = F.floor(F.log(F.greatest(F.col("bytes") / self.least_bytes, F.lit(1.0))) / F.log(F.lit(float(self.fanout))) + 1e-9)
        tier = F.when(F.col("bytes") >= F.col("files") * (self.target_bytes // 2), -1).otherwise(steps).cast("int")
        return one.select(F.lit(run).alias("run"), "bytes", "files", "rows", tier.alias("tier"), F.lit(True).alias("live"))

    def _publish(self, version: int, changes: list[str]) -> bool:
        """Makes a version of these tables; False if there is one of that number."""
        aside, name = (self._path(f"{self.root}/manifest/{n}") for n in (f".{uuid.uuid4().hex}", f"v{version:08d}"))
        out = self._fs.create(aside, False)
        out.writeBytes("\n".join(changes))
        out.close()
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(name).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(name), how)
        except Py4JJavaError as error:
            self._fs.delete(aside, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def _commit(self, change: str, needs: list[str] = ()) -> int:
        """Adds a change to the latest version, whoever made it, and gives the new one; the runs in ``needs`` must still be there."""
        while True:
            version = self.version()
            if needs and self.manifest(version).where(F.col("run").isin(*needs)).count() < len(needs):
                raise RuntimeError("another writer has merged one of these runs")
            changes = self._changes(version)
            if len(changes) >= CHANGES:
                changes = [self._written(self.manifest(version).withColumn("live", F.lit(True)), "changes")]
            if self._publish(version + 1, [*changes, change]):
                return version + 1

    def _new_run(self, df: DataFrame, gone: DataFrame | None = None, needs: list[str] = ()) -> int:
        """Writes a run and commits it, in place of the runs in ``gone``. Until then its name is among the pending ones."""
        run = uuid.uuid4().hex
        mark = self._path(f"{self.root}/pending/{run}")
        self._fs.create(mark, False).close()
        df.write.parquet(f"{self.root}/data/{run}")
        change = self._described(run)
        if gone is not None:
            change = change.unionByName(gone.withColumn("live", F.lit(False)))
        version = self._commit(self._written(change, "changes"), needs)
        self._fs.delete(mark, False)
        return version

    def append(self, df: DataFrame) -> int:
        """Adds ``df`` as a run of new shards, one for each of its non-empty partitions, and commits the next version."""
        return self._new_run(df)

    def compact(self) -> int:
        """Merges every tier with ``fanout`` runs or more, until none has; commits a version for each merge."""
        while True:
            version = self.version()
            live = self.manifest(version)
            tiers = live.where("tier >= 0").groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
            full = tiers.where(F.col("n") >= self.fanout).orderBy("tier").first()
            if full is None:
                return version
            old = live.where(F.col("tier") == full.tier)
            runs = [row.run for row in old.select("run").collect()]
            merged = self.spark.read.parquet(*[f"{self.root}/data/{run}" for run in runs])
            self._new_run(merged.coalesce(max(1, ceil(full.bytes / self.target_bytes))), old, runs)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. The names of its runs come to the driver, as those of any table's folders do."""
        runs = [row.run for row in self.manifest(version).select("run").collect()]
        if not runs:
            raise ValueError("this version has no shards")
        return self.spark.read.parquet(*[f"{self.root}/data/{run}" for run in runs])

    def vacuum(self, keep: int = 1, grace_hours: float = 24.0) -> int:
        """Deletes the data of runs that none of the last ``keep`` versions holds and nobody is writing; how many.

        A run is named as pending before it has data and until it is committed. So of the runs listed here first,
        those that aren't pending afterwards are in a version read after that, or of no use. A pending run older
        than ``grace_hours`` was left by a writer that has died.
        """
        data, pending = self._listed("data"), self._listed("pending")
        alive = {run for run, t in pending.items() if time.time() - t / 1000 < grace_hours * 3600}
        version = self.version()
        held = {row.run for v in range(max(1, version - keep + 1), version + 1) for row in self.manifest(v).select("run").collect()}
        stale = [run for run in data if run not in held and run not in alive]
        for run in stale:
            self._fs.delete(self._path(f"{self.root}/data/{run}"), True)
            self._fs.delete(self._path(f"{self.root}/pending/{run}"), False)
        return len(stale)


def arrivals(df: DataFrame, by: str, batches: int) -> list[DataFrame]:
    """``df`` in ``batches`` by even ranges of a number column, nulls in the first; ranges are pushed into the scan."""
    low, high = df.agg(F.min(by), F.max(by)).first()
    if low is None or batches < 2:
        return [df]
    bounds = sorted({low + (high - low + 1) * i // batches for i in range(1, batches)})
    value, cuts = F.col(by), [None, *bounds, None]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        here = df.where(value < b) if b is not None else df
        if a is None:
            here = df.where((value < b) | value.isNull()) if b is not None else df
        elif b is not None:
            here = df.where((value >= a) & (value < b))
        else:
            here = df.where(value >= a)
        out.append(here)
    return out
