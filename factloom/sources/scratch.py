"""Tables of a job's own, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_listed: ContextVar[list[str] | None] = ContextVar("scratch tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session that names none gets one of its own; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: what follows doesn't compute it anew."""
    path = f"{shared_dir(df.sparkSession)}/factloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _listed.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def listed(paths: list[str]) -> Iterator[None]:
    """While it is open, the paths of ``written`` tables are added to ``paths``; those still there then go to the list around it."""
    before = _listed.set(paths)
    try:
        yield
    finally:
        _listed.reset(before)
        if (around := _listed.get()) is not None:
            around += [p for p in paths if p not in around]


def remove(spark: SparkSession, paths: list[str], *labels: str) -> None:
    """Deletes the tables in ``paths`` (with labels only those) that nothing will read any more, and takes them off the list."""
    for path in [p for p in paths if not labels or p.rsplit("/", 1)[-1].rsplit("-", 1)[0] in labels]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        paths.remove(path)
