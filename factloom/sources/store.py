"""Keyed tables as deltas in hash buckets: a batch writes its own rows only, and one list of folders says what counts.

    base/data/<table>/delta=<number>-<id>/bucket=<b>/part-*   rows of a batch, or of buckets that were merged
    base/versions/<number>-<id>/                              which (table, delta, bucket) a version holds

A version counts once its list is whole, so readers see all of a batch or nothing. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.scratch import remove

BUCKETS = 16
#: A bucket of so many deltas is merged into one.
DELTAS = 8


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _names(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def _versions(spark: SparkSession, base: str) -> list[str]:
    return [p.rsplit("/", 1)[0] for p in _names(spark, f"{base}/versions/*/_SUCCESS")]


def _list(spark: SparkSession, version: str) -> list[tuple[str, str, int, int]]:
    """(table, delta, bucket, number of buckets): a row for each folder of a version."""
    return [tuple(r) for r in spark.read.parquet(version).select("table", "delta", "bucket", "buckets").collect()]


def _commit(spark: SparkSession, base: str, number: int, rows: list[tuple]) -> None:
    told = spark.createDataFrame(rows, "table string, delta string, bucket int, buckets int")
    told.coalesce(1).write.parquet(f"{base}/versions/{number:012d}-{uuid.uuid4().hex}")


def bucket_count(spark: SparkSession, base: str) -> int:
    return _list(spark, _versions(spark, base)[-1])[0][3]


def read(spark: SparkSession, base: str, keys: list | None = None) -> dict[str, DataFrame]:
    """Each table's rows in all deltas, with ``delta`` and ``bucket``; of ``keys`` only their buckets are read."""
    there = _versions(spark, base)
    rows = _list(spark, there[-1]) if there else []
    if keys is not None and rows:
        some = spark.createDataFrame([(str(k),) for k in keys], "k string")
        wanted = {r[0] for r in some.select(bucket_of(F.col("k"), rows[0][3])).distinct().collect()}
        rows = [r for r in rows if r[2] in wanted] or [r for r in rows if r[1] == rows[0][1]]
    out = {}
    for name in sorted({r[0] for r in rows}):
        folders = [f"{base}/data/{name}/delta={d}/bucket={b}" for t, d, b, _ in sorted(rows) if t == name]
        df = spark.read.option("basePath", f"{base}/data/{name}").option("mergeSchema", "true").parquet(*folders)
        df = df.withColumn("delta", F.col("delta").cast("string"))
        if keys is not None:
            df = df.where(F.col("bucket").isin(*wanted) & F.col("run_id").cast("string").isin(*map(str, keys)))
        out[name] = df
    return out


def write(tables: dict[str, DataFrame], base: str, merged: dict[str, Callable[[DataFrame], DataFrame]], buckets: int = BUCKETS) -> None:
    """``tables`` (each with ``run_id``) as a new delta; buckets that have grown to ``DELTAS`` deltas are merged by the functions in ``merged``.

    Folders that no version lists, as a broken write leaves them, are removed first; so are those that only versions
    before the last two list. Data of other buckets stays as it is, file by file.
    """
    spark = next(iter(tables.values())).sparkSession
    there = _versions(spark, base)
    lists = [_list(spark, v) for v in there[-2:]]
    kept = {(t, d) for rows in lists for t, d, *_ in rows}
    found = _names(spark, f"{base}/data/*/delta=*")
    remove(spark, [p for p in found if (p.split("/")[-2], p.split("delta=")[-1]) not in kept])
    remove(spark, [p for p in _names(spark, f"{base}/versions/*") if p not in there[-2:]])

    rows = lists[-1] if lists else []
    buckets = rows[0][3] if rows else buckets
    number = int(there[-1].rsplit("/", 1)[-1].split("-")[0]) + 1 if there else 1
    delta = f"{number:012d}-{uuid.uuid4().hex}"
    rows = rows + _written(tables, base, delta, buckets)
    _commit(spark, base, number, rows)

    many: dict[tuple[str, int], int] = {}
    for t, _, b, _ in rows:
        many[t, b] = many.get((t, b), 0) + 1
    full = {tb for tb, n in many.items() if n >= DELTAS}
    if full:
        held = read(spark, base)
        some = {t: merged[t](held[t].where(F.col("bucket").isin([b for name, b in full if name == t]))) for t in {t for t, _ in full}}
        delta = f"{number + 1:012d}-{uuid.uuid4().hex}"
        rows = [r for r in rows if (r[0], r[2]) not in full] + _written(some, base, delta, buckets)
        _commit(spark, base, number + 1, rows)


def _written(tables: dict[str, DataFrame], base: str, delta: str, buckets: int) -> list[tuple[str, str, int, int]]:
    """Writes a delta of each table; the rows that list it. A table without rows has an empty bucket 0, for its columns."""
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        folder = f"{base}/data/{name}/delta={delta}"
        df = df.drop("delta", "bucket")
        dealt = df.withColumn("bucket", bucket_of(F.col("run_id"), buckets)).repartition("bucket", F.pmod(F.xxhash64("run_id"), F.lit(64)))
        dealt.write.partitionBy("bucket").parquet(folder)
        found = [int(p.split("bucket=")[-1]) for p in _names(spark, f"{folder}/bucket=*")]
        if not found:
            df.limit(0).write.parquet(f"{folder}/bucket=0")
            found = [0]
        rows += [(name, delta, b, buckets) for b in found]
    return rows
