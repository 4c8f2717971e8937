"""Cutting lineage in the folder that driver and executors share, and small DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.sources.scratch import listed, remove, shared_dir, written

__all__ = ["SEPARATORS", "cut", "listed", "numbered", "positions", "remove", "running_totals", "shared_dir", "small_join", "written"]

#: Separators of words: space and \t \n \v \f \r, and nothing else.
SEPARATORS = r"[\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, for small tables that several jobs read: a scratch table that can be removed, unlike a checkpoint."""
    return written(df, "cut")


def running_totals(parts: DataFrame, part: str, value: str, out: str) -> DataFrame:
    """``part`` and the sum of ``value`` over smaller parts. ``parts`` has a row for each partition of a job, no more."""
    ahead = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(part, F.coalesce(F.sum(value).over(ahead), F.lit(0)).cast("long").alias(out))


def positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with each row's ``position`` (from 0) in the order of all rows, without sorting them in one task."""
    names = [f"_order{i}" for i in range(len(order))]
    dealt = df.withColumns(dict(zip(names, order, strict=True))).repartitionByRange(*names)
    dealt = cut(dealt.withColumn("_part", F.spark_partition_id()))
    ahead = running_totals(dealt.groupBy("_part").agg(F.count("*").alias("_n")), "_part", "_n", "_ahead")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*names)) - 1
    placed = dealt.withColumn("position", place.cast("long")).join(ahead, "_part")
    return placed.withColumn("position", F.col("position") + F.col("_ahead")).select(*df.columns, "position")


def small_join(large: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = 100_000) -> DataFrame:
    """Join with a table that is usually small: broadcast only if it is seen to hold at most ``rows`` rows.

    Beyond that the join is left to Spark's shuffle joins, whose skewed partitions AQE splits.
    """
    return large.join(F.broadcast(small) if small.limit(rows + 1).count() <= rows else small, on, how)


def numbered(items: DataFrame) -> DataFrame:
    """``items`` (a written table with ``key`` and ``place``) with ``number``: of rows with one key 0, 1, ...; of others 0.

    ``place`` is a ``monotonically_increasing_id``. Numbers run through a partition and then on to the next one, so a key of any size is never one window.
    """
    again = items.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    if again.isEmpty():
        return items.withColumn("number", F.lit(0).cast("long"))
    rows = small_join(items.select("key", "place"), again, ["key"], "left_semi").withColumn("part", F.shiftright("place", 33))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy("place")) - 1
    rows = rows.withColumn("inside", inside).join(parts, ["key", "part"]).select("place", (F.col("inside") + F.col("ahead")).alias("number"))
    return small_join(items, written(rows, "numbers"), ["place"], "left").withColumn("number", F.coalesce("number", F.lit(0)).cast("long"))
