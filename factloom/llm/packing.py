"""Conflict-constrained best-fit packing of documents into sequences of a fixed length.

Texts longer than a sequence are cut into whole sequences and a rest. Pieces are dealt into groups of
bounded size by a hash of their id and, where rows are equal, their number, so a source or a cluster of copies of any size is spread over all
groups, and every group packs its pieces from the largest down. Its open bins lie in order of their room
left, each with a bitmap of the sources and one of the duplicate clusters it holds. The search starts at
the tightest bin with enough room and goes on to the next larger until one has neither the piece's source
nor its cluster; if none has, a bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.mixing import word_count
from factloom.llm.shared import SEPARATORS, numbered, written

GROUP_ROWS = 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; pieces come in the order they are placed. Null sources and clusters don't conflict."""
    bit: dict = {}

    def mask(kind: str, value) -> int:
        return 0 if value is None else 1 << bit.setdefault((kind, value), len(bit))

    rooms: list[tuple[int, int]] = []  # (room left, bin), ascending
    held: list[int] = []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        own = mask("source", source) | mask("cluster", cluster)
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms) and held[rooms[at][1]] & own:
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(held)
            held.append(0)
        held[b] |= own
        bins.append(b)
        offsets.append(capacity - room)
        if room > size:
            insort(rooms, (room - size, b))
    return bins, offsets


def copy_cluster(text: Column) -> Column:
    """Equal for texts that are equal in their lower-cased words; null for texts without any."""
    plain = F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " "))
    return F.when(plain != "", F.xxhash64(plain))


def pack(items: DataFrame, capacity: int = 2048, distinct_sources: bool = True, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id``, ``piece``, ``first`` (its first word), ``size``, ``source``, ``bin_id`` and ``bin_offset``.

    ``items`` has doc_id, size, source and cluster. No bin holds more than ``capacity``, two pieces of one
    cluster or, with ``distinct_sources``, of one source; null sources and clusters don't conflict. Pieces
    of one document have its cluster and so lie in different bins. Items of size zero, negative or null
    have nothing to pack and come out with one piece and no bin. Repeated rows are packed apart.
    """
    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long")
    rows = items.select("doc_id", size.alias("total"), F.col("source").cast("string").alias("source"), "cluster")
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "total", F.col("source").isNull(), "source", F.col("cluster").isNull(), "cluster")
    rows = numbered(written(rows.withColumns({"key": key, "place": F.monotonically_increasing_id()}), "pack-items")).drop("key", "place")
    last = F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0)).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("first", F.col("piece").cast("long") * capacity)
    pieces = pieces.withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("first")))
    n = rows.agg(F.sum(last + 1)).first()[0] or 0
    groups = max(1, -(-n // group_rows))
    pieces = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "total", "number"), F.lit(groups)))

    kind = items.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, first long, size long, source string, bin_id string, bin_offset long"

    def run(group: pa.Table) -> pa.Table:
        order = [("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("source", "ascending"), ("cluster", "ascending")]
        group = group.sort_by(order)
        sizes = group["size"].to_pylist()
        full = sum(n > 0 for n in sizes)  # the empty ones come last
        sources = group["source"].to_pylist() if distinct_sources else [None] * full
        bins, offsets = best_fit(sizes[:full], sources[:full], group["cluster"].to_pylist()[:full], capacity)
        number, none = group["g"][0].as_py(), [None] * (len(sizes) - full)
        out = group.select(["doc_id", "piece", "first", "size", "source"])
        out = out.append_column("bin_id", pa.array([f"{number}-{b}" for b in bins] + none, pa.string()))
        return out.append_column("bin_offset", pa.array(offsets + none, pa.int64()))

    return pieces.drop("total", "number").groupBy("g").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = 2048, distinct_sources: bool = True) -> DataFrame:
    """``pack`` for whole ``docs`` (doc_id, text, source): sizes are words, clusters are texts with equal words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = docs.select("doc_id", "source", word_count(text).alias("size"), copy_cluster(text).alias("cluster"))
    return pack(items, capacity, distinct_sources)
