"""SimHash near-dedup for a similarity of word shingles: pairs at 4/5 or more are linked, and none below.

First, each set of shingles has a SimHash fingerprint; fingerprints are joined on their Golay keys as in
``simhash``, and each document of a component is compared with its smallest one. Sets at 4/5 differ in ten of
64 bits on average, and keys for that many bits would be shared by nearly all fingerprints. So this finds most
groups of copies, but a join on fingerprints alone can't find all pairs.

A second set of keys finds the rest: ``BANDS`` keys a document, each of the least of its shingles in ``ROWS``
orders. Two sets meet in a key with the probability similarity**6, so a pair at 4/5 is missed once in about
5,000, while documents that share no more than a passage seldom meet. Each document is first compared with the
one of its keys that most others share, which stands in the middle of a group of copies: one pair a document.

Then every key whose documents still lie in different components is gone through whole, whatever its size: its sets
meet in one task, where the postings of their shingles give what each two share, and no pair of them becomes a row.
A key of more than ``BLOCK`` shingles is cut into blocks, each two of which meet. So any two documents that share a
key are compared, unless they are connected already.

Keys only propose. Every link is counted over the whole sets. Documents with equal sets are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.shared import listed, remove, small_join, written
from factloom.llm.simhash import _ranges, fingerprint_of, first_of_each, links
from factloom.llm.wordbytes import Chunk, chunks, mixed, word_span_hashes

BANDS, ROWS = 28, 6
BLOCK = 1 << 20  # shingles of a key's block; a single set may be larger
PARTITION = 4 << 20  # shingles of a partition
CHUNK_BYTES = 1 << 19  # of texts whose sets are in a worker's memory at once
#: Odd multipliers, one for each order of the shingles.
_ORDERS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _sets(c: Chunk, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each different shingle of each row, in order; fewer words than a shingle's make one."""
    n = np.where(c.count == 0, 0, np.maximum(c.count - shingle_words + 1, 1))
    row, first = np.repeat(np.arange(len(n)), n), _ranges(c.at[:-1], n)
    last = np.minimum(first + shingle_words, c.at[1:][row])
    h = word_span_hashes(c.word_hashes(), first, last)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _chunks(batch: pa.RecordBatch, shingle_words: int):
    """Keys, hashes, set sizes and nodes of some rows of (key, text)."""
    for c in chunks(batch.column(1), lower=True, chunk_bytes=CHUNK_BYTES):
        row, h = _sets(c, shingle_words)
        n = np.bincount(row, minlength=len(c.count)).astype(np.int32)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h), dtype=np.uint64)])
        ends = np.cumsum(n)
        node = mixed(sums[ends] - sums[ends - n] + n.astype(np.uint64))
        yield batch.column(0).slice(c.first, len(c.count)), h, n, node


def _bands(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each set of ``n`` hashes, and how many it has: ``BANDS``, or none if it is empty."""
    has = n > 0
    starts = (np.cumsum(n) - n)[has]
    out = np.zeros((int(has.sum()), BANDS), np.uint64)
    if len(starts):
        for i, order in enumerate(_ORDERS):
            band = i // ROWS
            out[:, band] = mixed(out[:, band] + np.minimum.reduceat(h * order, starts) + np.uint64(band))
    return out.ravel(), np.where(has, BANDS, 0)


def _prints(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``key``, ``node``, ``n`` (its shingles), ``fp`` and ``bands`` of each row of (key, text)."""

    def run(batches):
        for batch in batches:
            for key, h, n, node in _chunks(batch, shingle_words):
                fp = fingerprint_of(h, n.astype(np.int64))
                columns = [key, pa.array(node.view(np.int64)), pa.array(n), pa.array(fp.view(np.int64)), _lists(*_bands(h, n))]
                yield pa.record_batch(columns, ["key", "node", "n", "fp", "bands"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, node long, n int, fp long, bands array<long>")


def _whole_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``node`` and ``s``, its shingles' hashes."""

    def run(batches):
        for batch in batches:
            for _, h, n, node in _chunks(batch, shingle_words):
                yield pa.record_batch([pa.array(node.view(np.int64)), _lists(h, n)], ["node", "s"])

    return docs.mapInArrow(run, "node long, s array<long>")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b``: the pairs of nodes that share 4/5 of their union, counted over their whole sets."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("t")), "b").join(sets.withColumnRenamed("node", "a"), "a")
    return both.where(9 * F.size(F.array_intersect("s", "t")) >= 4 * (F.size("s") + F.size("t"))).select("a", "b")


def _cross_links(batches):
    """``a``, ``b``: links between components, of rows of (h, low, high, block, node, root, s) in the order of their first three.

    Rows of equal (h, low, high) are a group; if low < high only rows of different blocks are compared. Of the links
    that would join two components of a group one comes out.
    """
    held: list[pa.RecordBatch] = []

    def told(table: pa.Table):
        keys = np.stack([table[i].to_numpy() for i in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        block, node, root = (table[i].to_numpy() for i in (3, 4, 5))
        s = table[6].combine_chunks()
        offsets, values = s.offsets.to_numpy(), s.values.to_numpy()
        pairs = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                apart = block[a:b] if keys[a, 1] < keys[a, 2] else None
                pairs += _group_links(node[a:b], root[a:b], apart, np.diff(offsets[a : b + 1]), values[offsets[a] : offsets[b]])
        return pa.record_batch([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        new = np.flatnonzero((keys != keys[-1]).any(axis=1))
        last = int(new[-1]) + 1 if len(new) else 0  # where the batch's last group begins
        if last or (held and any(held[-1].column(i)[0].as_py() != keys[0, i] for i in range(3))):
            yield told(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield told(pa.Table.from_batches(held))


def _group_links(node: np.ndarray, root: np.ndarray, apart: np.ndarray | None, n: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components of some sets of ``n`` values each, one for each two joined. ``apart``: only between different blocks."""
    of: dict[int, int] = {}

    def least(r: int) -> int:
        while (up := of.get(r, r)) != r:
            r = up
        return r

    doc = np.repeat(np.arange(len(n)), n)
    order = np.argsort(values, kind="stable")
    new = np.ones(len(values), bool)
    new[1:] = values[order][1:] != values[order][:-1]
    start = np.flatnonzero(new)
    size, posting = np.diff(start, append=len(values)), doc[order]
    shingle = np.empty(len(values), np.int64)
    shingle[order] = np.cumsum(new) - 1
    at, found = np.concatenate([[0], np.cumsum(n)]), []
    for i in range(len(n) - 1):
        own = shingle[at[i] : at[i + 1]]
        own = own[size[own] > 1]
        if not len(own):
            continue
        shared = np.bincount(posting[_ranges(start[own], size[own])], minlength=len(n))
        alike = (9 * shared >= 4 * (n[i] + n)) & (root != root[i])
        alike[: i + 1] = False
        if apart is not None:
            alike &= apart != apart[i]
        for j in np.flatnonzero(alike).tolist():
            a, b = least(int(root[i])), least(int(root[j]))
            if a != b:
                of[max(a, b)] = min(a, b)
                found.append((int(node[i]), int(node[j])))
    return found


def _alike(x: Column, y: Column) -> Column:
    """Sets of these sizes can share 4/5 of their union."""
    return 9 * F.least(x, y) >= 4 * (x + y)


def _proposed(nodes: DataFrame) -> DataFrame:
    """``a`` and ``b``: of each component of fingerprints within three bits its smallest node with each other one."""
    nodes = nodes.select("node", "fp")
    member = components(links(nodes.select("fp").distinct())).withColumnRenamed("node", "fp")
    placed = nodes.join(member, "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    centre = placed.groupBy("root").agg(F.min("node").alias("a"))
    return placed.join(centre, "root").where("node <> a").select("a", F.col("node").alias("b"))


def near_copies(docs: DataFrame, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: id and ``component_id``, the smallest id reachable over pairs with a similarity of 4/5 or more.

    Texts are lower-cased (A-Z only) and cut into word shingles, each counted once; texts without words are
    copies, null ones among them. Repeated rows give repeated rows; an empty table gives none; other columns
    are ignored.
    """
    tables: list[str] = []
    with listed(tables):
        found = _components(docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")), shingle_words, tables)
    return found.withColumnRenamed("key", id_col)


def _components(texts: DataFrame, shingle_words: int, tables: list[str]) -> DataFrame:
    """``near_copies`` of rows of (key, text). Of ``tables``, those are removed at once that nothing reads any more."""
    spark = texts.sparkSession
    done = lambda *labels: remove(spark, tables, *labels)
    prints = written(_prints(texts, shingle_words), "prints")
    nodes = prints.groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes")

    # of each node its keys' middle one: the one whose keys most others share
    keys = nodes.select("node", "n", F.explode("bands").alias("h"))
    shared = keys.join(keys.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "h")
    shared = written(shared, "shared-keys")
    middle = shared.groupBy("node").agg(F.sum("m").alias("weight"))
    several = written(shared.join(middle, "node").select("h", "node", "n", "weight"), "band-keys")
    centres = several.groupBy("h").agg(F.max(F.struct("weight", "node", "n")).alias("c"))
    stars = several.join(centres, "h").where((F.col("node") != F.col("c.node")) & _alike(F.col("n"), F.col("c.n")))
    stars = stars.groupBy("node").agg(F.max("c").alias("c")).select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"))

    # fingerprints and keys propose, whole sets decide; the texts of those asked for are read again
    proposed = written(_proposed(nodes).unionByName(stars).distinct(), "pairs")
    asked = proposed.select(F.explode(F.array("a", "b")).alias("node")).unionByName(several.select("node")).distinct()
    asked = small_join(nodes.select("node", "key"), asked, ["node"], "left_semi").select("key")
    sets = written(_whole_sets(small_join(texts, asked, ["key"], "left_semi"), shingle_words).dropDuplicates(["node"]), "shingle-sets")
    found = written(_linked(proposed, sets), "star-links")
    member = written(components(found), "star-members")
    done("golay-keys", "shared-keys", "pairs")

    # what a key still parts
    placed = several.select("h", "node", "n").join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "placed-keys")
    split = placed.groupBy("h").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    left = placed.join(split.where("_low < _high").select("h", "blocks"), "h").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = written(left.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))), "split-keys")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(left.agg(F.sum("n")).first()[0] or 0) // PARTITION))
    left = left.select("h", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root")
    meet = left.join(sets, "node").select(*left.columns, "s").repartition(partitions, "h", "low", "high").sortWithinPartitions("h", "low", "high")
    more = written(meet.mapInArrow(_cross_links, "a long, b long"), "links")
    done("band-keys", "placed-keys", "split-keys", "shingle-sets")

    root = components(found.unionByName(more))
    labelled = prints.select("key", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("key").alias("component_id"))
    return labelled.join(least, "root").select("key", "component_id")


def one_of_each(docs: DataFrame, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near copies, as ``first_of_each`` chooses it. Rows are unchanged."""
    return first_of_each(docs, lambda ids: near_copies(ids, shingle_words, "_key", text_col), id_col, text_col)
