"""Near-duplicate documents by SimHash fingerprints and Golay-code fuzzy hashing.

Two 64-bit fingerprints link at three or fewer differing bits. They are cut into three segments of 22,
21 and 21 bits, each read as a 23-bit word of the perfect (23, 12) Golay code, in which every word is
within three bits of exactly one codeword. For a word x, ``near(x)`` holds the codeword indices that x
and its one-bit neighbours decode to (one index if x is within two bits of its codeword, else a few
more); so words that differ in one bit at most always share: the index of one is in ``near`` of the other.

By the pigeonhole principle three errors over three segments leave one of two cases:

* every segment has one error at most: the three Golay indices make a 36-bit key;
* one segment has two or three: of the other two one is equal and one has one error at most: the equal
  segment's bits and the other's Golay index make a key of 33 or 34 bits, for each ordered pair.

One side of the join writes its keys with ``near`` for some segments and the other side for the rest.
Candidates meet in an equi-join whose condition counts the differing bits, so only true links leave it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.shared import written
from factloom.llm.wordbytes import chunks

SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and width
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_tables: dict[str, np.ndarray] = {}
#: The bits of each byte, highest first, as eight bytes in a 64-bit word.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)).view(np.uint64).copy()


def _fingerprints(column: pa.Array, shingle_words: int) -> np.ndarray:
    out = np.zeros(len(column), np.uint64)
    digest = xxhash.xxh64_intdigest
    for c in chunks(column, lower=True, chunk_bytes=1 << 20):
        # words moved together, one space between them and one after each row's last word
        length = c.end - c.start
        start = np.cumsum(length + 1) - length - 1
        packed = np.full(int((length + 1).sum()), 32, np.uint8)
        if len(length):
            where = np.repeat(start - c.start, length) + _ranges(c.start, length)
            packed[where] = c.data[_ranges(c.start, length)]
        raw, end = packed.tobytes(), start + length
        n = np.where(c.count == 0, 0, np.maximum(c.count - shingle_words + 1, 1))
        row = np.repeat(np.arange(len(n)), n)
        first = _ranges(c.at[:-1], n)
        last = np.minimum(first + shingle_words, c.at[1:][row]) - 1
        spans = zip(start[first].tolist(), end[last].tolist(), strict=True)
        hashes = np.array([digest(raw[a:b], SEED) for a, b in spans], np.uint64)
        out[c.first : c.first + len(n)] = fingerprint_of(hashes, n)
    return out


def fingerprint_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``sizes`` hashes; zero of an empty one."""
    out, has = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(has):
        ones = _bit_counts(hashes, sizes[has])
        out[has] = np.packbits(2 * ones > sizes[has][:, None], axis=1).view(">u8").ravel()
    return out


def _bit_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits (highest first) is set in each run of ``sizes`` hashes."""
    blocks = -(-sizes // 255)  # up to 255 bits are added up in each byte of a 64-bit word
    run_start, first = np.cumsum(sizes) - sizes, np.cumsum(blocks) - blocks
    start = _ranges(np.zeros(len(sizes), np.int64), blocks) * 255 + np.repeat(run_start, blocks)
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.empty((len(sizes), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat(_SPREAD[raw[:, k]], start).view(np.uint8).reshape(-1, 8)
        counts[:, 8 * k : 8 * k + 8] = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
    return counts


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each span, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp`` (the 64 bits as a signed long) of each row.

    Texts are lower-cased (A-Z only) and cut into word shingles, repeats included; fewer words make one
    shingle, and a text without words (or null) has fingerprint zero.
    """

    def run(batches):
        for batch in batches:
            fp = _fingerprints(batch.column(1), shingle_words)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def _syndromes(x: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word by the generator."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, _GENERATOR << (bit - 11), 0)
    return x


def golay_index(x: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    if "errors" not in _tables:
        patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in itertools.combinations(range(23), n)])
        errors = np.zeros(2048, np.int64)
        errors[_syndromes(patterns)] = patterns  # perfect: each remainder has one pattern of up to three bits
        _tables["errors"] = errors
    return (x ^ _tables["errors"][_syndromes(x)]) >> 11


def near(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in x, index) for each different index that x and its one-bit neighbours decode to."""
    flips = np.concatenate([[0], 1 << np.arange(width)])
    found = np.sort(golay_index((x[:, None] ^ flips).ravel()).reshape(len(x), -1), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, col = np.nonzero(new)
    return row, found[row, col]


def _keys(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Row, key and side of each key of some fingerprints; sides meet on equal keys."""
    parts = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    index = [golay_index(p) for p in parts]
    close = [near(p, w) for p, (_, w) in zip(parts, SEGMENTS, strict=True)]
    rows, keys, sides = [], [], []

    def add(row, key, kind, side):
        rows.append(row)
        keys.append(key | kind << 40)
        sides.append(np.full(len(row), side, np.int8))

    all_rows = np.arange(len(fp))
    # all three within one: side 0 spreads the first and second segment, side 1 the third
    a, b = close[0], close[1]
    n = np.bincount(b[0], minlength=len(fp))
    at = np.cumsum(n) - n
    row = np.repeat(a[0], n[a[0]])
    second = b[1][_ranges(at[a[0]], n[a[0]])]
    add(row, np.repeat(a[1], n[a[0]]) << 24 | second << 12 | index[2][row], 0, 0)
    row, third = close[2]
    add(row, index[0][row] << 24 | index[1][row] << 12 | third, 0, 1)
    for kind, (i, j) in enumerate(itertools.permutations(range(3), 2), 1):  # i equal, j within one
        row, other = close[j]
        add(row, parts[i][row] << 12 | other, kind, 0)
        add(all_rows, parts[i] << 12 | index[j], kind, 1)
    return rows, keys, sides


def fuzzy_keys(nodes: DataFrame) -> DataFrame:
    """``key``, ``side`` and ``fp`` for each Golay key of the fingerprints in ``fp``."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for some in np.array_split(fp, -(-len(fp) // 2000)) if len(fp) else []:
                rows, keys, sides = map(np.concatenate, _keys(some))
                yield pa.record_batch([pa.array(keys), pa.array(sides), pa.array(some[rows].view(np.int64))], ["key", "side", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, side byte, fp long")


def links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """``a`` < ``b``: each pair of different fingerprints that differ in ``max_bits`` (3 at most) or fewer bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys find up to 3 differing bits")
    keys = written(fuzzy_keys(nodes), "golay-keys")
    left = keys.where("side = 0").select("key", F.col("fp").alias("a"))
    right = keys.where("side = 1").select("key", F.col("fp").alias("b"))
    differing = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return left.join(right, (left.key == right.key) & (F.col("a") < F.col("b")) & (differing <= max_bits)).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, shingle_words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Of each row: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable over links) and ``links``.

    ``links`` counts the other fingerprints within ``max_bits``. Copies share one fingerprint and are never
    paired with each other; null ids can't name a component unless all its ids are null. An empty table
    gives an empty result; repeated rows give repeated rows; other columns are ignored.
    """
    prints = written(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    found = written(links(nodes, max_bits), "links")
    degree = found.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    member = components(found).withColumnRenamed("node", "fp")
    labelled = nodes.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = labelled.join(least, "root").select("fp", "component_id").join(degree, "fp", "left")
    return prints.join(classes, "fp").select(
        id_col,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )


def one_of_each(docs: DataFrame, shingle_words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, as ``first_of_each`` chooses it. Rows are unchanged."""
    return first_of_each(docs, lambda ids: near_duplicates(ids, shingle_words, max_bits, "_key", text_col), id_col, text_col)


def first_of_each(docs: DataFrame, find: Callable[[DataFrame], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the first row of each component that ``find`` tells (``component_id``) of rows of ``_key`` and text.

    The first is the one with the smallest id (null before all others), then the least hash of its text, then
    the least JSON of its other columns; so reruns choose alike, and rows that differ in nothing count once. The
    names of other columns don't matter.
    """
    text = F.col(text_col).cast("string")
    key = F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("p"))
    found = find(docs.select(key.alias("_key"), text.alias(text_col)))
    # as one text: a struct would be cast for the join, and rows then shuffled again for the groups
    plain = lambda k: F.concat_ws(":", k["known"].cast("string"), F.coalesce(k["id"].cast("string"), F.lit("")), k["p"].cast("string"))
    first = found.select(plain(F.col("component_id")).alias("k")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), plain(key).alias("k"))
    # rows of one key lie together after the join
    return rows.join(first, "k").groupBy("k").agg(F.min_by("row", F.to_json(_without(docs, text_col))).alias("row")).select("row.*")


def _without(docs: DataFrame, text_col: str) -> Column:
    """Of ``row`` all but its text, and whether that is null."""
    fields = [F.col("row")[c].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    return F.struct(F.col("row")[text_col].isNull().alias("empty"), *fields)
