"""Collocations: phrases that are frequent and cohere, by multikey quicksort of suffixes.

Every word begins a suffix of up to ``LONGEST`` words of its piece. Suffixes are routed by their two leading words,
and only where that pair is frequent: a fixed-size Bloom filter over the frequent pairs tells so without a table
of them on each worker, and what it lets through wrongly is counted and found rare. Pairs are counted likewise,
only of words that are frequent. Equal suffixes of a batch go as
one with a weight. A partition's suffixes are then sorted by three-way quicksort, one word after the other: rows
below the pivot, equal to it, and above it. The weight of an equal part is the count of the words up to there; any
part that weighs less than ``least`` is abandoned, as nothing in it can be frequent.

Suffixes under a hot pair are routed by three words, under a hot triple by four, and so on. What is shorter than the
words that a row was routed by lies in several partitions: its weights are added up; what is longer lies in one. So no
partition holds a hot pair whole, however common it is.

Words are 64-bit hashes of (lang, word) until candidates are known.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.shared import written
from factloom.llm.wordbytes import Chunk, chunks, mixed, span_hashes, strings

LONGEST = 5
HOTTEST = 1 << 16  # prefixes of each length that workers know by name
PARTITION_ROWS = 1 << 20
HELD = 1 << 19  # keys that a worker adds up before it hands them on
BLOOM_BITS = 1 << 25
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_NO_WORD = _BREAK.copy()
_NO_WORD[[32, 9]] = True
_U = np.uint64


def _seeds(langs: pa.Array) -> np.ndarray:
    """A 64-bit hash for each row's lang."""
    code = langs.dictionary_encode()
    raw = [np.frombuffer(x.encode(), np.uint8) for x in code.dictionary.to_pylist()]
    own = np.array([span_hashes(b.astype(_U) + _U(1), 0x9E3779B97F4A7C15, np.array([0]), np.array([len(b)]))[0] for b in raw], _U)
    return own[code.indices.to_numpy()] if len(raw) else np.zeros(0, _U)


def _words(batch: pa.RecordBatch) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray]]:
    """Of each chunk of (lang, text): its words, their hashes with their lang's, and how many words of the piece are left at each."""
    seeds = _seeds(batch.column(0))
    for c in chunks(batch.column(1), lower=True, separator=_NO_WORD):
        if not len(c.start):
            continue
        row = c.row_of_word()
        h = mixed(c.word_hashes() ^ seeds[c.first + row])
        h[h == 0] = 1  # 0 stands for no word
        piece = np.cumsum(_BREAK[c.data])[c.start]
        last = np.ones(len(row), bool)
        last[:-1] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
        ends = np.flatnonzero(last)
        yield c, h, np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(row)) + 1


def _joined(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(prefix * _U(0xD1342543DE82EF95) + word)


def _pairs(h: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two words of a piece follow each other, and the hash of each such pair."""
    at = np.flatnonzero(left > 1)
    return at, _joined(h[at], h[at + 1])


def _among(names: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes are among some sorted ones."""
    return names[np.minimum(np.searchsorted(names, h), len(names) - 1)] == h if len(names) else np.zeros(len(h), bool)


def _rows(keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``h`` and ``n`` of some keys, each once."""
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(which, np.concatenate(counts), len(key)).astype(np.int64)
    for i in range(0, len(key), 1 << 16):
        yield pa.record_batch([pa.array(key[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], ["h", "n"])


def _counted(docs: DataFrame, keys_of: Callable) -> DataFrame:
    """``h`` and ``n``: how often each key comes up that ``keys_of`` makes of hashed words and the words left of their piece."""

    def run(batches):
        keys, counts = [], []
        for batch in batches:
            for _, h, left in _words(batch):
                key, n = np.unique(keys_of(h, left), return_counts=True)
                keys.append(key)
                counts.append(n)
                if sum(map(len, keys)) > HELD:
                    yield from _rows(keys, counts)
                    keys, counts = [], []
        if keys:
            yield from _rows(keys, counts)

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _totals(docs: DataFrame) -> DataFrame:
    """``lang`` and ``n``, its words."""

    def run(batches):
        for batch in batches:
            n = np.zeros(len(batch), np.int64)
            for c in chunks(batch.column(1), separator=_NO_WORD):
                n[c.first : c.first + len(c.count)] = c.count
            yield pa.record_batch([batch.column(0), pa.array(n)], ["lang", "n"])

    return docs.mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def _prefix_keys(hot, length: int) -> Callable:
    """Keys of prefixes of ``length`` words whose first words are hot."""

    def keys(h: np.ndarray, left: np.ndarray) -> np.ndarray:
        at, prefix = _pairs(h, left)
        for i in range(2, length):
            keep = left[at] > i
            if i == length - 1:
                keep &= _among(hot.value, prefix)
            at = at[keep]
            prefix = _joined(prefix[keep], h[at + i])
        return prefix

    return keys


def _pair_keys(frequent) -> Callable:
    """Keys of pairs of two frequent words."""

    def keys(h: np.ndarray, left: np.ndarray) -> np.ndarray:
        at, pair = _pairs(h, left)
        known = _may_hold(frequent.value, h)
        return pair[known[at] & known[at + 1]]

    return keys


def _bits(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> _U(s)) % _U(BLOOM_BITS) for s in (0, 29)]


def _bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter over the hashes in ``h``: ``BLOOM_BITS`` bits, however many they are."""

    def run(batches):
        own = np.zeros(BLOOM_BITS // 64, _U)
        for batch in batches:
            for bit in _bits(batch.column(0).to_numpy().view(_U)):
                np.bitwise_or.at(own, (bit >> _U(6)).astype(np.int64), _U(1) << (bit & _U(63)))
        at = np.flatnonzero(own)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(own[at].view(np.int64))], ["at", "bits"])

    out = np.zeros(BLOOM_BITS // 64, _U)
    found = keys.select("h").mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(_U)
    return out


def _may_hold(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    first, second = _bits(h)
    held = lambda bit: (bloom[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) != 0
    return held(first) & held(second)


_SUFFIX = [f"w{i}" for i in range(LONGEST)]


def _hot(counts: DataFrame, most: int) -> np.ndarray:
    """Sorted hashes of the hottest prefixes: those that more than ``most`` suffixes have."""
    found = counts.where(F.col("n") > most).orderBy(F.desc("n"), "h").limit(HOTTEST).select("h").toArrow()
    return np.sort(found["h"].to_numpy().view(_U))


_SUFFIX = [f"w{i}" for i in range(LONGEST)]


def _hot(counts: DataFrame, most: int) -> np.ndarray:
    """Sorted hashes of the hottest prefixes: those that more than ``most`` suffixes have."""
    found = counts.where(F.col("n") > most).orderBy(F.desc("n"), "h").limit(HOTTEST).select("h").toArrow()
    return np.sort(found["h"].to_numpy().view(_U))


def _longer_counts(docs: DataFrame, hot, length: int) -> DataFrame:
    """``h`` and ``n``: occurrences of prefixes of ``length`` words whose first words are hot."""

    def run(batches):
        for batch in batches:
            for _, h, left in _words(batch):
                at, prefix = _pairs(h, left)
                for i in range(2, length):
                    keep = _among(hot.value, prefix) & (left[at] > i) if i == length - 1 else left[at] > i
                    at = at[keep]
                    prefix = _joined(prefix[keep], h[at + i])
                key, n = np.unique(prefix, return_counts=True)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


_SUFFIX = [f"w{i}" for i in range(LONGEST)]


def _suffixes(docs: DataFrame, bloom, hot) -> DataFrame:
    """``by``, w0.. (0 past its end) and ``n``: suffixes under a frequent pair, equal ones of a chunk as one.

    A suffix ends with its piece, or before the first pair that isn't frequent: no frequent phrase goes on from there.
    ``hot`` has hashes of pairs, of triples and so on; ``by`` tells how many words the suffix is routed by.
    """

    def told(w: np.ndarray) -> pa.RecordBatch:
        w = w[np.lexsort(w.T[::-1])]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        w, n, by = w[first], np.diff(first, append=len(new)), np.full(len(first), 2, np.int8)
        prefix = _joined(w[:, 0], w[:, 1])
        for i, names in enumerate(hot.value, 2):
            parted = (by == i) & _among(names, prefix)
            prefix[parted] = _joined(prefix[parted], w[parted, i])
            by[parted] += 1
        return pa.record_batch([pa.array(by), *(pa.array(x.view(np.int64)) for x in w.T.copy()), pa.array(n)], ["by", *_SUFFIX, "n"])

    def run(batches):
        for batch in batches:
            for _, h, left in _words(batch):
                at, pair = _pairs(h, left)
                goes_on = np.zeros(len(h) + LONGEST, bool)
                goes_on[at] = _may_hold(bloom.value, pair)
                at = np.flatnonzero(goes_on)
                if not len(at):
                    continue
                padded, open_ = np.concatenate([h, np.zeros(LONGEST, _U)]), np.ones(len(at), bool)
                w = np.zeros((len(at), LONGEST), _U)
                w[:, 0] = h[at]
                for i in range(1, LONGEST):
                    open_ = open_ & goes_on[at + i - 1]
                    w[open_, i] = padded[at[open_] + i]
                yield told(w)

    return docs.mapInArrow(run, f"by byte, {', '.join(f'{w} long' for w in _SUFFIX)}, n long")


def _route() -> Column:
    """A hash of as many words as ``by`` says."""
    words = [F.col(w) for w in _SUFFIX]
    route = F.xxhash64(*words[:2])
    for i in range(3, LONGEST + 1):
        route = F.when(F.col("by") == i, F.xxhash64(*words[:i])).otherwise(route)
    return route


def frequent_prefixes(words: np.ndarray, weight: np.ndarray, least: int, by: int = 2) -> Iterator[tuple[int, int, int]]:
    """(row, length, count) of each prefix of two or more words that weighs ``least`` or more; ``row`` is one that has it.

    Multikey three-way quicksort of row pointers: ``words`` has a column for each depth, 0 where a row has ended.
    Prefixes of fewer than ``by`` words come out whatever they weigh, as there may be more of them elsewhere.
    """
    todo = [(np.arange(len(words)), 0)]
    while todo:
        rows, depth = todo.pop()
        limit = least if depth + 1 >= by else 1
        if not len(rows) or weight[rows].sum() < limit:
            continue  # abandoned: no prefix in it weighs enough
        value = words[rows, depth]
        pivot = value[len(value) // 2]
        equal = rows[value == pivot]
        todo += [(rows[value < pivot], depth), (rows[value > pivot], depth)]
        count = int(weight[equal].sum())
        if pivot and count >= limit:
            if depth:
                yield int(equal[0]), depth + 1, count
            if depth + 1 < words.shape[1]:
                todo.append((equal, depth + 1))


def _prefixes(suffixes: DataFrame, least: int) -> DataFrame:
    """``w`` (2 to 5 words) and ``a``: counts of the partition's frequent phrases, and of all that lie in more than one."""

    def run(batches):
        kept = [b for b in batches if len(b)]
        if not kept:
            return
        table = pa.Table.from_batches(kept)
        words = np.stack([table[w].to_numpy() for w in _SUFFIX], axis=1)
        routed, weight = table["by"].to_numpy(), table["n"].to_numpy()
        for by in np.unique(routed):
            w, n, out = words[routed == by], weight[routed == by], []
            for found in frequent_prefixes(w, n, least, int(by)):
                out.append(found)
                if len(out) == 100_000:
                    yield rows(w, out)
                    out = []
            yield rows(w, out)

    def rows(w: np.ndarray, found: list) -> pa.RecordBatch:
        phrase = pa.array([w[row, :length].tolist() for row, length, _ in found], pa.list_(pa.int64()))
        return pa.record_batch([phrase, pa.array([n for *_, n in found], pa.int64())], ["w", "a"])

    return suffixes.select("by", *_SUFFIX, "n").mapInArrow(run, "w array<long>, a long")


def _names(docs: DataFrame, bloom) -> DataFrame:
    """``h``, ``lang`` and ``word`` of the words in a Bloom filter (and a few more): once for each task."""

    def run(batches):
        known = np.zeros(0, _U)
        for batch in batches:
            for c, h, _ in _words(batch):
                h, at = np.unique(h, return_index=True)
                new = ~np.isin(h, known) & _may_hold(bloom.value, h)
                h, at = h[new], at[new]
                known = np.concatenate([known, h])
                lang = batch.column(0).take(pa.array(c.first + c.row_of_word()[at]))
                yield pa.record_batch([pa.array(h.view(np.int64)), lang, strings(c.data, c.start[at], c.end[at])], ["h", "lang", "word"])

    return docs.mapInArrow(run, "h long, lang string, word string").groupBy("h").agg(F.min("lang").alias("lang"), F.min("word").alias("word"))


def collocations(
    docs: DataFrame, least: int = 100, best: int = 2000, text_col: str = "text", lang_col: str = "lang", partition_rows: int = PARTITION_ROWS
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``: each lang's ``best`` phrases.

    Texts (null: empty) are lower-cased (A-Z only) and cut at ``[.,;:!?\\n-\\r]`` into pieces, those at spaces and
    tabs into words; a null lang is ``und``. A phrase of two to five words is a candidate from ``least`` occurrences;
    its score is the lowest of floor(1000 a n / (l r)) over its cuts in two, ties to the earliest cut. Candidates that
    a longer one has as often are dropped. An empty table gives no rows; repeated rows count each; other columns are
    ignored; equal scores go by count and then by phrase.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    totals = written(_totals(texts), "words-per-lang")
    words = written(_counted(texts, lambda h, _: h).where(F.col("n") >= least).select("h", F.col("n").alias("f")), "frequent-words")
    frequent = spark.sparkContext.broadcast(_bloom(words))
    pairs = written(_counted(texts, _pair_keys(frequent)).where(F.col("n") >= least), "frequent-pairs")

    hot = [_hot(pairs, partition_rows)]
    while len(hot[-1]) and len(hot) < LONGEST - 2:  # by all words but the last at most
        hot.append(_hot(_counted(texts, _prefix_keys(spark.sparkContext.broadcast(hot[-1]), len(hot) + 2)), partition_rows))
    known = spark.sparkContext.broadcast(hot)
    bloom = spark.sparkContext.broadcast(_bloom(pairs))
    rows = pairs.agg(F.sum("n")).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / partition_rows))
    routed = _suffixes(texts, bloom, known).repartition(partitions, _route())
    found = _prefixes(routed, least).groupBy("w").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    found = written(found, "phrases")

    # the same count in a longer phrase is the same count in one that is a single word longer
    longer = found.where(F.size("w") > 2).select(
        F.explode(F.array(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1))).alias("w"), F.col("a").alias("of")
    )
    whole = found.join(longer.groupBy("w").agg(F.max("of").alias("of")), "w", "left").where("of is null or of < a").drop("of")
    whole = written(whole, "whole-phrases")

    part = found.unionByName(words.select(F.array("h").alias("w"), F.col("f").alias("a")))
    cuts = whole.select("w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("w", F.lit(1), F.col("k")), "right": F.expr("slice(w, k + 1, size(w) - k)")})
    cuts = cuts.join(part.select(F.col("w").alias("left"), F.col("a").alias("l")), "left").join(part.select(F.col("w").alias("right"), F.col("a").alias("r")), "right")

    said = written(whole.select(F.explode("w").alias("h")).distinct(), "said")
    spelt = written(_names(texts, spark.sparkContext.broadcast(_bloom(said))).join(said, "h"), "words")
    first = spelt.select(F.col("h").alias("_first"), "lang").join(totals, "lang")
    scored = cuts.withColumn("_first", F.col("w")[0]).join(first, "_first")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    times = (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    scored = scored.withColumns({"_over": times.cast("decimal(38,0)"), "_under": (wide("l") * wide("r")).cast("decimal(38,0)")})
    scored = scored.withColumn("score", F.expr("_over div _under"))
    lowest = scored.groupBy("w", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    placed = lowest.select("w", F.posexplode("w").alias("place", "h")).join(spelt.select("h", "word"), "h")
    phrases = placed.groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = lowest.join(phrases, "w").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    out = out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= best)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
