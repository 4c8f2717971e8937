"""How far sources of one language diverge from each other and from the language, over a transducer's vocabulary.

Each language keeps the terms that enough of its documents hold. The kept terms are dealt by range, and each run of
them, in order, is built into a minimal acyclic transducer: states that accept the same endings are one, and every
transition carries how many terms come before it, so a term's outputs add up to its place in the order. Whole texts
then stream through the transducers, all words of a chunk one byte at a time, and are counted under these ordinals;
strings are no longer compared. As ordinals follow the order of UTF-8 bytes, they also break ties.

A transducer holds ``BLOCK_TERMS`` terms at most, and texts stream through as many at once as ``PASS_BYTES`` allows,
again for the next ones; so what a worker holds doesn't grow with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.shared import cut, written
from factloom.llm.wordbytes import chunks, strings

BLOCK_TERMS = 1 << 18
PASS_BYTES = 64 << 20
BILLION = 1_000_000_000
_OTHER = np.ones(256, bool)
_OTHER[65:91] = _OTHER[97:123] = _OTHER[128:] = False


@dataclass
class Transducer:
    """Transitions in the order of ``key`` (state * 256 + byte) with their targets and outputs; states that end a term."""

    key: np.ndarray
    target: np.ndarray
    output: np.ndarray
    ends: np.ndarray
    root: int

    @classmethod
    def of(cls, terms: Iterable[bytes]) -> Transducer:
        """The minimal transducer of different terms in ascending order."""
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # of the last term: whether a term ends there, and finished transitions
        last = b""

        def finish(depth: int) -> None:
            while len(path) > depth + 1:
                ends, moves = path.pop()
                state = known.setdefault((ends, *moves), len(known))
                path[-1][1].append((last[len(path) - 1], state))

        for term in terms:
            depth = 0
            while depth < len(last) and depth < len(term) and last[depth] == term[depth]:
                depth += 1
            finish(depth)
            path += [[False, []] for _ in range(len(term) - depth)]
            path[-1][0], last = True, term
        finish(0)
        root = known.setdefault((path[0][0], *path[0][1]), len(known))
        reach, key, target, output = [], [], [], []
        for state, (ends, *moves) in enumerate(known):  # targets come before their sources
            before = int(ends)
            for byte, to in moves:
                key.append(state << 8 | byte)
                target.append(to)
                output.append(before)
                before += reach[to]
            reach.append(before)
        return cls(np.array(key, np.int64), np.array(target, np.int32), np.array(output, np.int32), np.array([e for e, *_ in known], bool), root)

    def ordinals(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the spans are terms, and their ordinals."""
        alive, at = np.arange(len(start)), start.copy()
        state, total = np.full(len(start), self.root, np.int64), np.zeros(len(start), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(alive) and len(self.key):
            key = state << 8 | data[at]
            place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[place] == key
            alive, place, at = alive[hit], place[hit], at[hit] + 1
            state, total = self.target[place].astype(np.int64), total[hit] + self.output[place]
            done = at == end[alive]
            if done.any():
                whole = done & self.ends[state]
                found.append((alive[whole], total[whole]))
                alive, state, total, at = (x[~done] for x in (alive, state, total, at))
        return (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))

    def size(self) -> int:
        return sum(x.nbytes for x in (self.key, self.target, self.output, self.ends))


def _read(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    filled = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    return docs.select(filled(text_col, "text"), filled(lang_col, "lang"), filled(source_col, "source"))


def _document_counts(texts: DataFrame) -> DataFrame:
    """``lang``, ``term`` and ``docs``, in how many documents it occurs."""

    def run(batches):
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            code, held = langs.indices.to_numpy().astype(np.int64), []
            for c in chunks(batch.column(0), lower=True, separator=_OTHER):
                if not len(c.start):
                    continue
                row, h = c.row_of_word(), c.word_hashes()
                order = np.lexsort((h, row))
                first = np.ones(len(h), bool)
                first[1:] = (np.diff(row[order]) != 0) | (np.diff(h[order]) != 0)
                one = order[first]  # a word of each document
                lang, h = code[c.first + row[one]], h[one]
                order = np.lexsort((h, lang))
                first = np.ones(len(h), bool)
                first[1:] = (np.diff(lang[order]) != 0) | (np.diff(h[order]) != 0)
                begins = np.flatnonzero(first)
                word = one[order[begins]]
                terms = strings(c.data, c.start[word], c.end[word])
                held.append(pa.table({"lang": pa.array(lang[order[begins]]), "term": terms, "docs": np.diff(begins, append=len(h))}))
            if held:
                table = pa.concat_tables(held).group_by(["lang", "term"]).aggregate([("docs", "sum")]).combine_chunks()
                for b in table.to_batches(max_chunksize=50_000):
                    yield pa.record_batch([langs.dictionary.take(b.column("lang")), b.column("term"), b.column("docs_sum")], ["lang", "term", "docs"])

    return texts.select("text", "lang").mapInArrow(run, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def _blocks(terms: DataFrame) -> DataFrame:
    """``lang``, ``block``, ``n`` and the transducer's columns for each block of sorted rows of (lang, block, term)."""
    wide = "key array<long>, target array<int>, output array<int>, ends array<boolean>, root int"

    def built(lang: str, block: int, own: list[bytes]) -> pa.RecordBatch:
        t = Transducer.of(own)
        columns = [pa.array([x]) for x in (lang, block, len(own), t.key, t.target, t.output, t.ends.tolist(), t.root)]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.int32()]
        return pa.record_batch([c.cast(k) for c, k in zip(columns, kinds, strict=True)], ["lang", "block", "n", "key", "target", "output", "ends", "root"])

    def run(batches):
        now, own = None, []
        for batch in batches:
            for lang, block, term in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (lang, block) != now:
                    if own:
                        yield built(*now, own)
                    now, own = (lang, block), []
                own.append(term.encode())
        if own:
            yield built(*now, own)

    return terms.select("lang", "block", "term").mapInArrow(run, f"lang string, block long, n long, {wide}")


def _passes(blocks: DataFrame) -> Iterator[list[tuple[str, int, Transducer]]]:
    """Transducers with their lang and first ordinal, as many at a time as ``PASS_BYTES`` allows."""
    sizes = blocks.groupBy("block").agg(F.sum(F.size("key") * 16 + F.size("ends")).alias("bytes")).orderBy("block").collect()
    based, first, total = _based(blocks), 0, 0
    for i, row in enumerate(sizes):  # a row for BLOCK_TERMS kept terms
        total += row["bytes"]
        if i + 1 == len(sizes) or total + sizes[i + 1]["bytes"] > PASS_BYTES:
            some = based.where(F.col("block").between(sizes[first]["block"], row["block"])).toArrow().to_pylist()
            yield [(r["lang"], r["base"], Transducer(*(np.array(r[c], kind) for c, kind in _COLUMNS), r["root"])) for r in some]
            first, total = i + 1, 0


def _based(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``base``, how many terms of the lang lie in earlier ones."""
    ahead = Window.partitionBy("lang").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("lang", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    return blocks.join(bases, ["lang", "block"])


_COLUMNS = (("key", np.int64), ("target", np.int32), ("output", np.int32), ("ends", bool))


def _recount(texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``ordinal`` and ``n``: occurrences of kept terms, by streaming all texts through the transducers."""
    spark, counts = texts.sparkSession, []
    for transducers in _passes(blocks):
        held = spark.sparkContext.broadcast(transducers)

        def run(batches, held=held):
            for batch in batches:
                groups = pa.table({"lang": batch.column(1), "source": batch.column(2), "row": np.arange(len(batch))})
                heads = groups.group_by(["lang", "source"]).aggregate([("row", "list")])
                group = np.zeros(len(batch), np.int64)
                for g, rows in enumerate(heads["row_list"].to_pylist()):
                    group[rows] = g
                of_lang = heads["lang"].to_pylist()
                found: list[np.ndarray] = []
                for c in chunks(batch.column(0), lower=True, separator=_OTHER):
                    g = group[c.first + c.row_of_word()]
                    words_of = {x: np.flatnonzero(np.isin(g, [i for i, y in enumerate(of_lang) if y == x])) for x in set(of_lang)}
                    for lang, base, transducer in held.value:
                        if len(words := words_of.get(lang, ())):
                            at, ordinal = transducer.ordinals(c.data, c.start[words], c.end[words])
                            found.append(np.stack(np.unique(g[words[at]] << 40 | base + ordinal, return_counts=True)))
                if found:
                    key, which = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                    n = np.bincount(which, np.concatenate([f[1] for f in found]), len(key)).astype(np.int64)
                    head = pa.array(key >> 40)
                    columns = [heads["lang"].combine_chunks().take(head), heads["source"].combine_chunks().take(head), pa.array(key & ((1 << 40) - 1)), pa.array(n)]
                    yield pa.record_batch(columns, ["lang", "source", "ordinal", "n"])

        some = texts.mapInArrow(run, "lang string, source string, ordinal long, n long")
        counts.append(written(some.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "recount"))
        held.unpersist()
    out = spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    for some in counts:
        out = out.unionByName(some)
    return out


def _share(n: Column) -> Column:
    """1 + floor(1e9 (n + 5) / (whole + 5 V)), exactly."""
    over = (n + 5).cast("decimal(19,0)") * F.lit(BILLION).cast("decimal(10,0)")
    under = F.col("whole").cast("decimal(19,0)") + F.col("V").cast("decimal(18,0)") * F.lit(5).cast("decimal(1,0)")
    return 1 + F.call_function("div", over, under)


def _distances(key: tuple, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums of absolute differences between all groups of a lang over one span of ordinals."""
    n, own = len(groups), groups.sort_values("g")
    p = np.repeat(own["p0"].to_numpy(np.int64)[:, None], int(own["terms"].iloc[0]), axis=1)
    p[cells["g"].to_numpy(), cells["at"].to_numpy()] = cells["p"].to_numpy(np.int64)
    sums = np.concatenate([np.abs(p - row).sum(axis=1) for row in p])
    return pd.DataFrame({"lang": key[0], "g": np.repeat(np.arange(n), n), "h": np.tile(np.arange(n), n), "f": sums})


def divergence(
    docs: DataFrame, least_docs: int = 30, most: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    Terms are runs of A-Z, a-z (taken as one) and characters beyond ASCII; a lang keeps those of ``least_docs`` of its
    documents. With N occurrences of V kept terms a group's share of a term is 1 + floor(1e9 (count + 5) / (N + 5 V)).
    Part ``pair``: for each (lang, source) each other source of the lang, and the sum of absolute differences of their
    shares. Part ``term``: the ``most`` terms that the group has and holds a larger share of than its lang, by the difference.

    Null texts, langs and sources count as ''; groups without terms have shares too, and differ by 0 where V is 0. An
    empty table gives no rows; repeated rows count each; other columns are ignored; equal values go by the item's bytes.
    """
    texts = _read(docs, text_col, lang_col, source_col)
    kept = written(_document_counts(texts).where(F.col("docs") >= least_docs).select("lang", "term"), "kept-terms")
    dealt = kept.repartitionByRange(max(1, -(-kept.count() // BLOCK_TERMS)), "lang", "term").sortWithinPartitions("lang", "term")
    dealt = written(dealt.withColumn("block", F.spark_partition_id().cast("long")), "terms")
    ordered = dealt.repartition("block").sortWithinPartitions("block", "lang", "term")
    blocks = written(_blocks(ordered), "transducers")
    counts = written(_recount(texts, blocks), "counts")

    # shares of every group: of the terms it has, and of all others alike
    sizes = blocks.groupBy("lang").agg(F.sum("n").alias("V"))
    wholes = counts.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    groups = texts.select("lang", "source").distinct().join(wholes, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["whole", "V"])
    groups = groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.withColumn("p0", F.when(F.col("V") > 0, _share(F.lit(0))))
    groups = cut(groups.withColumn("groups", F.count("*").over(Window.partitionBy("lang"))))
    shares = written(counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"))), "shares")

    # pairs: spans of ordinals whose matrix of groups and terms is bounded
    span = F.greatest(F.lit(64), F.least(F.lit(8192), F.floor(F.lit(1 << 22) / F.col("groups")))).cast("long")
    cells = shares.select("lang", F.floor(F.col("ordinal") / span).cast("long").alias("span"), "g", (F.col("ordinal") % span).cast("int").alias("at"), "p")
    own = groups.where("V > 0").withColumn("_span", span).withColumn("span", F.explode(F.expr("sequence(0L, (V - 1) div _span)")))
    own = own.select("lang", "span", "g", "p0", F.least(F.col("_span"), F.col("V") - F.col("span") * F.col("_span")).alias("terms"))
    met = cells.groupBy("lang", "span").cogroup(own.groupBy("lang", "span")).applyInPandas(_distances, "lang string, g int, h int, f long")
    sums = met.groupBy("lang", "g", "h").agg(F.sum("f").alias("f"))
    name = groups.select("lang", "g", "source")
    other = name.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    pairs = name.join(other, "lang").where("g <> h").join(sums, ["lang", "g", "h"], "left")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0)).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))

    # terms: the lang's own shares
    lang_counts = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n"))
    lang_wholes = counts.groupBy("lang").agg(F.sum("n").alias("whole")).join(sizes, "lang")
    lang_shares = lang_counts.join(lang_wholes, "lang").select("lang", "ordinal", _share(F.col("n")).alias("q"))
    above = shares.join(lang_shares, ["lang", "ordinal"]).where("p > q").select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value"))
    by_ordinal = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    top = above.withColumn("rank", F.row_number().over(by_ordinal)).where(F.col("rank") <= most)
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
    spelt = dealt.withColumn("place", place).join(_based(blocks).select("lang", "block", "base"), ["lang", "block"]).select("lang", "term", (F.col("base") + F.col("place")).alias("ordinal"))
    terms = top.join(spelt, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)
