"""Exact removal of repeated passages: seeds on winnowed anchors, extension both ways, maximal repeats.

A window is ``window`` consecutive words. Each word covered by a window that also starts earlier (smaller
id, or same document and earlier start) is removed; windows are judged on the input.

Seeds. Of the k-word grams that start in a window the one with the least hash (the rightmost of equal
ones) is its anchor, so equal windows have equal anchors at equal places, and a document has about one
anchor for eight words. Only anchors that occur again can lie in repeated windows.

Extension. An anchor's block is every window around it at once: up to ``window - k`` words before it and
``window`` from its start. Anchors are dealt out by hash and sorted by block and place. Where a whole
block occurred earlier, all its words go. Where an anchor occurs in one block only, its first occurrence is
new and nothing is left to ask. Only first occurrences of blocks whose anchor has several blocks (the
edges of passages, edits in near copies) are extended window by window, in the same way.

Adjacent repeated windows add up to maximal repeats, whose words are cut from the text. Occurrences that
repeat within one batch are settled there, so a passage in very many documents, or a third of all rows
being copies, sends a few rows for each batch to the task of its anchor. An anchor that stands in very many
different blocks (a notice or a stock phrase) is found in a bounded sample; it is known to have several
blocks, so these needn't meet and are dealt out each by itself. Which anchors those are only balances work.

Words are equal if their 64-bit hashes are; blocks and windows if two 64-bit hashes over those are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import written
from factloom.llm.wordbytes import Chunk, chunks, mixed, word_span_hashes

WINDOW, GRAM = 20, 6
HOT_SAMPLE, HOT_LEAST = 20_000, 8
MOST_HOT = 1 << 16  # anchors in many blocks that workers know
_INDEX = np.uint64((1 << 28) - 1)  # of words in a chunk
_SEEN = "route long, anchor long, block long, doc long, sub long, pos int, settled boolean"


def _winnow(c: Chunk, word_hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each window, the place of its anchor, and the hash of every gram (by its first word)."""
    n = len(word_hashes)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    i = np.arange(n - k + 1)
    grams = word_span_hashes(word_hashes, i, i + k)
    least = (mixed(grams) & ~_INDEX) | (_INDEX - i.astype(np.uint64))  # of equal ones the rightmost
    width, size = window - k + 1, 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < width:
        least = np.minimum(least[: len(least) - width + size], least[width - size :])
    start = np.flatnonzero(np.arange(n) + window <= np.repeat(c.at[1:], c.count))
    return start, (_INDEX - (least[start] & _INDEX)).astype(np.int64), grams


def _anchors(c: Chunk, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash and block hash of each anchor of a chunk."""
    h = c.word_hashes()
    _, at, grams = _winnow(c, h, window, k)
    at = np.unique(at)
    row = np.searchsorted(c.at, at, side="right") - 1
    a, b = np.maximum(at - (window - k), c.at[row]), np.minimum(at + window, c.at[row + 1])
    return at, grams[at], word_span_hashes(h, a, b) ^ mixed((at - a).astype(np.uint64))


def _first_here(one: np.ndarray, two: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Whether each row is the earliest of its (one, two), by place."""
    order = np.lexsort((*place[::-1], two, one))
    first = np.ones(len(one), bool)
    first[order[1:]] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    # rows at the same place as the first are that same document's
    run = np.maximum.accumulate(np.where(first[order], np.arange(len(one)), 0))
    same = np.ones(len(one), bool)
    for p in place:
        same &= p[order] == p[order][run]
    first[order] |= same
    return first


def _batch(one, two, doc, sub, pos, route) -> pa.RecordBatch:
    """Rows of _SEEN, dealt by ``route``. What has an earlier equal in this batch is settled and stays out of that task."""
    first = _first_here(one, two, doc, sub, pos)
    spread = mixed(doc.view(np.uint64) ^ mixed(pos.astype(np.uint64)))
    columns = [np.where(first, route, spread).view(np.int64), one.view(np.int64), two.view(np.int64), doc, sub, pos.astype(np.int32), ~first]
    return pa.record_batch([pa.array(x) for x in columns], ["route", "anchor", "block", "doc", "sub", "pos", "settled"])


def _hot_anchors(keyed: DataFrame, window: int, k: int, sample: int, least: int) -> np.ndarray:
    """Sorted: anchors with two blocks or more that occur ``least`` times in about ``sample`` rows; ``MOST_HOT`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(0)):
                _, anchor, block = _anchors(c, window, k)
                yield pa.record_batch([pa.array(x.view(np.int64)) for x in (anchor, block)], ["anchor", "block"])

    n = keyed.count()
    some = keyed.select("text").sample(min(1.0, sample / n), seed=7) if n else keyed.select("text")
    per = some.mapInArrow(run, "anchor long, block long").groupBy("anchor")
    hot = per.agg(F.count("*").alias("n"), F.min("block").alias("low"), F.max("block").alias("high")).where((F.col("n") >= least) & (F.col("low") < F.col("high")))
    # they only balance work, so the most frequent will do
    return np.sort(hot.orderBy(F.desc("n"), "anchor").limit(MOST_HOT).select("anchor").toPandas()["anchor"].to_numpy(np.int64).view(np.uint64))


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of x is among the values."""
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _seen_anchors(window: int, k: int, hot: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, subs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            parts = []
            for c in chunks(batch.column(2)):
                at, anchor, block = _anchors(c, window, k)
                row = np.searchsorted(c.at, at, side="right") - 1
                parts.append((anchor, block, docs[c.first + row], subs[c.first + row], at - c.at[row]))
            if parts:
                found = list(map(np.concatenate, zip(*parts, strict=True)))
                anchor, block = found[:2]
                # all blocks of an anchor meet, but for one that is known to have several
                yield _batch(*found, route=np.where(_member(hot, anchor), mixed(anchor ^ mixed(block)), anchor))

    return run


def _repeats(hot: np.ndarray) -> Callable:
    """Rows sorted by anchor, block and place -> ``doc``, ``sub``, ``pos``, ``again``.

    ``again``: an earlier equal block exists. Other rows that come out are first in their block, and their
    anchor has other blocks too. Constant memory: the first row of an anchor waits for the next block.
    """
    return lambda batches: _again(batches, hot)


def _again(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    anchor = block = None  # of the row before
    first = None  # place of that row's block's first row
    waiting = None  # place of the anchor's only block so far
    for batch in batches:
        col = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        settled = col[6]
        out = [(col[3][settled], col[4][settled], col[5][settled], np.ones(int(settled.sum()), bool))]
        a, b, doc, sub, pos = (x[~settled] for x in col[1:6])
        if n := len(a):
            new_a, new_b = np.ones(n, bool), np.ones(n, bool)
            new_a[1:] = a[1:] != a[:-1]
            new_b[1:] = new_a[1:] | (b[1:] != b[:-1])
            new_a[0], new_b[0] = a[0] != anchor, a[0] != anchor or b[0] != block
            # a row equal to its block's first in place too is the same document read twice
            lead = np.maximum.accumulate(np.where(new_b, np.arange(n), -1))
            same = np.zeros(n, bool)
            known = lead >= 0
            same[known] = (doc[known] == doc[lead[known]]) & (sub[known] == sub[lead[known]]) & (pos[known] == pos[lead[known]])
            if first is not None:
                same[~known] = (doc[~known] == first[0]) & (sub[~known] == first[1]) & (pos[~known] == first[2])
            again = ~same
            out.append((doc[again], sub[again], pos[again], np.ones(int(again.sum()), bool)))
            # first rows of blocks; an anchor's first block counts once a second one is seen
            heads = np.flatnonzero(new_b)
            if len(heads):
                starts, known = new_a[heads], _member(hot, a[heads].view(np.uint64))
                follows = np.zeros(len(heads), bool)
                follows[:-1] = ~starts[1:]  # the next block has the same anchor
                if waiting is not None and not starts[0]:
                    out.append(tuple(np.array([x]) for x in waiting) + (np.zeros(1, bool),))
                several = heads[~starts | follows | known]
                out.append((doc[several], sub[several], pos[several], np.zeros(len(several), bool)))
                last = heads[-1]
                first = (doc[last], sub[last], pos[last])
                waiting = first if starts[-1] and not (follows[-1] | known[-1]) else None
            anchor, block = a[-1], b[-1]
        yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["doc", "sub", "pos", "again"])


def _found(seen: DataFrame, hot: np.ndarray) -> DataFrame:
    """What ``_repeats`` says of rows of _SEEN, as one array for each document."""
    dealt = seen.repartition("route").sortWithinPartitions("anchor", "block", "doc", "sub", "pos")
    rows = dealt.mapInArrow(_repeats(hot), "doc long, sub long, pos int, again boolean")
    mark = F.col("pos").cast("long") * 2 + F.col("again").cast("long")
    return rows.groupBy("doc", "sub").agg(F.collect_list(mark).alias("marks"))


def _cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n words lie in a span."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def _kept_texts(c: Chunk, cut: np.ndarray) -> list[str]:
    """The words of each row that aren't cut, joined by one space."""
    kept = np.flatnonzero(~cut)
    row = np.searchsorted(c.at, kept, side="right") - 1
    follows = np.zeros(len(kept), bool)
    if len(kept):
        follows[:-1] = row[1:] == row[:-1]
    change = np.zeros(len(c.data) + 1, np.int8)
    change[c.start[kept]] += 1
    change[c.end[kept]] -= 1
    keep, data = np.cumsum(change[:-1], dtype=np.int8) > 0, c.data.copy()
    after = c.end[kept[follows]]
    data[after], keep[after] = 32, True
    size = np.bincount(row, c.end[kept] - c.start[kept] + follows, len(c.count)).astype(np.int64)
    out, at = data[keep].tobytes(), np.cumsum(size) - size
    return [out[a : a + n].decode("utf-8", "replace") for a, n in zip(at.tolist(), size.tolist(), strict=True)]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column; null lists are empty."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.nan_to_num(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), values


def _settled(c: Chunk, offsets: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and ``again`` of the marks of a chunk's rows."""
    a, b = c.first, c.first + len(c.count)
    row = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
    mark = marks[offsets[a] : offsets[b]].astype(np.int64)
    return row, c.at[row] + mark // 2, mark % 2 == 1


def _open_windows(window: int, k: int) -> Callable:
    """doc, sub, text, rest, marks -> rows of _SEEN for each window whose anchor was first in one of several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, subs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            offsets, marks = _lists(batch.column(4))
            parts = []
            for c in chunks(batch.column(2)):
                _, at, again = _settled(c, offsets, marks)
                asked = np.zeros(len(c.start), bool)
                asked[at[~again]] = True
                if asked.any():
                    h = c.word_hashes()
                    start, anchor, grams = _winnow(c, h, window, k)
                    start, anchor = start[asked[anchor]], anchor[asked[anchor]]
                    row = np.searchsorted(c.at, start, side="right") - 1
                    whole = word_span_hashes(h, start, start + window)
                    parts.append((grams[anchor], whole, docs[c.first + row], subs[c.first + row], start - c.at[row]))
            if parts:
                found = list(map(np.concatenate, zip(*parts, strict=True)))
                yield _batch(*found, route=mixed(found[0] ^ mixed(found[1])))  # only equal windows need to meet

    return run


def _finish(window: int, k: int) -> Callable:
    """doc, sub, text, rest, marks of blocks, marks of windows -> rest, text, n_words, n_removed, kept_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, windows = _lists(batch.column(4)), _lists(batch.column(5))
            for c in chunks(batch.column(2)):
                row, at, again = _settled(c, *blocks)
                first, last = np.maximum(at - (window - k), c.at[row])[again], np.minimum(at + window, c.at[row + 1])[again]
                _, start, again = _settled(c, *windows)
                start = start[again]
                cut = _cover(len(c.start), np.concatenate([first, start]), np.concatenate([last, start + window]))
                removed = np.bincount(c.row_of_word(), cut, len(c.count)).astype(np.int64)
                rest, text = (batch.column(i).slice(c.first, len(c.count)) for i in (3, 2))
                columns = [rest, text, pa.array(c.count), pa.array(removed), pa.array(_kept_texts(c, cut), pa.string())]
                yield pa.record_batch(columns, ["rest", "text", "n_words", "n_removed", "kept_text"])

    return run


def _judged(docs: DataFrame, window: int, gram: int, id_col: str, text_col: str, rest: Column) -> DataFrame:
    """``rest``, ``text`` (null as ''), n_words, n_removed and kept_text of each row."""
    if not 0 < gram < window:
        raise ValueError("a gram must be shorter than the window")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    number = F.col(id_col).cast("long")
    unique = docs.select(number.alias("id")).groupBy("id").count().where("count > 1 or id is null").isEmpty()
    sub = F.lit(0).cast("long") if unique else F.xxhash64(text)
    least = F.lit(-(1 << 63)).cast("long")
    keyed = docs.select(F.coalesce(number, least).alias("doc"), sub.alias("sub"), text.alias("text"), rest.alias("rest"))

    hot, none = _hot_anchors(keyed, window, gram, HOT_SAMPLE, HOT_LEAST), np.zeros(0, np.uint64)
    # both joins below read the texts from one shuffle by document
    marks = written(_found(keyed.select("doc", "sub", "text").mapInArrow(_seen_anchors(window, gram, hot), _SEEN), hot), "anchors")
    texts = keyed.join(marks, ["doc", "sub"], "left").select("doc", "sub", "text", "rest", "marks")
    asked = _found(texts.mapInArrow(_open_windows(window, gram), _SEEN), none).withColumnRenamed("marks", "asked")
    settled = texts.join(asked, ["doc", "sub"], "left").select("doc", "sub", "text", "rest", "marks", "asked")
    kind = keyed.schema["rest"].dataType.simpleString()
    return settled.mapInArrow(_finish(window, gram), f"rest {kind}, text string, n_words long, n_removed long, kept_text string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space) for each row.

    Null and empty texts have no words. Null ids come before all others. Rows with one id and different
    texts are ordered by a hash of the text; rows that are equal in both are one document and get equal
    results. Texts shorter than a window, and an empty table, come out whole. Other columns are ignored.
    """
    rows = _judged(docs, window, gram, id_col, text_col, F.struct(F.col(id_col).alias("id")))
    return rows.select(F.col("rest.id").alias(id_col), "n_words", "n_removed", "kept_text")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from the texts; rows that lose nothing are unchanged.

    A changed text is its kept words joined by one space, and ``n_chars``, if there is one, its length.
    """
    others = [c for c in docs.columns if c != text_col]
    rest = F.struct(F.struct(*others).alias("row"), F.col(text_col).isNull().alias("empty"))
    rows = _judged(docs, window, gram, id_col, text_col, rest)
    changed = F.col("n_removed") > 0
    new = {c: F.col("rest.row")[c] for c in others} | {text_col: F.when(changed, F.col("kept_text")).when(~F.col("rest.empty"), F.col("text"))}
    if "n_chars" in others:
        length = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, length).otherwise(F.col("rest.row.n_chars"))
    return rows.select(*[new[c].alias(c) for c in docs.columns])
