"""Mixing sources to target weights by Pareto order sampling.

Targets. Every source gets its weight's share of all sizes, but no more than ``max_copies`` times its own
size; what is cut off is shared again by weight until no source is above its cap.

Copies. Within a source a document's expected copies are in proportion to its weight, ``max_copies`` at most;
what that cap cuts off goes to the others, so the expected words of a source are its target. Without a weight
column a document of n words weighs ``n / (n + half_words)``, so scraps are drawn less often than full texts.
The whole part of its expected copies is certain. The fraction is its inclusion probability p in a sample of
fixed size: documents are ranked by ``odds(u) / odds(p)`` with a random u of its own, and the sample is the
head of that order whose sizes come nearest to what is left of the target.

u is a hash of id, source, text and seed. Rows equal in these are numbered, and the number is hashed too, so
each draws for itself. The head is found without sorting a source in one task: ranks are counted into about
sqrt(n) intervals a source, running sums over those find the interval that holds the cut, and only its
documents, about sqrt(n) again, are put in order. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.shared import SEPARATORS, cut, numbered, positions, small_join, written


def word_count(text: Column) -> Column:
    """Words of a text, without a lambda: only the first and the last piece of a split can be empty."""
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATORS)
    empty = (F.element_at(parts, 1) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    return F.greatest(F.size(parts) - empty, F.lit(0)).cast("long")


def targets(sources: DataFrame, max_copies: float = 3.0, rounds: int = 1000) -> DataFrame:
    """``sources`` (source, weight, source_size) with ``target``: shares of all sizes by weight, capped and reshared.

    Sources of null or no positive weight get nothing unless the others are at their caps. Each round caps one
    more source at least; more than ``rounds`` of them are an error.
    """
    rows = cut(sources.withColumn("cap", max_copies * F.col("source_size")))
    total, fixed, level = rows.agg(F.sum("source_size")).first()[0] or 0, 0.0, 0.0
    at_cap = F.lit(False)
    for _ in range(rounds):
        fixed, weight = rows.agg(
            F.coalesce(F.sum(F.when(at_cap, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0.0))
        ).first()
        if weight <= 0:
            break
        level, before = (total - fixed) / weight, level
        at_cap = F.col("cap") <= F.col("weight") * level
        if level <= before:
            break
    else:
        raise RuntimeError(f"targets did not settle in {rounds} rounds")
    return rows.withColumn("target", F.when(at_cap, F.col("cap")).otherwise(F.coalesce(F.col("weight") * level, F.lit(0.0)))).drop("cap")


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts only."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + 0.5) / float(1 << 53)


def _key(source: Column) -> Column:
    """A source as a join key; null is a source like any other."""
    return F.struct(source.isNull(), F.coalesce(source, F.lit("")))


def _ranked(rows: DataFrame, max_copies: float, seed: int) -> DataFrame:
    """``rows`` (key, number, size, w, and the source's ratio and grid) with certain copies, rank of the rest and its slot."""
    expected = F.when((F.col("size") > 0) & (F.col("w") > 0), F.least(F.lit(float(max_copies)), F.col("ratio") * F.col("w"))).otherwise(0.0)
    rows = rows.withColumn("e", expected).withColumn("whole", F.floor(F.col("e") + 1e-9))
    rows = rows.withColumn("p", F.greatest(F.lit(0.0), F.col("e") - F.col("whole")))
    u = _uniform(F.col("key"), F.col("number"), F.lit(seed))
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("rank", F.when(F.col("p") > 1e-12, odds / (1 + odds)))  # in (0, 1), in the order of the odds
    return rows.withColumn("slot", F.floor(F.col("rank") * F.col("grid")).cast("long")).drop("e", "p")


def _place() -> Column:
    return F.struct("rank", "key", "number", "size")


def _copies() -> Column:
    """Of a ranked row with its source's cut: the certain copies, and one more up to the cut."""
    inside = (F.col("slot") < F.col("at")) | ((F.col("slot") == F.col("at")) & (_place() <= F.col("bound")))
    return F.col("whole") + F.coalesce(inside, F.lit(False)).cast("long")


def _weight(weight_col: str | None, half_words: float, size: Column) -> Column:
    """A weight, rounded to sixteenths of a power of two, so that a source has few different ones."""
    told = F.col(weight_col).cast("double") if weight_col else size / (size + F.lit(float(half_words)))
    return F.when(told > 0, F.pow(F.lit(2.0), F.round(F.log2(told) * 16) / 16)).otherwise(0.0)


def _items(docs: DataFrame, weight_col: str | None, half_words: float, *more: Column) -> DataFrame:
    """Written: source key ``k``, source, size, w, ``key`` (a hash of id, source and text), ``place`` and ``more`` of each row.

    ``place`` is different for each row; its high bits are those of the row's partition.
    """
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    size = word_count(text)
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", source.isNull(), source, text)
    rows = docs.select(source.alias("source"), size.alias("size"), _weight(weight_col, half_words, size).alias("w"), key.alias("key"), F.monotonically_increasing_id().alias("place"), *more)
    return written(rows.withColumn("k", _key(F.col("source"))), "mix-items")


def _ratios(items: DataFrame, sources: DataFrame, max_copies: float) -> DataFrame:
    """``k``, source_size, target, ``n`` and ``ratio`` (expected copies for a weight of 1) of each source.

    With the heaviest documents at ``max_copies`` and the others in proportion: the largest ratio at which no
    other one is above the cap. The windows run over a source's different weights, which are few.
    """
    groups = items.groupBy("k", "w").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    heavy = Window.partitionBy("k").orderBy(F.desc("w"))
    over = F.coalesce(F.sum("size").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mass = F.sum(F.col("size") * F.col("w")).over(heavy.rowsBetween(0, Window.unboundedFollowing))
    rows = groups.withColumns({"over": over, "mass": mass}).join(sources.select(_key(F.col("source")).alias("k"), "source_size", "target"), "k")
    ratio = F.when(F.col("mass") > 0, (F.col("target") - max_copies * F.col("over")) / F.col("mass"))
    fits = ratio * F.col("w") <= max_copies * (1 + 1e-12)
    rows = rows.groupBy("k", "source_size", "target").agg(F.sum("n").alias("n"), F.max(F.when(fits, ratio)).alias("ratio"))
    return rows.withColumn("ratio", F.when(F.col("target") > 0, F.coalesce("ratio", F.lit(1e18))).otherwise(0.0))  # all at the cap


def cuts(items: DataFrame, sources: DataFrame, max_copies: float = 3.0, seed: int = 1) -> DataFrame:
    """One row for each source: its key ``k``, source_size, target, ratio, grid, and where its sample ends (``at``, ``bound``).

    ``items`` has k, size, w, key and number; ``sources`` has source, source_size and target.
    """
    grid = F.greatest(F.lit(1.0), F.floor(F.sqrt(F.col("n").cast("double"))))
    per = cut(_ratios(items, sources, max_copies).withColumn("grid", grid).drop("n"))
    rows = _ranked(small_join(items, per.select("k", "ratio", "grid"), ["k"]), max_copies, seed)
    rows = written(rows.select("key", "number", "size", "k", "whole", "rank", "slot"), "mixing")

    # what is left of each target once the certain copies are given, and the slot that holds the cut
    slots = rows.groupBy("k", "slot").agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("whole")).alias("whole"))
    rest = slots.groupBy("k").agg(F.sum("whole").alias("whole")).join(per.select("k", "target"), "k")
    rest = rest.select("k", F.greatest(F.lit(0.0), F.col("target") - F.col("whole")).alias("rest"))
    before = F.sum("size").over(Window.partitionBy("k").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    held = slots.where("slot is not null").withColumn("before", F.coalesce(before, F.lit(0))).join(rest, "k")
    held = held.where("before < rest").withColumn("at", F.max("slot").over(Window.partitionBy("k"))).where("slot = at")
    ends = cut(rest.join(held.select("k", "at", "before"), "k", "left"))

    # inside that slot, the head whose sizes come nearest to the rest
    edge = small_join(rows.where("slot is not null"), ends.where("at is not null"), ["k"]).where("slot = at")
    order = Window.partitionBy("k").orderBy("rank", "key", "number").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("sum", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.where(F.abs(F.col("sum") + F.col("size") - F.col("rest")) < F.abs(F.col("sum") - F.col("rest")))
    bound = edge.groupBy("k").agg(F.max(_place()).alias("bound"))
    return cut(per.join(ends.select("k", "at"), "k").join(bound, "k", "left"))


def _planned(items: DataFrame, weights: DataFrame | None, max_copies: float, seed: int) -> DataFrame:
    """``items`` with the cuts of their sources, ranked."""
    sources = cut(items.groupBy("source").agg(F.sum("size").alias("source_size")))
    if weights is None:
        weighted = repeating_weights(sources)
    else:
        told = weights.select(F.col("source").alias("name"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
        weighted = sources.join(told, F.col("source").eqNullSafe(F.col("name")), "left").drop("name").fillna(0.0, ["weight"])
    small = numbered(items.drop("row"))
    ends = cuts(small, targets(weighted, max_copies), max_copies, seed)
    rows = small if "row" not in items.columns else numbered(items)
    return _ranked(small_join(rows, ends, ["k"]), max_copies, seed).withColumn("copies", _copies())


def repeating_weights(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """``source`` rows with ``weight``: the weights in turn over the sources by code point, null last."""
    placed = positions(sources, [F.col("source").isNull(), F.col("source")])
    turn = (F.col("position") % len(weights) + 1).cast("int")
    return placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn)).drop("position")


def mix(
    docs: DataFrame, weights: DataFrame | None = None, max_copies: float = 3.0, seed: int = 1, weight_col: str | None = None, half_words: float = 100.0
) -> DataFrame:
    """The mix of whole ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, copies and taken.

    Sizes are words; null texts have none. ``weights`` has source and weight (sources it lacks weigh 0); by
    default 5, 2 and 1 repeat over the sources in order; a null source is one of them, the last. Expected
    copies are in proportion to ``weight_col`` within a source (null or negative: 0), by default to
    ``n / (n + half_words)`` (0: all alike). Documents without words are never taken. Null ids and rows equal
    in id, source and text draw each for itself. Other columns don't matter. An empty table gives an empty mix.
    """
    items = _items(docs, weight_col, half_words, F.col("doc_id"))
    return _planned(items, weights, max_copies, seed).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(
    docs: DataFrame, weights: DataFrame | None = None, max_copies: float = 3.0, seed: int = 1, weight_col: str | None = None, half_words: float = 100.0
) -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it; rows are otherwise unchanged. Texts aren't shuffled."""
    items = _items(docs, weight_col, half_words, F.struct(*docs.columns).alias("row"))
    often = _planned(items, weights, max_copies, seed).where("copies > 0")
    return often.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
