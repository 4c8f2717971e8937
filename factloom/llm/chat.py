"""Perspective rotation of dialogues: each participant in turn is the assistant, the others are named users.

Every turn comes out once for each participant of its dialogue, as a rendered segment with its place in the
rendering and the span that counts for the loss. Segments in order of ``char_start`` make the whole text.

A dialogue is never gathered: its turns are cut into chunks by number, about the root of the longest
dialogue's turns in each, and turns without a number by speaker and the beginning of their text, which is
their order. Sums of chunks give each chunk's start; a window inside a chunk gives the rest.
Texts are shuffled once. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BEGIN, CLOSE = "<|im_start|>", "<|im_end|>"


def _header(role: Column | str, name: Column | None = None) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    parts = [F.lit(BEGIN), role] + ([F.lit(" name="), name] if name is not None else []) + [F.lit("\n")]
    return F.concat(*parts)


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system"
) -> DataFrame:
    """conv, ``perspective``, turn, ``role``, ``name``, ``segment``, ``char_start``, ``char_end``, ``loss_start``, ``loss_end``.

    The participants are a dialogue's speakers other than ``system``, whose turns stay system turns for all.
    The loss spans an assistant segment's text and end mark and is null for others. Offsets are code points
    of the rendered dialogue. A null or blank speaker is named ``unknown``; null texts are empty; null turns
    come last; equal turns go by speaker, then text; repeated rows are turns of their own. All rows with a
    null dialogue id are one dialogue. A dialogue of system turns alone has no participants and no rows.
    """
    speaker = F.col(speaker_col).cast("string")
    speaker = F.when(F.trim(speaker) == "", None).otherwise(speaker)
    rows = turns.select(
        F.struct(F.col(conv_col).isNull().alias("none"), F.coalesce(F.col(conv_col).cast("long"), F.lit(0)).alias("id")).alias("c"),
        F.struct(F.col(turn_col).isNull().alias("none"), F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("n")).alias("t"),
        F.coalesce(speaker, F.lit("unknown")).alias("s"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("x"),
    )
    longest = rows.groupBy("c").count().agg(F.max("count")).first()[0] or 1
    none = F.col("t.none")
    numbered = F.floor(F.col("t.n") / F.lit(max(16, int(longest**0.5))))
    unnumbered = [F.when(none, x).otherwise("") for x in (F.col("s"), F.substring("x", 1, 12))]
    rows = rows.withColumn("chunk", F.struct(none, numbered, *unnumbered))

    # lengths of a segment as an assistant's and as another's
    is_system = F.col("s") == system
    tail = F.length("x") + len(CLOSE) + 1
    as_other = F.when(is_system, F.length(_header(system))).otherwise(F.length(_header("user", F.col("s")))) + tail
    own = F.length(_header("assistant")) - F.length(_header("user", F.col("s")))  # how much longer as the assistant's

    sums = rows.groupBy("c", "chunk", "s").agg(F.sum(as_other).alias("n"), F.sum(own).alias("own"))
    people = sums.where(~is_system).select("c", F.col("s").alias("perspective")).distinct()
    per = sums.join(people, "c").groupBy("c", "chunk", "perspective")
    per = per.agg((F.sum("n") + F.coalesce(F.sum(F.when(F.col("s") == F.col("perspective"), F.col("own"))), F.lit(0))).alias("n"))
    ahead = Window.partitionBy("c", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("c", "chunk", "perspective", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))

    seen = rows.join(starts, ["c", "chunk"])
    mine = F.col("s") == F.col("perspective")
    role = F.when(is_system, system).when(mine, "assistant").otherwise("user")
    seen = seen.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("s")))
    head = F.when(F.col("role") == "user", _header("user", F.col("s"))).otherwise(_header(F.col("role")))
    seen = seen.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, "x", F.lit(CLOSE + "\n")))
    before = Window.partitionBy("c", "chunk", "perspective").orderBy("t", "s", "x").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0))
    seen = seen.withColumn("char_start", start.cast("long")).withColumn("char_end", (F.col("char_start") + F.length("segment")).cast("long"))
    loss = F.col("role") == "assistant"
    return seen.select(
        F.when(~F.col("c.none"), F.col("c.id")).alias(conv_col),
        "perspective",
        F.when(~F.col("t.none"), F.col("t.n")).alias(turn_col),
        "role",
        "name",
        "segment",
        "char_start",
        "char_end",
        F.when(loss, F.col("char_start") + F.col("head")).cast("long").alias("loss_start"),
        F.when(loss, F.col("char_end") - 1).cast("long").alias("loss_end"),
    )
