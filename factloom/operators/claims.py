"""Claims and citations of Markdown reports, and how well sources carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import SPACE, blank, block_of, evidence, filled, plain, trimmed
from factloom.sources.scratch import written

#: Names of sections (English and Chinese) and words that say nothing.
SUMMARY_SECTIONS = ("summary", "摘要", "总结", "概述", "executive summary", "结论", "conclusion")
LIST_SECTIONS = ("key findings", "findings", "evidence", "关键发现", "核心发现", "主要发现", "证据")
SKIPPED_SECTIONS = ("sources", "source list", "主要来源", "参考文献", "引用来源")
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "were")
VERDICTS = ("supported", "partially_supported", "unsupported", "unverifiable")
#: A citation and the start of a list item.
CITATION = r"\[(\d+)\.(\d+)(?:-(\d+)\.(\d+))?\]"
ITEM = rf"^{SPACE}*(?:[-*]|\d+\.){SPACE}+"
BY_RUN = ("run_id", "claim_index")
#: Citations of a claim that are rows of their own; what goes beyond, from its longest ranges, stays ranges.
LISTED = 100_000


def number_lines(reports: DataFrame) -> DataFrame:
    """run_id, ``line_no`` (from 1), ``line``, ``heading`` (of a ## or ### line) and ``section`` (the last heading so far)."""
    lines = reports.select("run_id", F.posexplode(F.split(F.coalesce("report", F.lit("")), "\r?\n")).alias("line_no", "line"))
    heading = F.nullif(trimmed(F.regexp_extract("line", rf"^###?{SPACE}+(.+)$", 1)), F.lit(""))
    rows = lines.withColumn("line_no", F.col("line_no") + 1).withColumn("heading", heading)
    upto = Window.partitionBy("run_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(upto), F.lit("Introduction")))


def section_kind(section: Column, bare: Column) -> Column:
    """skip, summary, list or body, by the section's name, whole or (``bare``) without a leading number."""

    def named(names: tuple[str, ...]) -> Column:
        return section.isin(*names) | bare.rlike(f"^(?:{'|'.join(names)})(?:$|：|:)")

    return F.when(named(SKIPPED_SECTIONS), "skip").when(named(SUMMARY_SECTIONS), "summary").when(named(LIST_SECTIONS), "list").otherwise("body")


def extract_claims(reports: DataFrame, least: int = 8) -> DataFrame:
    """run_id, ``claim_index`` (from 1), ``section``, ``text``, ``line_start``; one claim for each text of a run.

    In summaries lines that follow each other are one claim; blank lines, list items and headings end it. In
    lists every item or line is one; elsewhere only those with a citation.
    """
    rows = number_lines(reports).withColumn("whole", F.lower("section")).withColumn("bare", trimmed("line"))
    unnumbered = F.regexp_replace("whole", rf"^\d+(?:\.\d+)*[.)]{SPACE}*", "")
    rows = rows.withColumn("unnumbered", unnumbered).withColumn("kind", section_kind(F.col("whole"), F.col("unnumbered")))
    line, item, bare = F.col("line"), F.col("line").rlike(ITEM), F.col("bare")
    skipped = (bare == "") | bare.startswith("|") | bare.rlike("^-{3,}$") | bare.startswith("```")
    rows = rows.withColumn("item", item & ~skipped & F.col("heading").isNull()).withColumn("skipped", skipped)
    ends = F.col("heading").isNotNull() | F.col("item") | (bare == "")
    upto = Window.partitionBy("run_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("paragraph", F.sum(ends.cast("int")).over(upto))
    rows = rows.where(F.col("heading").isNull() & ~F.col("skipped") & (F.col("kind") != "skip"))

    prose = rows.where("kind = 'summary' and not item").groupBy("run_id", "section", "paragraph")
    joined = F.array_sort(F.collect_list(F.struct("line_no", F.col("bare").alias("t"))))
    prose = prose.agg(F.min("line_no").alias("line_start"), F.array_join(F.transform(joined, lambda x: x["t"]), " ").alias("text"))
    text = F.when(F.col("item"), plain(trimmed(F.regexp_replace(line, ITEM, "")))).otherwise(bare)
    single = rows.where("kind <> 'summary'").withColumn("text", text)
    single = single.where((F.col("kind") == "list") | F.col("text").rlike(CITATION))
    both = prose.select("run_id", "section", "line_start", "text").unionByName(
        single.select("run_id", "section", F.col("line_no").alias("line_start"), "text")
    )
    return dedupe_claims(both.withColumn("text", plain("text")).where(F.length("text") >= least))


def dedupe_claims(claims: DataFrame) -> DataFrame:
    """The first claim of each text of a run, numbered in order of lines."""
    first = Window.partitionBy("run_id", "text").orderBy("line_start")
    kept = claims.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("line_start"))
    return kept.select("run_id", number.alias("claim_index"), "section", "text", "line_start")


def extract_bullet_claims(reports: DataFrame, least: int = 20, most: int = 50) -> DataFrame:
    """run_id, ``claim_index``, ``section`` (of ## only), ``text``, ``has_citation``: the first ``most`` bullets of a report."""
    rows = reports.select("run_id", F.posexplode(F.split(F.coalesce("report", F.lit("")), "\n")).alias("line_no", "line"))
    heading = F.nullif(trimmed(F.regexp_extract("line", rf"^##{SPACE}+(.+)$", 1)), F.lit(""))
    upto = Window.partitionBy("run_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.coalesce(F.last(heading, ignorenulls=True).over(upto), F.lit(""))).where(heading.isNull())
    bare = trimmed("line")
    rows = rows.where(bare.startswith("-") | bare.startswith("*"))
    rows = rows.withColumn("text", trimmed(F.regexp_replace(bare, rf"^[-*]{SPACE}+", ""))).where(F.length("text") >= least)
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("line_no"))
    rows = rows.withColumn("claim_index", number).where(F.col("claim_index") <= most)
    return rows.select("run_id", "claim_index", "section", "text", F.col("text").rlike(r"\[\d+\.\d+\]").alias("has_citation"))


def parse_citations(claims: DataFrame) -> DataFrame:
    """run_id, claim_index, ``position`` (from 1), finding_index, source_index, ``finding_to`` and ``source_to`` of each citation, in order.

    ``[1.2]`` is one; ``[1.2-1.4]`` a range, ``[1.2-3.4]`` every such pair; reversed ranges give nothing. Of a range
    each pair is a row of its own (from and to are equal), and each pair of a claim comes once. Ranges that would bring
    a claim beyond ``LISTED`` pairs, the longest first, stay one row each; nothing is drawn out for them.
    """
    parts = [F.regexp_extract_all("text", F.lit(CITATION), F.lit(i)).alias(n) for i, n in enumerate(("a", "b", "c", "d"), 1)]
    found = claims.select(*BY_RUN, F.posexplode(F.arrays_zip(*parts)).alias("place", "m"))
    whole = lambda x: F.col(f"m.{x}").try_cast("bigint")
    single = F.col("m.c") == ""
    found = found.select(*BY_RUN, "place", whole("a").alias("a"), whole("b").alias("b"), F.when(single, whole("a")).otherwise(whole("c")).alias("c"), F.when(single, whole("b")).otherwise(whole("d")).alias("d"))
    found = found.where("a <= c and b <= d").groupBy(*BY_RUN, "a", "b", "c", "d").agg(F.min("place").alias("place"))
    pairs = F.least(_span("a", "c") * _span("b", "d"), F.lit(LISTED + 1)).cast("bigint")
    upto = Window.partitionBy(*BY_RUN).orderBy("pairs", "place").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("pairs", pairs).withColumn("few", F.sum("pairs").over(upto) <= LISTED)
    few = found.where("few").select(*BY_RUN, "place", "b", "d", F.explode(F.sequence("a", "c")).alias("finding_index"))
    few = few.select(*BY_RUN, "place", "finding_index", F.explode(F.sequence("b", "d")).alias("source_index"))
    few = few.groupBy(*BY_RUN, "finding_index", "source_index").agg(F.min("place").alias("place"))
    few = few.select("*", F.col("finding_index").alias("finding_to"), F.col("source_index").alias("source_to"))
    long = found.where("not few").select(*BY_RUN, F.col("a").alias("finding_index"), F.col("b").alias("source_index"), "place", F.col("c").alias("finding_to"), F.col("d").alias("source_to"))
    order = Window.partitionBy(*BY_RUN).orderBy("place", "finding_index", "source_index", "finding_to", "source_to")
    keys = ("finding_index", "source_index", "finding_to", "source_to")
    return few.unionByName(long).select(*BY_RUN, F.row_number().over(order).alias("position"), *keys)


def _span(low: str, high: str) -> Column:
    """How many whole numbers there are from ``low`` to ``high``."""
    return F.col(high).cast("decimal(19,0)") - F.col(low).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")


def _covered(ranges: DataFrame) -> DataFrame:
    """``covered`` of each claim: how many pairs its ranges hold together, by arithmetic.

    The ends of the ranges cut the finding numbers into strips; in a strip source numbers are plain intervals.
    """
    edges = ranges.select(*BY_RUN, F.explode(F.array(F.col("finding_index").cast("decimal(20,0)"), F.col("finding_to") + F.lit(1).cast("decimal(1,0)"))).alias("low")).distinct()
    strips = edges.withColumn("high", F.lead("low").over(Window.partitionBy(*BY_RUN).orderBy("low"))).where("high is not null")
    inside = strips.join(ranges, list(BY_RUN)).where("finding_index <= low and finding_to >= high - 1")
    before = Window.partitionBy(*BY_RUN, "low").orderBy("source_index", "source_to").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("from", F.greatest(F.col("source_index").cast("decimal(20,0)"), F.max("source_to").over(before) + F.lit(1).cast("decimal(1,0)")))
    new = F.greatest(F.col("source_to").cast("decimal(20,0)") - F.col("from") + F.lit(1).cast("decimal(1,0)"), F.lit(0))
    return inside.groupBy(*BY_RUN).agg(F.sum((F.col("high") - F.col("low")).cast("double") * new.cast("double")).alias("covered"))


def complete(title: Column | str = "title", url: Column | str = "url", proof: Column | str = "evidence") -> Column:
    """Title, URL and evidence are all there."""
    return ~blank(title) & ~blank(url) & ~blank(proof)


def resolve_citations(citations: DataFrame, sources: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """``citations`` with ``key``, ``resolved`` and the source's title, url, engine, evidence and ``complete``.

    With ``claims`` no texts go on: ``hits`` has the claim's words that stand in the source's title and evidence.

    A range that stayed whole meets the numbered sources within it, each of which is a resolved row. What it leaves
    unresolved is one row with the range as its key. ``n`` is how many citations a row stands for: 1, but for such
    rows; of a claim's the first has what all of them leave together, the others 0.
    """
    keys = ["finding_index", "source_index"]
    told = [F.lit(True).alias("resolved"), "engine", complete(proof=evidence()).alias("complete")]
    told += ["title", "url", evidence().alias("evidence")] if claims is None else [tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), evidence())).alias("heard")]
    numbered = sources.withColumns({k: F.col(k).cast("bigint") for k in keys})
    single = (F.col("finding_index") == F.col("finding_to")) & (F.col("source_index") == F.col("source_to"))
    citations = written(citations, "parsed-citations")
    one, long = citations.where(single).drop("finding_to", "source_to"), citations.where(~single)
    at = ["run_id", *keys]
    cited = numbered.join(one.select(*at).distinct(), at, "left_semi").select(*at, *told)
    rows = one.join(cited, at, "left").withColumns({"key": _key("finding_index", "source_index"), "n": F.lit(1.0)})
    if not long.isEmpty():
        rows = _with_ranges(rows, one, long, numbered, told)
    rows = rows.withColumns({"resolved": F.coalesce("resolved", F.lit(False)), "complete": F.coalesce("complete", F.lit(False))})
    if claims is None:
        return rows
    said = claims.select(*BY_RUN, tokens(F.col("text")).alias("said"))
    return rows.join(said, list(BY_RUN)).withColumn("hits", F.array_intersect("said", "heard")).drop("said", "heard")


def _key(*columns: str) -> Column:
    return F.concat_ws(".", *[F.col(c).cast("string") for c in columns])


def _with_ranges(rows: DataFrame, one: DataFrame, long: DataFrame, numbered: DataFrame, told: list[Column]) -> DataFrame:
    """``rows`` with those of the ranges that stayed whole: the sources in them, and what they leave unresolved."""
    keys = ["finding_index", "source_index"]
    at = ["run_id", *keys]
    ends = long.select(*BY_RUN, "position", *[F.col(k).alias(f"from_{k}") for k in keys], "finding_to", "source_to")
    within = (F.col("finding_index").between(F.col("from_finding_index"), F.col("finding_to"))) & (F.col("source_index").between(F.col("from_source_index"), F.col("source_to")))
    met = ends.join(numbered.select(*at), "run_id").where(within).groupBy(*BY_RUN, *keys).agg(F.min("position").alias("position"))
    met = met.join(one.select(*BY_RUN, *keys), [*BY_RUN, *keys], "left_anti")
    listed = ends.drop("position").join(one.select(*BY_RUN, *keys), list(BY_RUN)).where(within).select(*BY_RUN, *keys).distinct()
    there = met.join(numbered.join(met.select(*at).distinct(), at, "left_semi").select(*at, *told), at)
    rows = rows.unionByName(there.withColumns({"key": _key(*keys), "n": F.lit(1.0)}))

    count = lambda df, name: df.groupBy(*BY_RUN).agg(F.count("*").alias(name))
    rest = _covered(long).join(count(met, "met"), list(BY_RUN), "left").join(count(listed, "listed"), list(BY_RUN), "left")
    rest = rest.select(*BY_RUN, (F.col("covered") - F.coalesce("met", F.lit(0)) - F.coalesce("listed", F.lit(0))).alias("n")).where("n > 0")
    first = F.row_number().over(Window.partitionBy(*BY_RUN).orderBy("position")) == 1
    key = F.concat(_key(*keys), F.lit("-"), _key("finding_to", "source_to"))
    n = F.when(F.col("first"), F.col("n")).otherwise(0.0)
    rest = long.withColumn("first", first).join(rest, list(BY_RUN)).select(*BY_RUN, "position", *keys, key.alias("key"), n.alias("n"))
    return rows.unionByName(rest, allowMissingColumns=True)


def tokens(text: Column) -> Column:
    """Different words of a text: runs of Chinese of two or more, and of a-z and 0-9 of three or more."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([一-鿿]{2,}|[a-z0-9]{3,})"), F.lit(1))
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))


def shared_words(claims: DataFrame, resolved: DataFrame) -> DataFrame:
    """``shared`` of each claim with a resolved citation: how many of its words stand in cited titles and evidence.

    A claim's few words go to its citations; of a source's text only the words they share go on.
    """
    if "hits" in resolved.columns:
        return _shared(resolved.where("resolved"))
    said = claims.select(*BY_RUN, tokens(F.col("text")).alias("said"))
    heard = tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("evidence", F.lit(""))))
    return _shared(resolved.where("resolved").join(said, list(BY_RUN)).select(*BY_RUN, F.array_intersect("said", heard).alias("hits")))


def _shared(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*BY_RUN).agg(F.size(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("shared"))


def keyword_overlap(claims: DataFrame, resolved: DataFrame) -> DataFrame:
    """run_id, claim_index and ``overlap``: the share of a claim's words that stand in its cited sources; 0 without any."""
    rows = claims.select(*BY_RUN, F.size(tokens(F.col("text"))).alias("n")).join(shared_words(claims, resolved), list(BY_RUN), "left")
    return rows.select(*BY_RUN, F.when(F.col("n") > 0, F.coalesce("shared", F.lit(0)) / F.col("n")).otherwise(0.0).alias("overlap"))


def score_claims(claims: DataFrame, resolved: DataFrame, platform: str | None = None, least_overlap: float = 0.08) -> DataFrame:
    """Each claim with its citation keys, unresolved ones, rule flags and ``overlap``.

    ``overlap`` is the share of the claim's words among those of its cited sources' titles and evidence; with
    ``platform`` every resolved source must be of that engine.
    """
    shared = shared_words(claims, resolved)
    key = F.struct("position", "finding_index", "source_index", "key", "resolved")
    per = resolved.groupBy(*BY_RUN).agg(
        F.array_sort(F.collect_list(key)).alias("keys"),
        F.sum("n").alias("n_citations"),
        F.count_if("resolved").alias("n_resolved"),
        F.count_if("complete").alias("n_complete"),
        F.count_if(F.col("resolved") & ~F.col("engine").eqNullSafe(F.lit(platform))).alias("n_foreign"),
    )
    rows = claims.join(per, list(BY_RUN), "left").join(shared, list(BY_RUN), "left")
    rows = rows.withColumn("keys", F.coalesce("keys", F.array().cast("array<struct<position: int, finding_index: bigint, source_index: bigint, key: string, resolved: boolean>>")))
    names = lambda x: x["key"]
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    words = F.size(tokens(F.col("text")))
    rows = rows.withColumn("overlap", F.when(words > 0, n("shared") / words).otherwise(0.0))
    rows = rows.withColumn("has_citations", F.size("keys") > 0)
    rows = rows.withColumn("citations_resolved", n("n_resolved") == n("n_citations"))
    rows = rows.withColumn("sources_complete", n("n_complete") == n("n_resolved"))
    rows = rows.withColumn("platform_match", (n("n_foreign") == 0) if platform else F.lit(True))
    flags = {
        "no_citation": ~F.col("has_citations"),
        "citation_unresolved": ~F.col("citations_resolved"),
        "missing_source_fields": ~F.col("sources_complete"),
        "platform_mismatch": ~F.col("platform_match"),
        "low_keyword_overlap": F.col("has_citations") & (F.col("overlap") < least_overlap),
    }
    return rows.select(
        *BY_RUN, "section", "text", "line_start",
        F.transform("keys", names).alias("citation_keys"),
        F.transform(F.filter("keys", lambda x: ~x["resolved"]), names).alias("unresolved"),
        n("n_citations").alias("n_citations"), n("n_resolved").alias("n_resolved"), n("n_complete").alias("n_complete"),
        "overlap", "has_citations", "citations_resolved", "sources_complete", "platform_match",
        F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in flags.items()])).alias("flags"),
    )


def parse_verdicts(responses: DataFrame, text: str = "response") -> DataFrame:
    """``responses`` with ``verdict``, ``confidence`` (0 to 1), ``reason`` and ``parse_error`` from the JSON in a reply."""
    told = F.from_json(block_of(text, "{", "}"), "verdict string, confidence string, reason string")
    rows = responses.withColumn("_v", told)
    verdict = trimmed("_v.verdict")
    known = F.coalesce(verdict.isin(*VERDICTS), F.lit(False))
    sure = F.coalesce(F.col("_v.confidence").try_cast("double"), F.lit(0.0))
    sure = F.when(F.isnan(sure), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sure)))
    return rows.select(
        *responses.columns,
        F.when(known, verdict).alias("verdict"),
        F.when(known, sure).alias("confidence"),
        F.when(known, F.coalesce(trimmed("_v.reason"), F.lit(""))).alias("reason"),
        F.when(block_of(text, "{", "}").isNull(), "no JSON").when(~known, "no known verdict").alias("parse_error"),
    )


def judge_claims(scores: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Scores with ``verdict``, ``confidence``, ``reason`` and ``skipped``.

    Without a resolved source a claim is unverifiable at 0.9; else its row of ``verdicts`` holds; claims
    without one are skipped.
    """
    rows = scores
    if verdicts is None:
        rows = rows.withColumns({"_verdict": F.lit(None).cast("string"), "_confidence": F.lit(None).cast("double"), "_reason": F.lit(None).cast("string")})
        alone = F.lit(False)
    else:
        told = verdicts.select(*BY_RUN, *[F.col(c).alias(f"_{c}") for c in ("verdict", "confidence", "reason")])
        rows, alone = rows.join(told, list(BY_RUN), "left"), F.col("n_resolved") == 0
    return rows.select(
        *scores.columns,
        F.when(alone, "unverifiable").otherwise(F.col("_verdict")).alias("verdict"),
        F.when(alone, 0.9).otherwise(F.col("_confidence")).alias("confidence"),
        F.when(alone, "no resolvable citation").otherwise(F.col("_reason")).alias("reason"),
        (~alone & F.col("_verdict").isNull()).alias("skipped"),
    )


def claim_prompts(claims: DataFrame, resolved: DataFrame) -> DataFrame:
    """run_id, claim_index and the ``prompt``: the claim and its cited sources, or ``(none)``."""
    shown = F.concat(
        F.lit("["), "key", F.lit("]\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\nURL: "), F.coalesce("url", F.lit("")),
        F.lit("\nEvidence: "), F.coalesce("evidence", F.lit("")), F.lit("\nEngine: "), F.coalesce("engine", F.lit("")),
    )
    blocks = resolved.where("resolved").groupBy(*BY_RUN).agg(F.array_sort(F.collect_list(F.struct("position", shown.alias("t")))).alias("b"))
    cited = filled(F.array_join(F.transform("b", lambda x: x["t"]), "\n\n"), F.lit("(none)"))
    rows = claims.join(blocks, list(BY_RUN), "left")
    return rows.select(*BY_RUN, F.concat(F.lit("Claim:\n"), "text", F.lit("\n\nCited sources:\n"), cited).alias("prompt"))
