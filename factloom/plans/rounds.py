"""Collection in rounds over all queries at once: prompts, answers, searches, page text, relevance."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import block_of, clipped, evidence, filled, ordered, trimmed
from factloom.operators.pages import retrieve
from factloom.operators.sources import clean_questions, dedupe_sources, enrichment_candidates, last_sources, union_rounds
from factloom.sources.scratch import written

NO_SOURCES = "No sources were found."


def evidence_block(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """``evidence`` of each run: its findings in order with their numbered sources; a fixed text for runs without findings."""
    i, j = F.col("finding_index").cast("string"), F.col("source_index").cast("string")
    shown = F.concat(F.lit("["), i, F.lit("."), j, F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("url", F.lit("")), F.lit("\nEvidence: "), evidence())
    per = sources.groupBy("run_id", "finding_index").agg(F.array_join(ordered(shown, "source_index"), "\n\n").alias("told"))
    rows = findings.join(per, ["run_id", "finding_index"], "left")
    block = F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")), F.lit("\nSources:\n"), F.coalesce("told", F.lit("")))
    return rows.groupBy("run_id").agg(F.array_join(ordered(block, "finding_index"), "\n\n---\n\n").alias("evidence"))


def evidence_or_none(runs: DataFrame, findings: DataFrame, sources: DataFrame) -> DataFrame:
    told = evidence_block(findings, sources)
    return runs.select("run_id").join(told, "run_id", "left").select("run_id", F.coalesce("evidence", F.lit(NO_SOURCES)).alias("evidence"))


def recent_context(sources: DataFrame, limit: int = 30, chars: int | None = 500) -> DataFrame:
    """``context`` of each run: its last ``limit`` sources in order, numbered anew, with evidence of ``chars`` characters at most."""
    proof = evidence() if chars is None else clipped(evidence(), chars)
    head = F.concat(F.lit("Source "), F.col("number").cast("string"), F.lit(": "), filled("title", F.lit("Untitled")), F.lit("\nURL: "), F.coalesce("url", F.lit("")))
    shown = F.concat(head, F.lit("\nEvidence: "), proof)
    return last_sources(sources, limit).groupBy("run_id").agg(F.array_join(ordered(shown, "number"), "\n\n").alias("context"))


def batch_prompts(sources: DataFrame, queries: DataFrame, batch_size: int = 10) -> DataFrame:
    """run_id, ``batch`` (from 0) and ``prompt``: each run's different sources, ten to a rating prompt."""
    order = Window.partitionBy("run_id").orderBy("finding_index", "source_index")
    rows = dedupe_sources(sources).withColumn("_n", F.row_number().over(order) - 1)
    rows = rows.withColumn("batch", F.floor(F.col("_n") / batch_size).cast("int")).withColumn("_i", F.col("_n") % batch_size + 1)
    shown = F.concat(
        F.col("_i").cast("string"), F.lit(". "), filled("title", F.lit("Untitled")), F.lit("\nURL: "), F.coalesce("url", F.lit("")), F.lit("\nEvidence: "), evidence()
    )
    per = rows.groupBy("run_id", "batch").agg(F.array_join(ordered(shown, "_i"), "\n\n").alias("items"), F.count("*").alias("n_items"))
    text = F.concat(F.lit("Research query: "), F.coalesce("query", F.lit("")), F.lit("\n\nRate source relevance:\n"), "items")
    return per.join(queries.select("run_id", "query"), "run_id", "left").select("run_id", "batch", "n_items", text.alias("prompt"))


def complete_prompts(prompts: DataFrame, complete: Callable[[str], str] | None = None, responses: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """``prompts`` (prompt_id, prompt) with ``response`` and ``error``: of a callable, or recorded by prompt_id.

    The callable runs on the executors, ``partitions`` calls at a time; what it raises is the row's error.
    """
    if complete is None:
        return prompts.join(responses.select("prompt_id", "response"), "prompt_id", "left").withColumn(
            "error", F.when(F.col("response").isNull(), "no recorded response")
        )

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return complete(text), None
        except Exception as error:
            return None, f"{type(error).__name__}: {error}"

    rows = prompts.repartition(partitions) if partitions else prompts
    # not in Arrow batches: 10 000 prompts at once can be hundreds of MB, here a hundred are, and they don't come back
    call = F.udf(one, "response string, error string", useArrow=False).asNondeterministic()
    return rows.withColumn("_told", call("prompt")).select(*prompts.columns, "_told.response", "_told.error")


def parse_questions(responses: DataFrame, count: int = 3, query: str = "query") -> DataFrame:
    """``responses`` with ``questions``: the first ``count`` non-blank texts of the list in the reply, else the query alone."""
    told = F.from_json(block_of("response", "[", "]"), "array<string>")
    some = F.slice(F.filter(F.transform(told, trimmed), lambda q: q != ""), 1, count)
    return responses.withColumn("questions", F.when(F.size(F.coalesce(some, F.array().cast("array<string>"))) > 0, some).otherwise(F.array(query)))


def parse_relevance(responses: DataFrame) -> DataFrame:
    """run_id, batch, ``item`` (from 1), ``keep``, ``score``, ``reason`` and ``parsed``, a row for each item of a batch.

    Of items given twice the last counts; others are ignored beyond the batch, and kept at 0.5 where absent.
    """
    told = F.from_json(block_of("response", "[", "]"), "array<struct<index: int, keep: boolean, score: double, reason: string>>")
    rows = responses.withColumn("told", told).withColumn("parsed", F.col("told").isNotNull())
    rows = rows.select("run_id", "batch", "parsed", "told", F.explode(F.sequence(F.lit(1), F.col("n_items").cast("int"))).alias("item"))
    mine = F.element_at(F.filter("told", lambda x: x["index"] == F.col("item")), -1)
    rows = rows.withColumn("m", F.when(F.size(F.filter(F.coalesce("told", F.array().cast("array<struct<index: int, keep: boolean, score: double, reason: string>>")), lambda x: x["index"] == F.col("item"))) > 0, mine))
    there = F.col("m").isNotNull()
    return rows.select(
        "run_id", "batch", "item",
        F.when(there, F.coalesce("m.keep", F.lit(True))).otherwise(True).alias("keep"),
        F.when(there, F.coalesce("m.score", F.lit(0.0))).otherwise(0.5).alias("score"),
        F.when(there, F.coalesce("m.reason", F.lit(""))).otherwise("").alias("reason"), "parsed",
    )


def filter_by_relevance(sources: DataFrame, decisions: DataFrame, max_sources: int = 30) -> DataFrame:
    """Sources whose URL is among the run's ``max_sources`` best, with ``keep``, ``score`` and ``reason``; those without URL go.

    ``decisions`` has run_id, url, keep, score and reason. A source without a decision is kept at 0.5; one
    without URL takes a place among the best all the same.
    """
    unique = dedupe_sources(sources)
    rows = unique.join(decisions.select("run_id", "url", "keep", "score", "reason"), ["run_id", "url"], "left")
    rows = rows.withColumns({"keep": F.coalesce("keep", F.lit(True)), "score": F.coalesce("score", F.lit(0.5)), "reason": F.coalesce("reason", F.lit(""))})
    best = Window.partitionBy("run_id").orderBy(F.desc("score"), "finding_index", "source_index")
    kept = rows.where("keep").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= max_sources)
    return sources.join(kept.where(filled("url").isNotNull()).select("run_id", "url", "keep", "score", "reason"), ["run_id", "url"])


def findings_left(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """Findings that still have sources, or an error."""
    there = sources.select("run_id", "finding_index", F.lit(True).alias("_there")).distinct()
    rows = findings.join(there, ["run_id", "finding_index"], "left")
    return rows.where(F.col("_there") | F.col("error").isNotNull()).drop("_there")


def enrich_sources(sources: DataFrame, page_text: DataFrame, mode: str = "content", chosen: str | None = None) -> DataFrame:
    """``sources`` with the page text of their URL (``page_text``: url, title, content, status, error, and summary for that mode).

    A page that was read gives content, and the title where there is none; mode ``summary`` gives its summary
    too, or the snippet. A failed one leaves status and error. ``chosen`` names a column: a URL is enriched in
    a finding where one of its sources is chosen. Of several pages with one URL the first by status (ok before
    failed), title and content counts. Rows that aren't enriched stay as they are.
    """
    best = Window.partitionBy("url").orderBy(F.col("status") != "ok", "status", "title", "content")
    page_text = page_text.withColumn("_place", F.row_number().over(best)).where("_place = 1")
    if "fetch_error" not in sources.columns:
        sources = sources.withColumn("fetch_error", F.lit(None).cast("string"))
    told = page_text.select("url", *[F.col(c).alias(f"_{c}") for c in ("title", "content", "status", "error")], *([F.col("summary").alias("_summary")] if "summary" in page_text.columns else []))
    rows = sources
    if chosen:
        at = rows.where(chosen).select("run_id", "finding_index", "url", F.lit(True).alias("_asked")).distinct()
        rows = rows.join(at, ["run_id", "finding_index", "url"], "left")
    else:
        rows = rows.withColumn("_asked", filled("url").isNotNull())
    rows = rows.join(told, "url", "left")
    asked = F.coalesce("_asked", F.lit(False)) & F.col("_status").isNotNull()
    ok = asked & (F.col("_status") == "ok")
    new = {
        "title": F.when(ok, filled("title", "_title")).otherwise(F.col("title")),
        "content": F.when(ok, F.col("_content")).otherwise(F.col("content")),
        "fetch_status": F.when(asked, F.col("_status")).otherwise(F.col("fetch_status")),
        "fetch_error": F.when(asked, F.when(~ok, F.col("_error"))).otherwise(F.col("fetch_error")),
    }
    if mode == "summary":
        summary = F.col("_summary") if "_summary" in rows.columns else F.lit(None).cast("string")
        new["summary"] = F.when(ok, filled(summary, "snippet")).otherwise(F.col("summary"))
    return rows.withColumns(new).drop("_asked", "_title", "_content", "_status", "_error", "_summary")


def resolve_content(urls: DataFrame, backends: list[DataFrame], mode: str = "auto") -> DataFrame:
    """``urls`` with title, content, status and error of the first answer that isn't ``unsupported``, newest backend first.

    The first of ``backends`` is the plain one (page text); the others are handlers, later ones newer. Mode
    ``plain`` asks the first only, ``handler`` the others only, whose absence is an error.
    """
    chain = list(enumerate(backends)) if mode == "auto" else [(0, backends[0])] if mode == "plain" else list(enumerate(backends))[1:]
    answers = None
    for place, df in chain:
        one = df.select("url", "title", "content", "status", "error", F.lit(place).alias("_at"))
        answers = one if answers is None else answers.unionByName(one)
    missing = F.lit("No content handler matched URL") if mode == "handler" else F.lit("No content for URL")
    if answers is None:
        none = F.lit(None).cast("string")
        return urls.withColumns({"title": none, "content": none, "status": F.lit("failed"), "error": missing})
    first = Window.partitionBy("url").orderBy(F.desc("_at"))
    best = answers.where("status <> 'unsupported'").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_at")
    rows = urls.join(best, "url", "left")
    return rows.withColumn("error", F.when(F.col("status").isNull(), missing).otherwise(F.col("error"))).fillna("failed", ["status"])


def search_round(questions: DataFrame, corpus: DataFrame | None = None, search: Callable[[str], list[dict]] | None = None, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Findings (run_id, finding_index, question, error) and sources of one round over cleaned questions.

    The default search is retrieval over ``corpus`` (path, content). A callable gives a list of title, url and
    snippet; what it raises is the finding's error, and its sources are none.
    """
    order = Window.partitionBy("run_id").orderBy("position")
    asked = clean_questions(questions).withColumn("finding_index", F.row_number().over(order)).select("run_id", "finding_index", "question")
    if search is None:
        asked = written(asked, "asked")
        ids = asked.withColumn("question_id", F.struct("run_id", "finding_index"))
        hits = retrieve(ids.select("question_id", "question"), corpus, k)
        sources = hits.select(
            "question_id.run_id", "question_id.finding_index", F.col("rank").alias("source_index"), F.col("path").alias("title"), F.col("path").alias("url"), F.col("excerpt").alias("snippet")
        )
        return asked.withColumn("error", F.lit(None).cast("string")), sources

    def one(question: str) -> tuple[list[dict], str | None]:
        try:
            return [{n: r.get(n) for n in ("title", "url", "snippet")} for r in search(question)], None
        except Exception as error:
            return [], f"{type(error).__name__}: {error}"

    def run(frames):
        for pdf in frames:
            pdf[["results", "error"]] = pd.DataFrame([one(q) for q in pdf["question"]], columns=["results", "error"], index=pdf.index)
            yield pdf

    schema = f"{', '.join(f'`{n}` {t}' for n, t in asked.dtypes)}, results array<struct<title: string, url: string, snippet: string>>, error string"
    found = asked.mapInPandas(run, schema)
    nested = found.select("run_id", "finding_index", F.posexplode("results").alias("source_index", "r"))
    sources = nested.select("run_id", "finding_index", (F.col("source_index") + 1).alias("source_index"), "r.*")
    return found.drop("results"), sources


Strategy = Callable[..., tuple[DataFrame, DataFrame]]
_strategies: dict[str, tuple[Strategy, str, bool]] = {}


def register_strategy(name: str, run: Strategy, label: str = "", reads: bool = False) -> None:
    """A collection strategy by name: (queries, ask, search, iterations, count) -> findings, sources.

    One that ``reads`` has pages read in each round, and sources judged after the last.
    """
    _strategies[name] = (run, label or name, reads)


def list_strategies() -> list[tuple[str, str]]:
    return sorted((name, label) for name, (_, label, _) in _strategies.items())


def run_rounds(
    queries: DataFrame, strategy: str, ask: Callable, search: Callable, iterations: int = 2, count: int = 3,
    read: Callable[[DataFrame], DataFrame] | None = None, judge: Callable[[DataFrame], DataFrame] | None = None,
    per_finding: int = 8, total: int = 24, max_sources: int = 30,
) -> tuple[DataFrame, DataFrame]:
    """Findings with ``iteration`` and sources of a strategy over all ``queries`` (run_id, query) at once.

    ``ask(queries with context, count)`` gives run_id, position and question; ``search(questions)`` what
    ``search_round`` gives. The loop is over rounds; each round is a job over all runs.

    Of strategies that read: ``read(urls)`` gives the page text of a round's URLs, which goes to the sources that
    ``enrichment_candidates`` chooses in that round, and so into the next one's context. ``judge(sources)`` gives
    decisions for all sources; those of the run's ``max_sources`` best stay, and findings that keep one or failed.
    """
    if strategy not in _strategies:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(n for n, _ in list_strategies())}")
    run, _, reads = _strategies[strategy]
    if not reads:
        return run(queries, ask, search, iterations, count)
    findings, sources = run(queries, ask, _reading(search, read, per_finding, total) if read else search, iterations, count)
    if judge is None:
        return findings, sources
    kept = filter_by_relevance(sources, judge(sources), max_sources)
    return findings_left(findings, kept), kept


def _reading(search: Callable, read: Callable[[DataFrame], DataFrame], per_finding: int, total: int) -> Callable:
    """``search`` with the pages read of the sources that a round chooses."""

    def searched(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        findings, sources = search(questions)
        sources = written(_bare(sources), "round-sources")
        pages = read(sources.where(filled("url").isNotNull()).select("url").distinct())
        pages = written(pages, "round-pages")
        status = pages.groupBy("url").agg(F.when(F.bool_or(F.col("status") == "ok"), "ok").otherwise(F.min("status")).alias("fetch_status"))
        rows = sources.drop("fetch_status").join(status, "url", "left").withColumn("iteration", F.lit(1))
        chosen = enrichment_candidates(rows, per_finding, total).drop("iteration").withColumn("fetch_status", F.lit(None).cast("string"))
        return findings, enrich_sources(chosen, pages, chosen="chosen").drop("chosen")

    return searched


def _questions(queries: DataFrame, more: DataFrame | None, with_query: bool) -> DataFrame:
    own = queries.select("run_id", F.lit(0).alias("position"), F.col("query").alias("question"))
    if more is None:
        return own
    more = more.select("run_id", (F.col("position") + 1).cast("int").alias("position"), "question")
    return own.unionByName(more) if with_query else more


class Rounds:
    """A strategy of rounds, whose questions after the first one follow from the sources found so far.

    ``context`` (None: there is no second round) makes the context of each run from its sources; a round asks ``most`` questions at most.
    """

    def __init__(self, context: Callable[[DataFrame], DataFrame] | None = None, most: int | None = None):
        self.context, self.most = context, most

    def __call__(self, queries, ask, search, iterations, count):
        return _together([(self, queries)], ask, search, iterations, count)


def _together(parts: list[tuple[Rounds, DataFrame]], ask: Callable, search: Callable, iterations: int, count: int) -> tuple[DataFrame, DataFrame]:
    """Findings and sources of several strategies, each over queries of its own. A round is one search for all of them."""
    rounds, found = [], None
    for i in range(iterations if any(part.context for part, _ in parts) else 1):
        asked = None
        for part, queries in parts:
            if i and part.context is None:
                continue
            told = queries.withColumn("context", F.lit(""))
            if i:
                own = found if len(parts) == 1 else found.join(queries.select("run_id"), "run_id", "left_semi")
                told = queries.join(part.context(own), "run_id", "left").fillna("", ["context"])
            more = _questions(queries, ask(told, min(count, part.most or count)), with_query=not i)
            asked = more if asked is None else asked.unionByName(more)
        findings, sources = search(asked)
        # findings are numbered on from the rounds before
        if rounds:
            last = rounds[0]
            for df in rounds[1:]:
                last = last.unionByName(df)
            ahead = last.groupBy("run_id").agg(F.max("finding_index").alias("_ahead"))
            shift = lambda df, ahead=ahead: df.join(ahead, "run_id", "left").withColumn("finding_index", F.col("finding_index") + F.coalesce("_ahead", F.lit(0))).drop("_ahead")
            findings, sources = shift(findings), shift(sources)
        findings, sources = written(findings, "findings"), written(sources, "sources")
        rounds.append(findings)
        found = sources if found is None else found.unionByName(sources)
    return union_rounds(rounds), found


def run_strategies(queries: DataFrame, ask: Callable, search: Callable, iterations: int = 2, count: int = 3) -> tuple[DataFrame, DataFrame]:
    """``run_rounds`` over ``queries`` (run_id, query, strategy), each under its own strategy; pages are neither read nor judged.

    Strategies that are ``Rounds`` share the search of a round, so that its pages are gone through once for all of them.
    Queries of no known strategy are an error.
    """
    names = [name for name, _ in list_strategies()]
    unknown = F.raise_error(F.concat(F.lit("unknown strategy "), F.coalesce("strategy", F.lit("null"))))
    queries = written(queries.withColumn("strategy", F.when(F.col("strategy").isin(names), F.col("strategy")).otherwise(unknown)), "queries")
    of = {name: (_strategies[name][0], queries.where(F.col("strategy") == name).select("run_id", "query")) for name in names}
    made = [_together([x for x in of.values() if isinstance(x[0], Rounds)], ask, search, iterations, count)]
    made += [run(own, ask, search, iterations, count) for run, own in of.values() if not isinstance(run, Rounds)]
    findings, sources = made[0]
    for more in made[1:]:
        findings, sources = findings.unionByName(more[0], allowMissingColumns=True), sources.unionByName(more[1], allowMissingColumns=True)
    return findings, sources


def _bare(sources: DataFrame) -> DataFrame:
    for name in ("summary", "content", "snippet"):
        if name not in sources.columns:
            sources = sources.withColumn(name, F.lit(None).cast("string"))
    return sources


register_strategy("rapid", Rounds(most=3), "one round of the query and a few follow-ups")
register_strategy("parallel", Rounds(lambda s: recent_context(_bare(s), 12, None)), "rounds with the last 12 sources as context")
register_strategy("source-based", Rounds(lambda s: recent_context(_bare(s), 30, 500)), "rounds with evidence of the last 30 sources as context", reads=True)


def label_of(strategy: Column) -> Column:
    """A strategy's label; the name where it has none."""
    known = F.create_map(*[F.lit(x) for pair in list_strategies() for x in pair])
    return F.coalesce(known[strategy], strategy)
