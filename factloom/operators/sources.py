"""Search results as source rows: normalising, labelling, deduplicating, ranking and choosing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import blank, evidence, filled, first_text, trimmed, unused

ITEM = """struct<title: string, name: string, url: string, link: string, href: string, permalink: string, tweetUrl: string,
  excerpt: string, snippet: string, desc: string, description: string, content: string, selftext: string,
  author: string, subredditPrefixed: string, score: string, platform: string, engine: string>"""
#: Where a payload may hold its items, in order, and how platforms are told from a skill's name.
PLACES = ("items", "result.items", "result.tweets", "result.notes")
PLATFORMS = (("x-ops", "x"), ("zhihu", "zhihu"), ("xiaohongshu", "xhs"), ("xhs", "xhs"), ("reddit", "reddit"))
BODY = ("excerpt", "snippet", "desc", "description", "content", "selftext")
LINKS = ("url", "link", "href", "permalink", "tweetUrl")


def normalize_web_results(payloads: DataFrame, max_results: int = 8, engine: str = "web", payload: str = "payload") -> DataFrame:
    """Other columns, ``source_index``, title, url, snippet, engine. The first ``max_results`` are taken, then empty ones dropped."""
    keep = [c for c in payloads.columns if c != payload]
    results = F.from_json(payload, "results array<struct<title: string, url: string, content: string, snippet: string>>")["results"]
    rows = payloads.select(*keep, F.posexplode(F.slice(results, 1, max_results)).alias("source_index", "r"))
    url, snippet = F.col("r.url"), filled("r.content", "r.snippet")
    rows = rows.where(filled(url).isNotNull() | snippet.isNotNull())
    return rows.select(
        *keep, (F.col("source_index") + 1).alias("source_index"), filled("r.title", url, F.lit("Untitled source")).alias("title"),
        F.coalesce(url, F.lit("")).alias("url"), F.coalesce(snippet, F.lit("")).alias("snippet"), F.lit(engine).alias("engine"),
    )


def platform_of(skill: Column) -> Column:
    name = F.lower(F.coalesce(skill, F.lit("")))
    found = F.lit(None).cast("string")
    for part, platform in reversed(PLATFORMS):
        found = F.when(F.contains(name, F.lit(part)), platform).otherwise(found)
    return F.coalesce(found, F.nullif(name, F.lit("")), F.lit("unknown"))


def label_engine(items: DataFrame, skill: str = "skill", prefix: str = "skill") -> DataFrame:
    """``items`` with ``platform`` and ``engine`` = prefix:platform, from the skill that gave them."""
    return items.withColumn("platform", platform_of(F.col(skill))).withColumn("engine", F.concat_ws(":", F.lit(prefix), "platform"))


def normalize_platform_items(payloads: DataFrame, max_results: int = 8, payload: str = "payload", skill: str = "skill", prefix: str = "skill") -> DataFrame:
    """Other columns, ``source_index``, title, url, snippet and engine of a skill's items; empty ones are dropped, then the first taken.

    Items are the first non-empty list of ``PLACES``. A top-level item that has a title or URL and a snippet,
    platform or engine stands as it is; of others the first non-blank field of each kind is taken, and author,
    subreddit and score are lines of the snippet.
    """
    keep = [c for c in payloads.columns if c != payload]
    whole = F.from_json(payload, f"items array<{ITEM}>, result struct<items: array<{ITEM}>, tweets: array<{ITEM}>, notes: array<{ITEM}>>")
    rows = payloads.withColumn("_p", whole)
    lists = [F.col(f"_p.{place}") for place in PLACES]
    top = F.size(F.coalesce(lists[0], F.array().cast(f"array<{ITEM}>"))) > 0
    chosen = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    rows = rows.withColumn("_top", top).select(*keep, "_top", F.posexplode(chosen).alias("_at", "i"))
    platform = F.coalesce(filled("i.platform"), platform_of(F.col(skill)))
    unified = F.col("_top") & filled("i.title", "i.url").isNotNull() & F.coalesce("i.snippet", "i.platform", "i.engine").isNotNull()
    author = F.from_json("i.author", "name string, username string")
    named = F.when(F.col("i.author").startswith("{"), F.concat_ws(" ", filled(author["name"]), filled(author["username"]))).otherwise(F.col("i.author"))
    line = lambda label, value: F.when(filled(value).isNotNull(), F.concat(F.lit(f"{label}: "), value))
    body = F.nullif(first_text(*[f"i.{c}" for c in BODY]), F.lit(""))
    raw = F.concat_ws("\n", body, line("Author", named), line("Subreddit", F.col("i.subredditPrefixed")), line("Score", F.col("i.score")))
    rows = rows.select(
        *keep, "_at",
        F.when(unified, F.coalesce("i.title", F.lit(""))).otherwise(filled(first_text("i.title", "i.name", "i.url"), F.lit("Untitled source"))).alias("title"),
        F.when(unified, F.coalesce("i.url", F.lit(""))).otherwise(first_text(*[f"i.{c}" for c in LINKS])).alias("url"),
        F.when(unified, F.coalesce("i.snippet", F.lit(""))).otherwise(raw).alias("snippet"),
        F.when(unified, F.coalesce(filled("i.engine"), F.concat_ws(":", F.lit(prefix), platform)))
        .otherwise(F.concat_ws(":", F.lit(prefix), platform_of(F.col(skill)))).alias("engine"),
    )
    return _first(rows, keep, max_results)


def normalize_unified_items(payloads: DataFrame, max_results: int = 8, payload: str = "payload", prefix: str = "skill") -> DataFrame:
    """As ``normalize_platform_items``, for top-level items of unknown skill."""
    keep = [c for c in payloads.columns if c != payload]
    items = F.from_json(payload, f"items array<{ITEM}>")["items"]
    rows = payloads.select(*keep, F.posexplode(items).alias("_at", "i"))
    by = F.when(filled("i.platform").isNotNull(), F.concat_ws(":", F.lit(prefix), "i.platform")).otherwise(prefix)
    rows = rows.select(
        *keep, "_at", filled(first_text("i.title", "i.url"), F.lit("Untitled source")).alias("title"), first_text("i.url", "i.link", "i.href").alias("url"),
        first_text("i.snippet", "i.excerpt", "i.desc", "i.description", "i.content").alias("snippet"), filled(first_text("i.engine"), by).alias("engine"),
    )
    return _first(rows, keep, max_results)


def _first(rows: DataFrame, keep: list[str], most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keep).orderBy("_at"))
    rows = rows.where((F.col("url") != "") | (F.col("snippet") != "")).withColumn("source_index", place)
    return rows.where(F.col("source_index") <= most).select(*keep, "source_index", "title", "url", "snippet", "engine")


def classify_urls(sources: DataFrame, suffixes: tuple[str, ...], kinds: tuple[tuple[str, str], ...], url: str = "url") -> DataFrame:
    """``sources`` with ``host``, ``on_host`` (a suffix fits) and ``kind``: the first (name, pattern) that fits the URL; else null."""
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    fits, kind = F.lit(False), F.lit(None).cast("string")
    for s in suffixes:
        fits = fits | F.coalesce((host == s) | host.endswith(f".{s}"), F.lit(False))
    for name, pattern in reversed(kinds):
        kind = F.when(F.col(url).rlike(f"(?i){pattern}"), name).otherwise(kind)
    return sources.withColumns({"host": host, "on_host": fits, "kind": kind})


def explode_findings(runs: DataFrame, findings: str = "findings") -> DataFrame:
    """run_id, ``seq`` (from 1), question, iteration, error, sources and ``raw`` of each nested finding; missing fields are null."""
    rows = runs.select("run_id", F.posexplode_outer(findings).alias("seq", "f"))
    fields = {f.name for f in rows.schema["f"].dataType.fields}
    take = lambda n, kind: F.col(f"f.{n}") if n in fields else F.lit(None).cast(kind)
    parts = (("question", "string"), ("iteration", "int"), ("error", "string"), ("sources", "array<string>"))
    return rows.select("run_id", (F.col("seq") + 1).alias("seq"), *[take(n, k).alias(n) for n, k in parts], F.to_json("f").alias("raw"))


def flatten_findings(findings: DataFrame) -> DataFrame:
    """run_id, finding_index, source_index (from 1) and the fields of each nested source."""
    rows = findings.select("run_id", F.col("seq").alias("finding_index"), F.posexplode("sources").alias("source_index", "s"))
    return rows.select("run_id", "finding_index", (F.col("source_index") + 1).alias("source_index"), "s.*")


def reconstruct_findings(rows: DataFrame, schema: str) -> DataFrame:
    """run_id and ``findings`` in order: of ``raw`` where it is a JSON object, else of the columns."""
    told = F.from_json("raw", schema)
    built = F.from_json(F.to_json(F.struct(*[c for c in rows.columns if c not in ("run_id", "seq", "raw")])), schema)
    one = F.when(F.col("raw").startswith("{"), told).otherwise(built)
    nested = F.array_sort(F.collect_list(F.struct("seq", one.alias("f"))))
    return rows.groupBy("run_id").agg(F.transform(nested, lambda x: x["f"]).alias("findings"))


def add_dedup_id(sources: DataFrame) -> DataFrame:
    """``dedup_id``: the trimmed URL, else a hash of title, snippet and content, else ``unknown-<index>``."""
    part = lambda c: F.coalesce(c, F.lit(""))
    any_text = filled("title", "snippet", "content").isNotNull()
    digest = F.when(any_text, F.sha2(F.concat_ws(":", part("title"), part("snippet"), part("content")), 256))
    number = F.concat(F.lit("unknown-"), F.col("source_index").cast("string"))
    return sources.withColumn("dedup_id", F.coalesce(F.nullif(trimmed("url"), F.lit("")), digest, number))


def dedupe_sources(sources: DataFrame) -> DataFrame:
    """The first source of each URL (else title and snippet) of a run, by finding and place."""
    key = F.coalesce(filled("url"), F.concat_ws(":", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    n = unused(sources, "n")
    first = Window.partitionBy("run_id", key).orderBy("finding_index", "source_index")
    return sources.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).drop(n)


def clean_questions(questions: DataFrame, order: str = "position") -> DataFrame:
    """Trimmed questions of each run without blank ones and later repeats."""
    rows = questions.withColumn("question", trimmed("question")).where("question <> ''")
    n = unused(rows, "n")
    first = Window.partitionBy("run_id", "question").orderBy(order)
    return rows.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).drop(n)


def question_counts(questions: DataFrame) -> DataFrame:
    """Different non-blank questions of each run."""
    return questions.groupBy("run_id").agg(F.countDistinct(F.when(~blank("question"), trimmed("question"))).alias("n_questions"))


def union_rounds(rounds: list[DataFrame]) -> DataFrame:
    """The rounds' findings with ``iteration`` from 1."""
    tagged = [df.withColumn("iteration", F.lit(i)) for i, df in enumerate(rounds, 1)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def with_evidence(sources: DataFrame) -> DataFrame:
    return sources.withColumn("evidence", evidence())


def complete_sources(sources: DataFrame) -> DataFrame:
    """Sources whose title, URL and evidence are all there."""
    return with_evidence(sources).where(~blank("title") & ~blank("url") & ~blank("evidence"))


def top_relevant(scored: DataFrame, n: int) -> DataFrame:
    """Of each run the n kept sources with the highest scores (null: 0); ties by place."""
    best = Window.partitionBy("run_id").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "finding_index", "source_index")
    return scored.where(F.coalesce("keep", F.lit(True))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def last_sources(sources: DataFrame, n: int) -> DataFrame:
    """Of each run the last n sources, numbered in order."""
    back = Window.partitionBy("run_id").orderBy(F.desc("finding_index"), F.desc("source_index"))
    order = Window.partitionBy("run_id").orderBy("finding_index", "source_index")
    place = unused(sources, "place")
    kept = sources.withColumn(place, F.row_number().over(back)).where(F.col(place) <= n).drop(place)
    return kept.withColumn("number", F.row_number().over(order))


def interleave(batches: DataFrame, max_results: int = 8, question: str = "question") -> DataFrame:
    """Round robin over a question's batches, ``batch`` in turn: ``position`` (from 1) of each item that is taken.

    In its turn a batch gives its next item (by item_index) whose trimmed URL hasn't been given; items without URL are
    never repeats. Of a batch only the first 2 x ``max_results`` different ones can matter: it gives that many at
    most, and passes over no more that others gave. The turns are folded over those in one expression.
    """
    url, n = F.coalesce(trimmed("url"), F.lit("")), unused(batches, "n")
    rows = batches.select(question, "batch", url.alias("u"), F.col("item_index").alias("i"), F.struct(*batches.columns).alias("row"))
    order = ("i", F.to_json("row"))
    first = F.row_number().over(Window.partitionBy(question, "batch", "u").orderBy(*order))
    rows = rows.where("u <> ''").withColumn(n, first).where(F.col(n) == 1).unionByName(rows.where("u = ''").withColumn(n, F.lit(1)))
    early = F.row_number().over(Window.partitionBy(question, "batch").orderBy(*order))
    rows = rows.withColumn("i", early).where(F.col("i") <= 2 * max_results)
    queues = rows.groupBy(question, "batch").agg(F.array_sort(F.collect_list(F.struct("i", "u", "batch", "row"))).alias("queue"))
    turns = queues.groupBy(question).agg(F.array_sort(F.collect_list(F.struct("batch", "queue"))).alias("turns"))
    # each round every batch has its turn
    turns = turns.withColumn("turns", F.flatten(F.array_repeat(F.transform("turns", lambda t: t["queue"]), max_results)))
    kind = turns.schema["turns"].dataType.elementType.simpleString()

    def turn(taken: Column, queue: Column) -> Column:
        given = lambda x: F.exists(taken, lambda t: ((x["u"] != "") & (t["u"] == x["u"])) | (t["batch"].eqNullSafe(x["batch"]) & (t["i"] == x["i"])))
        return F.when(F.size(taken) < max_results, F.concat(taken, F.slice(F.filter(queue, lambda x: ~given(x)), 1, 1))).otherwise(taken)

    taken = turns.select(F.posexplode(F.aggregate("turns", F.array().cast(kind), turn)).alias("position", "t"))
    return taken.select("t.row.*", (F.col("position") + 1).alias("position"))


def enrichment_candidates(sources: DataFrame, per_finding: int = 8, total: int = 24) -> DataFrame:
    """Sources whose pages are to be read: ``chosen`` for each source of a run's iteration, in order.

    Blank URLs and those chosen before are passed over; a finding gives ``per_finding`` at most, and none once
    the findings before it have given ``total`` pages that could be read (``fetch_status`` ok). The choice
    depends on the ones before, so a run's iteration is folded in order, over what can matter: of a finding each URL
    once, and none after ``per_finding`` that no earlier finding has.
    """
    group = ["run_id", "iteration"]
    at = [*group, "finding_index"]
    same, sure, known, mark = (unused(sources, c) for c in ("same", "sure", "u", "mark"))
    rows = sources.withColumn(known, F.coalesce(trimmed("url"), F.lit("")))
    first = Window.partitionBy(*at, known).orderBy("source_index", F.coalesce("fetch_status", F.lit("")))
    rows = rows.withColumn(same, F.row_number().over(first))
    one = rows.where((F.col(known) != "") & (F.col(same) == 1)).select(*at, "source_index", F.col(known).alias("u"), (F.col("fetch_status") == "ok").alias("ok"))
    one = one.withColumn("sure", (F.min("finding_index").over(Window.partitionBy(*group, "u")) == F.col("finding_index")).cast("int"))
    before = Window.partitionBy(*at).orderBy("source_index", "u").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("sure", F.coalesce(F.sum("sure").over(before), F.lit(0))).where(F.col("sure") < per_finding)
    lists = one.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("source_index", "u", F.coalesce("ok", F.lit(False)).alias("ok"), "finding_index"))).alias("items"))
    lists = lists.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("finding_index", "items"))).alias("findings"))
    kind = lists.schema["findings"].dataType.elementType["items"].dataType.simpleString()

    def choose(chosen: Column, finding: Column) -> Column:
        new = F.filter(finding["items"], lambda x: ~F.exists(chosen, lambda c: c["u"] == x["u"]))
        read = F.size(F.filter(chosen, lambda c: c["ok"]))
        return F.when(read < total, F.concat(chosen, F.slice(new, 1, per_finding))).otherwise(chosen)

    chosen = lists.select(*group, F.explode(F.aggregate("findings", F.array().cast(kind), choose)).alias("c"))
    chosen = chosen.select(*group, "c.finding_index", F.col("c.source_index").alias("source_index"), F.col("c.u").alias(known), F.lit(True).alias(mark))
    rows = rows.join(chosen, [*at, "source_index", known], "left")
    return rows.select(*sources.columns, (F.coalesce(mark, F.lit(False)) & (F.col(same) == 1)).alias("chosen"))
