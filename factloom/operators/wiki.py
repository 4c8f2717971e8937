"""Archived sources as linked Markdown pages: what changed is compiled anew, and all pages are checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import SPACE, blank, escape_links, file_name, filled, ordered, page_link, title_case, trimmed, yaml_scalar
from factloom.operators.archive import strip_archive_fields
from factloom.operators.claims import extract_bullet_claims
from factloom.operators.pages import extract_links, read_frontmatter, resolve_links
from factloom.sources.scratch import written


def load_wiki_sources(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources in order of their index (missing ones last, then numbered on) with the run's query, strategy and time."""
    order = Window.partitionBy("run_id").orderBy(F.col("source_index").asc_nulls_last(), "url", "title")
    rows = strip_archive_fields(sources, wiki=True).withColumn("_n", F.row_number().over(order))
    rows = rows.withColumn("source_index", F.coalesce(F.col("source_index").cast("int"), F.col("_n"))).drop("_n")
    told = runs.select("run_id", "query", "strategy", F.col("archived_at").alias("observed_at"))
    return rows.join(told, "run_id").withColumn("tags", F.array_compact(F.array(F.lit("source"), "strategy")))


def missing_runs(ids: DataFrame, runs: DataFrame) -> DataFrame:
    """Ids without a run, with an error."""
    return ids.join(runs, "run_id", "left_anti").select("run_id", F.lit("run not found").alias("error"))


def run_reports(runs: DataFrame, reports: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``report`` of each run: in the archive, else of its file (run_id, text), else ''."""
    rows = runs.select("run_id").join(reports.select("run_id", "report"), "run_id", "left")
    if files is None:
        return rows.select("run_id", F.coalesce("report", F.lit("")).alias("report"))
    rows = rows.join(files.select("run_id", F.col("text").alias("_text")), "run_id", "left")
    return rows.select("run_id", F.coalesce(filled("report", "_text"), F.lit("")).alias("report"))


def normalize_wiki_sources(sources: DataFrame) -> DataFrame:
    """Every field of a wiki source with its default; id = run/source-NNN. A given ``has_content`` or ``content_length`` holds."""
    rows = sources
    kinds = {"title": "string", "url": "string", "snippet": "string", "content": "string", "summary": "string", "query": "string", "engine": "string"}
    for name, kind in (kinds | {"kind": "string", "strategy": "string", "fetch_status": "string", "fetch_error": "string", "has_content": "boolean", "content_length": "int", "tags": "array<string>", "artifact_paths": "map<string,string>", "observed_at": "timestamp"}).items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    text = lambda c: F.coalesce(c, F.lit(""))
    content = F.coalesce("content", "summary", F.lit(""))
    index = F.col("source_index").cast("int")
    return rows.select(
        F.format_string("%s/source-%03d", F.col("run_id").cast("string"), index).alias("id"), F.coalesce("kind", F.lit("research-source")).alias("kind"),
        "run_id", index.alias("source_index"), text("title").alias("title"), text("url").alias("url"), text("snippet").alias("snippet"),
        content.alias("content"), text("query").alias("query"), text("strategy").alias("strategy"), text("engine").alias("engine"), "fetch_status", "fetch_error",
        F.coalesce("tags", F.array(F.lit("source"))).alias("tags"), F.coalesce("artifact_paths", F.create_map().cast("map<string,string>")).alias("artifact_paths"),
        "observed_at", F.coalesce("has_content", trimmed(content) != "").alias("has_content"), F.coalesce(F.col("content_length").cast("int"), F.length(content)).alias("content_length"),
    )


def group_sources(wiki_sources: DataFrame) -> DataFrame:
    """Of each run its sources in order, nested."""
    fields = [c for c in wiki_sources.columns if c not in ("run_id", "source_index", "artifact_paths")]
    nested = F.array_sort(F.collect_list(F.struct("source_index", *fields)))
    return wiki_sources.groupBy("run_id").agg(nested.alias("sources"), F.count("*").alias("n_sources"))


def source_hashes(wiki_sources: DataFrame) -> DataFrame:
    """``hash`` of title, URL, snippet, content, run and query."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("title", "url", "snippet", "content", "run_id", "query")]
    return wiki_sources.withColumn("hash", F.sha2(F.to_json(F.struct(*parts)), 256))


def plan_recompile(hashed: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """``recompile``: the source isn't in the manifest, or its hash has changed, or ``force``."""
    rows = hashed.join(manifest.select(F.col("source_id").alias("id"), F.col("hash").alias("_old")), "id", "left")
    return rows.withColumn("recompile", F.lit(force) | ~F.col("hash").eqNullSafe(F.col("_old"))).drop("_old")


def topic_of(query: Column, run_id: Column) -> Column:
    return title_case(filled(query, run_id.cast("string")))


def source_path(run_id: Column, index: Column, title: Column) -> Column:
    name = F.concat(F.format_string("Source %03d - ", index.cast("int")), filled(title, F.lit("Untitled")))
    return F.concat(F.lit("Sources/"), file_name(run_id.cast("string"), 80), F.lit("/"), file_name(name, 100), F.lit(".md"))


def topic_path(topic: Column) -> Column:
    return F.concat(F.lit("Topics/"), file_name(topic), F.lit(".md"))


def claims_path(topic: Column) -> Column:
    return F.concat(F.lit("Claims/"), file_name(F.concat(topic, F.lit(" Claims"))), F.lit(".md"))


def page(front: dict[str, Column], body: Column) -> Column:
    """Front matter (text, or arrays as lists; missing values are ``null``) and body."""
    lines = []
    for name, value in front.items():
        if name in LISTS:
            items = F.transform(value, lambda x: F.concat(F.lit("\n  - "), yaml_scalar(x)))
            lines.append(F.concat(F.lit(f"{name}:"), F.array_join(items, "")))
        else:
            lines.append(F.concat(F.lit(f"{name}: "), F.when(value.isNull(), "null").otherwise(yaml_scalar(value))))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), trimmed(body), F.lit("\n"))


LISTS = ("tags", "sources", "aliases")


def compile_source_pages(planned: DataFrame, day: str) -> DataFrame:
    """``path``, ``type``, run_id, ``source_id``, ``hash``, ``topic`` and ``content`` of a page for each source to be recompiled."""
    c = F.col
    rows = planned.where("recompile").withColumn("topic", topic_of(c("query"), c("run_id")))
    paths = F.transform(F.filter(F.map_entries("artifact_paths"), lambda e: filled(e["value"]).isNotNull()), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": `"), e["value"], F.lit("`")))
    own = lambda text, value: F.concat(F.lit(text), value)
    body = F.concat_ws(
        "\n", own("# ", filled("title", F.lit("Untitled Source"))), F.lit("\n## Metadata\n"), own("- URL: ", filled("url", F.lit("(none)"))),
        own("- Research: ", c("run_id").cast("string")), own("- Query: ", filled("query", F.lit("(none)"))),
        F.when(filled("engine").isNotNull(), own("- Engine: ", c("engine"))), F.lit("\n## Evidence\n"),
        F.when(filled("snippet").isNotNull(), own("> ", escape_links("snippet"))).otherwise("_No snippet._"), F.lit(""),
        F.when((c("content") != "") & (c("content") != c("snippet")), own("### Content\n\n", escape_links(F.substring("content", 1, 4000)))),
        F.lit("\n## Artifact Paths\n"), F.nullif(F.array_join(F.array_sort(paths), "\n"), F.lit("")), F.lit("\n## Related\n"),
        own("- Topic: ", page_link(topic_path(c("topic")))),
    )
    front = {
        "type": F.lit("source"), "title": filled("title", F.concat(F.lit("Source "), c("source_index").cast("string"))),
        "researchId": c("run_id").cast("string"), "sourceId": c("id"), "url": F.nullif("url", F.lit("")),
        "tags": F.array_distinct(F.array_prepend("tags", "source")), "topic": c("topic"), "updated": F.lit(day),
    }
    path = source_path(c("run_id"), c("source_index"), c("title"))
    return rows.select(path.alias("path"), F.lit("source").alias("type"), "run_id", c("id").alias("source_id"), "hash", "topic", page(front, body).alias("content"))


def _links(wiki_sources: DataFrame, label: Column, name: str) -> DataFrame:
    link = F.concat(F.lit("- "), page_link(source_path(F.col("run_id"), F.col("source_index"), F.col("title")), label))
    return wiki_sources.groupBy("run_id").agg(
        F.array_join(ordered(link, "source_index"), "\n").alias(name), ordered(F.col("id"), "source_index").alias("ids"),
        F.count("*").alias("n_sources"), F.min_by("query", "source_index").alias("query"), F.max("observed_at").alias("observed_at"),
    )


def _last_of_topic(rows: DataFrame) -> DataFrame:
    """Of runs with one topic the last archived one makes the page."""
    last = Window.partitionBy("path").orderBy(F.col("observed_at").desc_nulls_last(), F.desc("run_id"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def compile_topic_pages(wiki_sources: DataFrame, reports: DataFrame, day: str) -> DataFrame:
    """path, type, run_id, topic, n_sources and content of a page for each topic."""
    c = F.col
    name = filled("title", F.concat(F.lit("Source "), c("source_index").cast("string")))
    rows = _links(wiki_sources, name, "links").join(reports, "run_id", "left").withColumn("topic", topic_of(c("query"), c("run_id")))
    lines = F.filter(F.split(F.coalesce("report", F.lit("")), "\n"), lambda x: ~blank(x) & ~x.startswith("#"))
    summary = filled(F.substring(trimmed(F.get(lines, F.lit(0))), 1, 800), F.lit("_Compiled from research sources._"))
    body = F.concat_ws(
        "\n", F.concat(F.lit("# "), "topic"), F.lit("\n## Summary\n"), summary, F.lit("\n## Related Sources\n"), c("links"), F.lit("\n## Claims\n"),
        F.concat(F.lit("- "), page_link(claims_path(c("topic")), F.concat("topic", F.lit(" Claims")))),
    )
    words = F.slice(F.filter(F.split(F.lower("topic"), f"{SPACE}+"), lambda w: w != ""), 1, 3)
    front = {"type": F.lit("topic"), "title": c("topic"), "aliases": F.array("topic"), "tags": F.array_prepend(words, "topic"), "sources": c("ids"), "updated": F.lit(day)}
    rows = rows.withColumn("path", topic_path(c("topic"))).withColumn("content", page(front, body))
    return _last_of_topic(rows).select("path", F.lit("topic").alias("type"), "run_id", "topic", "n_sources", "content")


def compile_claim_pages(reports: DataFrame, wiki_sources: DataFrame, day: str) -> DataFrame:
    """path, type, run_id, topic, ``claim_count`` and content: a run's bullet claims, numbered, and its sources."""
    c = F.col
    mark = F.when(c("has_citation"), " _(has citation)_").otherwise(" _(no citation)_")
    shown = F.concat(c("claim_index").cast("string"), F.lit(". **"), filled("section", F.lit("General")), F.lit("**: "), c("text"), mark)
    told = extract_bullet_claims(reports).groupBy("run_id").agg(F.array_join(ordered(shown, "claim_index"), "\n").alias("told"), F.count("*").alias("claim_count"))
    rows = _links(wiki_sources, filled("title", "id"), "links").join(told, "run_id", "left").fillna(0, ["claim_count"])
    rows = rows.withColumn("topic", topic_of(c("query"), c("run_id")))
    body = F.concat_ws(
        "\n", F.concat(F.lit("# "), "topic", F.lit(" Claims")), F.concat(F.lit("\nTopic: "), page_link(topic_path(c("topic")))),
        F.lit("\n## Extracted Claims\n"), F.coalesce("told", F.lit("_No extractable claims from report._")), F.lit("\n## Source Index\n"), c("links"),
    )
    front = {"type": F.lit("claim"), "topic": c("topic"), "tags": F.array(F.lit("claim")), "claimCount": c("claim_count").cast("string"), "updated": F.lit(day)}
    rows = rows.withColumn("path", claims_path(c("topic"))).withColumn("content", page(front, body))
    return _last_of_topic(rows).select("path", F.lit("claim").alias("type"), "run_id", "topic", "claim_count", "content")


def compile_index_pages(topics: DataFrame, day: str) -> DataFrame:
    """Home and Map of Content over this compile's topics (topic, n_sources); both are one text each."""
    c = F.col
    link = page_link(topic_path(c("topic")), c("topic"))
    entry = F.concat(F.lit("### "), link, F.lit("\n\n- Sources: "), c("n_sources").cast("string"), F.lit("\n- Claims: "), page_link(claims_path(c("topic")), F.lit("Claims")), F.lit("\n"))
    both = topics.agg(F.array_join(ordered(F.concat(F.lit("- "), link), "topic"), "\n").alias("home"), F.array_join(ordered(entry, "topic"), "\n").alias("map"))
    front = lambda kind, title: {"type": F.lit(kind), "title": F.lit(title), "updated": F.lit(day)}
    home = F.concat(F.lit("# Home\n\n- [[Map of Content|Map of Content]]\n\n## Topics\n\n"), "home")
    contents = F.concat(F.lit("# Map of Content\n\n## Topics\n\n"), "map")
    pages = F.array(
        F.struct(F.lit("Home.md").alias("path"), F.lit("home").alias("type"), page(front("home", "Home"), home).alias("content")),
        F.struct(F.lit("Map of Content.md").alias("path"), F.lit("moc").alias("type"), page(front("moc", "Map of Content"), contents).alias("content")),
    )
    return both.select(F.explode(pages).alias("p")).select("p.*")


def update_manifest(manifest: DataFrame, compiled: DataFrame, at: Column) -> DataFrame:
    """source_id, hash, pages, run_id and updated_at, with the sources just compiled in place of what they were."""
    new = compiled.select("source_id", "hash", F.array("path").alias("pages"), "run_id", at.alias("updated_at"))
    best = Window.partitionBy("source_id").orderBy(F.desc("_new"), F.desc("updated_at"))
    both = manifest.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_new")


def compile_wiki(wiki_sources: DataFrame, reports: DataFrame, manifest: DataFrame, day: str, force: bool = False) -> dict[str, DataFrame]:
    """``pages``, ``manifest``, ``topics`` and ``summary`` (compiled, skipped, n_topics, n_pages) of a compile."""
    planned = plan_recompile(source_hashes(wiki_sources), manifest, force)
    sources = compile_source_pages(planned, day)
    topics = written(compile_topic_pages(wiki_sources, reports, day), "topics")  # four of the results ask for them
    claims = compile_claim_pages(reports, wiki_sources, day)
    index = compile_index_pages(topics.select("topic", "n_sources"), day)
    pages = sources.select("path", "type", "content")
    for more in (topics, claims, index):
        pages = pages.unionByName(more.select("path", "type", "content"))
    counts = planned.agg(F.count_if("recompile").alias("compiled"), F.count_if(~F.col("recompile")).alias("skipped"))
    summary = counts.crossJoin(topics.agg(F.count("*").alias("n_topics")))  # two single rows
    summary = summary.withColumn("n_pages", F.col("compiled") + 2 * F.col("n_topics") + 2)
    known = topics.select("topic", F.array("path", claims_path(F.col("topic"))).alias("pages"))
    return {"pages": pages, "manifest": update_manifest(manifest, sources, F.current_timestamp()), "topics": known, "summary": summary}


def missing_manifest_pages(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """``source_id`` and ``path`` of pages in the manifest that aren't there."""
    named = manifest.select("source_id", F.explode("pages").alias("path"))
    return named.join(pages.select("path").distinct(), "path", "left_anti").select("source_id", "path")


def lint_wiki(pages: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """``severity``, ``code``, ``path`` and ``detail`` of what is wrong: missing URLs, topics without sources, broken links, missing pages."""
    fields = F.col("fields")
    # a scratch table: a filter over its columns would be pushed into the patterns, and try them again for each use of a field
    front = pages.where(F.col("path").startswith("Sources/") | F.col("path").startswith("Topics/"))
    front = read_frontmatter(front).select("path", fields["type"].alias("kind"), fields["url"].alias("url"), fields["sources"].alias("told"), F.size(F.col("lists")["sources"]).alias("n_sources"))
    front = written(front, "front")
    issue = lambda df, severity, code, detail: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "path", detail.alias("detail"))
    no_url = F.col("path").startswith("Sources/") & (F.col("kind") == "source") & F.coalesce(filled("url"), F.lit("null")).isin("null")
    listed = (F.coalesce("n_sources", F.lit(0)) > 0) | (F.coalesce(filled("told"), F.lit("[]")) != "[]")
    no_sources = F.col("path").startswith("Topics/") & (F.col("kind") == "topic") & ~listed
    code = F.when(no_url, "missing_url").when(no_sources, "topic_no_sources")  # a page can have one of the two
    checked = pages.where(~F.col("path").startswith("Lint/") & ~F.col("path").startswith("Templates/"))
    broken = resolve_links(extract_links(checked), pages).where(~F.col("exists"))
    out = front.select(F.lit("warn").alias("severity"), code.alias("code"), "path", F.lit(None).cast("string").alias("detail")).where(F.col("code").isNotNull())
    out = out.unionByName(issue(broken, "error", "broken_wikilink", F.col("target")))
    if manifest is None:
        spark = pages.sparkSession
        return out.unionByName(spark.sql("SELECT 'warn' AS severity, 'missing_manifest' AS code, 'manifest.json' AS path, CAST(NULL AS STRING) AS detail"))
    return out.unionByName(issue(missing_manifest_pages(manifest, pages), "error", "manifest_missing_page", F.col("source_id")))


def lint_summary(issues: DataFrame) -> DataFrame:
    error, warn = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warn")
    return issues.agg(F.count("*").alias("issue_count"), error.alias("error_count"), warn.alias("warn_count"), (error == 0).alias("ok"))


def wiki_status(manifest: DataFrame, topics: DataFrame, issues: DataFrame) -> DataFrame:
    """Sources, topics, last compile and lint counts, in one row."""
    one = manifest.agg(F.countDistinct("source_id").alias("n_sources"), F.max("updated_at").alias("compiled_at"))
    two = topics.agg(F.countDistinct("topic").alias("n_topics"))
    return one.crossJoin(two).crossJoin(lint_summary(issues))  # three single rows
