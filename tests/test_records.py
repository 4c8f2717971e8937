import json
import random
import sqlite3
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom import queries
from factloom.functions import text as T
from factloom.operators import archive, pages, sources, wiki
from factloom.plans import rounds
from factloom.sources import files, sqlite, store
from factloom.sources.views import Views
from factloom.streaming import feeds

DAY = "2026-01-01"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_text_expressions(spark):
    df = frame(spark, [("  a \t b﻿", 'a: "b"', "x/y: z.. ")], "a string, b string, c string")
    row = df.select(T.trimmed("a"), T.collapsed("a"), T.yaml_scalar("b"), T.file_name("c"), T.title_case(F.lit("deep sea  FISH")), T.link_markdown(F.lit("[[a|b]]"))).first()
    assert list(row) == ["a \t b", "a b", '"a: \\"b\\""', "xy z", "Deep Sea Fish", "[b](wiki:a)"]


def test_web_results_slice_then_drop(spark):
    payload = json.dumps({"results": [{"url": "", "content": ""}, {"url": "u", "content": "c"}, {"title": "t", "snippet": "s"}]})
    got = sources.normalize_web_results(frame(spark, [(1, payload)], "q int, payload string"), 2).collect()
    assert [(r.title, r.url, r.snippet) for r in got] == [("u", "u", "c")]


def test_platform_items(spark):
    raw = {"result": {"tweets": [{"name": "n", "link": "l", "desc": " d ", "author": {"name": "A", "username": "b"}, "score": 3}, {}]}}
    top = {"items": [{"title": "t", "url": "u", "snippet": "s", "engine": "e"}, {"title": "x", "excerpt": "y"}]}
    df = frame(spark, [("demo-x-ops", json.dumps(raw)), ("some-reddit", json.dumps(top))], "skill string, payload string")
    got = {(r.skill, r.source_index): (r.title, r.url, r.snippet, r.engine) for r in sources.normalize_platform_items(df).collect()}
    assert got[("demo-x-ops", 1)] == ("n", "l", "d\nAuthor: A b\nScore: 3", "skill:x")
    assert got[("some-reddit", 1)] == ("t", "u", "s", "e") and got[("some-reddit", 2)] == ("x", "", "y", "skill:reddit")
    assert sources.normalize_unified_items(df.where("skill = 'some-reddit'")).count() == 2
    assert sources.label_engine(df).select("engine").distinct().count() == 2


def test_interleave_is_a_fold(spark):
    rows = [("q", b, i, u) for b, urls in enumerate((["p", "q", "r"], ["p", "q", "s"])) for i, u in enumerate(urls)]
    df = frame(spark, rows, "question string, batch int, item_index int, url string")
    assert [r.url for r in sources.interleave(df, 8).orderBy("position").collect()] == ["p", "q", "r", "s"]
    rng = random.Random(1)
    rows = [("q", rng.randint(0, 3), i, rng.choice(["", "a", "b", "c", None])) for i in range(30)]
    got = [(r.batch, r.item_index) for r in sources.interleave(frame(spark, rows, "question string, batch int, item_index int, url string"), 9).orderBy("position").collect()]
    queues = [[r for r in sorted(rows, key=lambda r: r[2]) if r[1] == b] for b in sorted({r[1] for r in rows})]
    want, seen = [], set()
    while any(queues) and len(want) < 9:
        for q in queues:
            while q and len(want) < 9:
                r = q.pop(0)
                if not r[3] or r[3] not in seen:
                    seen.add(r[3])
                    want.append((r[1], r[2]))
                    break
    assert got == want


def test_enrichment_stops_after_enough_pages(spark):
    rows = [("r", 1, f, s, u, st) for f, s, u, st in [(1, 1, "a", "ok"), (1, 2, "b", "ok"), (2, 1, "b", "ok"), (2, 2, "", None), (3, 1, "c", "ok")]]
    df = frame(spark, rows, "run_id string, iteration int, finding_index int, source_index int, url string, fetch_status string")
    got = {(r.finding_index, r.source_index) for r in sources.enrichment_candidates(df, 1, 2).where("chosen").collect()}
    assert got == {(1, 1), (2, 1)}


def test_findings_nest_and_unnest(spark):
    schema = "run_id string, findings array<struct<question: string, iteration: int, error: string, sources: array<string>>>"
    runs = frame(spark, [("r", [("q1", 1, None, ["a"]), ("q2", 2, "e", [])]), ("s", [])], schema)
    flat = sources.explode_findings(runs)
    back = {r.run_id: r.findings for r in sources.reconstruct_findings(flat.where("question is not null"), "question string, iteration int, error string, sources array<string>").collect()}
    assert [f.question for f in back["r"]] == ["q1", "q2"] and flat.count() == 3


def test_archive_keeps_first_sources_and_counts_all(spark):
    runs = frame(spark, [("r", 1), ("", 2)], "run_id string, archived_at int")
    found = frame(spark, [("r", 1, "q")], "run_id string, seq int, question string")
    told = frame(spark, [("r", i, t, u, "s") for i, t, u in [(1, "a", "u"), (2, "b", " u "), (3, "c", "")]], "run_id string, source_index int, title string, url string, snippet string")
    report = frame(spark, [("r", "text")], "run_id string, report string")
    once = archive.archive_runs(None, runs, found, told, report)
    twice = archive.archive_runs(once, runs, found, told, report)
    assert sorted(r.source_index for r in twice["sources"].collect()) == [1, 3]
    assert twice["runs"].first().sources_count == 3 and twice["findings"].count() == 1 and once["rejected"].count() == 1


def test_sessions_are_read_and_planned(spark, tmp_path):
    for strategy, stamp, names in (("rapid", "2026-01-02_030405", files.FILES), ("rapid", "2026-01-01_000000", files.FILES[:2]), ("rapid", "notes", files.FILES), (".hidden", "2026-01-01_000000", files.FILES)):
        folder = tmp_path / strategy / stamp
        folder.mkdir(parents=True)
        for name in names:
            text = {"meta.json": json.dumps({"query": "q", "researchId": ""}), "findings.json": json.dumps([{"question": "x", "sources": []}]), "sources.json": json.dumps([{"title": "t", "url": "u"}])}
            (folder / name).write_text(text.get(name, "# r\n\nbody"))
    got = files.read_sessions(spark, str(tmp_path), "rapid")
    assert [(r.session_ts, r.complete) for r in got["sessions"].collect()] == [("2026-01-02_030405", True), ("2026-01-01_000000", False)]
    assert got["reports"].first().report == "# r\n\nbody" and got["sources"].first().title == "t"
    plan = archive.plan_import(got["sessions"].drop("run_id"), frame(spark, [("x",)], "run_id string"))
    assert {r.status for r in plan.collect()} == {"imported", "skipped"}
    dry = archive.import_summary(archive.plan_import(got["sessions"].drop("run_id"), frame(spark, [("x",)], "run_id string"), dry_run=True)).first()
    assert (dry.scanned, dry.imported, dry.skipped) == (2, 1, 1)


def test_sessions_come_back_as_written(spark, tmp_path):
    schema = "run_id string, query string, strategy string, created_at timestamp"
    root = str(tmp_path / "out")
    findings = frame(spark, [("r", 2, "second\nline"), ("r", 1, "first")], "run_id string, seq int, question string")
    sources = frame(spark, [("r", 1, "t", "u", None), ("r", 2, 'a "b"', "", "x")], "run_id string, source_index int, title string, url string, content string")
    reports = frame(spark, [("r", "# R\n\nbody\n\n")], "run_id string, report string")
    for run, second in (("r", 5), ("bare", 6), ("r", 5)):
        files.write_sessions(frame(spark, [(run, "q", "rapid", datetime(2026, 1, 2, 3, 4, second))], schema), findings, sources, reports, root)
    got = files.read_sessions(spark, root)
    assert [(r.run_id, r.session_ts, r.complete) for r in got["sessions"].collect()] == [("bare", "2026-01-02_030406", True), ("r", "2026-01-02_030405", True)]
    assert {r.run_id: r.report for r in got["reports"].collect()} == {"r": "# R\n\nbody\n\n", "bare": ""}
    assert [(r.seq, r.question) for r in got["findings"].orderBy("seq").collect()] == [(1, "first"), (2, "second\nline")]
    assert [(r.title, r.url, r.content) for r in got["sources"].orderBy("source_index").collect()] == [("t", "u", None), ('a "b"', "", "x")]
    same = frame(spark, [(n, "q", "rapid", datetime(2026, 1, 2, 3, 4, 5)) for n in "ab"], schema)
    with pytest.raises(Exception, match="two runs in one second"):
        files.write_sessions(same, findings, sources, reports, root)


def arrivals(spark, ids, day, text="x"):
    at = F.to_timestamp(F.lit(f"2026-01-{day:02d}"))
    runs = frame(spark, [(i, text) for i in ids], "run_id string, query string").withColumn("archived_at", at).withColumn("_n", F.lit("a user's own")).withColumn("_new", F.lit("too"))
    findings = frame(spark, [(i, k, f"{text}{k}") for i in ids for k in (1, 2)], "run_id string, seq int, question string")
    rows = [(i, k, f"http://{k}", text) for i in ids for k in (1, 2, 2)]
    sources = frame(spark, [(i, n, u, t) for n, (i, _, u, t) in enumerate(rows, 1)], "run_id string, source_index int, url string, title string")
    sources = sources.withColumn("snippet", F.lit(None).cast("string")).withColumn("content", F.lit(None).cast("string")).withColumn("archived_at", at)
    return runs, findings, sources, frame(spark, [(i, text) for i in ids], "run_id string, report string")


def parts(base, table="runs"):
    return {str(p.relative_to(base)) for p in (base / "data" / table).glob("delta=*/bucket=*/*.parquet")}


def test_archive_in_buckets_and_deltas(spark, tmp_path, monkeypatch):
    base = tmp_path / "arc"
    assert archive.read_archive(spark, str(base)) == {}
    ids = [f"r{i}" for i in range(30)]
    archive.archive_batch(str(base), *arrivals(spark, ids, 1), buckets=4)
    before = parts(base)
    archive.archive_batch(str(base), *arrivals(spark, ["r3", "new"], 2, "later"))
    # what is there stays file by file; the batch lies in its own runs' buckets
    added = {p.split("bucket=")[1].split("/")[0] for p in parts(base) - before}
    assert before <= parts(base) and len(added) <= 2
    kept = archive.read_archive(spark, str(base))
    assert {name: df.count() for name, df in kept.items()} == {"runs": 31, "reports": 31, "findings": 62, "sources": 62}
    assert {r.query for r in kept["runs"].where("run_id = 'r3'").collect()} == {"later"} and kept["runs"].first()["_n"] == "a user's own"
    assert {r.title for r in kept["sources"].where("run_id = 'r3'").collect()} == {"x"}  # sources that were there stay
    archive.archive_batch(str(base), *arrivals(spark, ["r4"], 3, "upgraded"), upgrade=True)
    archive.archive_batch(str(base), *arrivals(spark, ["r4"], 2, "older"))
    kept = archive.read_archive(spark, str(base), ["r4", "none"])
    assert {r.title for r in kept["sources"].collect()} == {"upgraded"} and kept["runs"].first().query == "upgraded"
    plan = kept["runs"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert len(kept["runs"].inputFiles()) < len(archive.read_archive(spark, str(base))["runs"].inputFiles())

    # a broken write counts for nothing and is gone with the next one; buckets that grow are merged
    torn = base / "data" / "runs" / "delta=000000000099-torn" / "bucket=0"
    torn.mkdir(parents=True)
    (base / "versions" / "000000000099-torn").mkdir()
    monkeypatch.setattr(store, "DELTAS", 4)
    for day in range(4, 7):
        archive.archive_batch(str(base), *arrivals(spark, ["r5"], day, f"day{day}"))
    assert not torn.exists() and len(list((base / "versions").iterdir())) <= 3
    kept = archive.read_archive(spark, str(base))
    assert {name: df.count() for name, df in kept.items()} == {"runs": 31, "reports": 31, "findings": 62, "sources": 62}
    assert kept["runs"].where("run_id = 'r5'").first().query == "day6"
    assert max(Counter(p.split("bucket=")[1].split("/")[0] for p in kept["reports"].inputFiles()).values()) < 4


WIKI = "run_id string, source_index int, title string, url string, snippet string, content string, query string"


def compiled(spark, manifest=None, title="First: one"):
    rows = [("r", 1, title, "http://a", "has [[x]]", "long content", "deep sea fish"), ("r", 2, "Second", "http://b", None, None, "deep sea fish")]
    told = wiki.normalize_wiki_sources(frame(spark, rows, WIKI))
    reports = frame(spark, [("r", "# T\n\nThe summary line.\n## S\n- a bullet that is long enough [1.1]")], "run_id string, report string")
    none = frame(spark, [], "source_id string, hash string, pages array<string>, run_id string, updated_at timestamp")
    return wiki.compile_wiki(told, reports, none if manifest is None else manifest, DAY)


def test_wiki_compiles_lints_and_skips(spark, tmp_path):
    made = compiled(spark)
    assert made["summary"].first().asDict() == {"compiled": 2, "skipped": 0, "n_topics": 1, "n_pages": 6}
    content = {r.path: r.content for r in made["pages"].collect()}
    assert "`[[x]]`" in content["Sources/r/Source 001 - First one.md"] and "The summary line." in content["Topics/Deep Sea Fish.md"]
    manifest = spark.createDataFrame(made["manifest"].collect(), made["manifest"].schema)
    again = compiled(spark, manifest)
    assert again["summary"].first().skipped == 2
    assert compiled(spark, manifest, "Changed")["summary"].first().compiled == 1
    kept = spark.createDataFrame(made["pages"].collect(), made["pages"].schema)
    assert wiki.lint_summary(wiki.lint_wiki(kept, manifest)).first().ok
    broken = kept.unionByName(frame(spark, [("Topics/x.md", "topic", "---\ntype: topic\n---\n\n[[Nowhere]] `[[code]]`")], "path string, type string, content string"))
    codes = sorted(r.code for r in wiki.lint_wiki(broken, manifest.withColumn("pages", F.array(F.lit("gone.md")))).collect())
    assert codes == ["broken_wikilink", "manifest_missing_page", "manifest_missing_page", "topic_no_sources"]
    for path, text in content.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert {r.path: r.content for r in files.read_vault(spark, str(tmp_path)).collect()} == content
    titles = {r.path: r.title for r in pages.page_titles(kept).collect()}
    assert titles["Sources/r/Source 002 - Second.md"] == "Second"
    assert wiki.wiki_status(manifest, made["topics"], wiki.lint_wiki(kept, manifest)).first().n_sources == 2


def test_links_resolve_near_first(spark):
    df = frame(spark, [("A/b.md", "[[c]] [[../d|D]] ```\n[[no]]\n``` [[A\\c]]"), ("A/c.md", ""), ("d.md", "")], "path string, content string")
    got = [(r.target, r.alias, r.resolved_path) for r in pages.resolve_links(pages.extract_links(df), df).orderBy("position").collect()]
    assert got == [("c", None, "A/c.md"), ("../d", "D", "d.md"), ("A\\c", None, "A/c.md")]


def test_rounds_ask_and_search(spark):
    queries = frame(spark, [("r", "whales of the north")], "run_id string, query string")
    corpus = frame(spark, [("p1", "Whales of the north sing."), ("p2", "Whales eat krill.")], "path string, content string")
    ask = lambda told, n: told.select("run_id", F.lit(1).alias("position"), F.concat(F.lit("krill "), F.substring("context", 1, 6)).alias("question"))
    search = lambda q: rounds.search_round(q, corpus, k=2)
    findings, found = rounds.run_rounds(queries, "source-based", ask, search, iterations=2)
    assert sorted((r.finding_index, r.iteration) for r in findings.collect()) == [(1, 1), (2, 1), (3, 2)]
    assert found.where("finding_index = 1 and source_index = 1").first().url == "p1"

    def failing(question):
        if "bad" in question:
            raise ValueError("boom")
        return [{"title": question, "url": "u"}]

    asked = frame(spark, [("r", 1, "bad one"), ("r", 2, " good "), ("r", 3, "good")], "run_id string, position int, question string")
    findings, found = rounds.search_round(asked, search=failing)
    assert [(r.question, r.error) for r in findings.orderBy("finding_index").collect()] == [("bad one", "ValueError: boom"), ("good", None)]
    assert found.count() == 1
    rounds.register_strategy("mine", lambda q, a, s, i, c: (q, q), "my own")
    assert ("mine", "my own") in rounds.list_strategies()
    try:
        rounds.run_rounds(queries, "none", ask, search)
    except ValueError as error:
        assert "unknown strategy" in str(error)
    else:
        raise AssertionError("no error")


def test_relevance_replies(spark):
    df = frame(spark, [("r", 0, 3, 'x [{"index": 1, "keep": false}, {"index": 1, "score": 0.9}, {"index": 9}] y'), ("s", 0, 1, "none")], "run_id string, batch int, n_items int, response string")
    got = sorted((r.run_id, r.item, r["keep"], r.score, r.parsed) for r in rounds.parse_relevance(df).collect())
    assert got == [("r", 1, True, 0.9, True), ("r", 2, True, 0.5, True), ("r", 3, True, 0.5, True), ("s", 1, True, 0.5, False)]


def test_streams_equal_batches(spark, tmp_path):
    logs = frame(spark, [(i, "r" if i % 2 else "s", "info" if i % 3 else "error", f"m{i}", i if i % 4 else None, datetime(2026, 1, 1, 0, 0, i)) for i in range(12)], "id long, run_id string, level string, message string, progress int, created_at timestamp")
    logs.repartition(3).write.parquet(str(tmp_path / "logs"))
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "logs"))
    q = feeds.latest_status(stream).writeStream.outputMode("complete").format("memory").queryName("status").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("status").collect()) == sorted(feeds.latest_status(logs).collect())
    events = logs.select(F.lit("search_progress").alias("stage"), F.lit(2).alias("iteration"), F.lit(2).alias("iterations"), F.lit(1).alias("completed"), F.lit(2).alias("total"), F.lit("q").alias("question"), F.lit(None).cast("string").alias("level"))
    assert feeds.progress_from_events(events).first().progress == 58  # 10 + 30 + 5 + round(0.5 * 25)
    nothing = events.withColumns({"total": F.lit(0), "iterations": F.lit(0)})
    for stage in ("search_progress", "search_item_complete", "searching", "generating_questions"):
        assert len(feeds.progress_from_events(nothing.withColumn("stage", F.lit(stage))).collect()) == 12  # shares of none stop nothing


def test_sessions_are_packed_in_few_files_and_replaced(spark, tmp_path):
    """400 sessions (1600 files, each in three folders of its own before) are files of up to 1000; what is put again replaces."""
    root = str(tmp_path / "s")
    runs = spark.range(400).selectExpr("cast(id AS string) AS run_id", "'q' AS query", "'rapid' AS strategy", "timestamp_seconds(id) AS created_at")
    findings = runs.selectExpr("run_id", "1 AS seq", "'a\nb' AS question", "1 AS iteration")
    sources, reports = frame(spark, [], "run_id string, source_index int, title string"), runs.selectExpr("run_id", "'r' AS report")
    files.write_sessions(runs, findings, sources, reports, root)
    assert len([p for p in (tmp_path / "s").rglob("part-*")]) <= 16
    files.write_sessions(runs.where("run_id = '7'"), findings.where("run_id = '7'").withColumn("question", F.lit("new")), sources, reports, root)
    got = files.read_sessions(spark, root)
    assert got["sessions"].where("complete").count() == 400
    asked = {r.run_id: r.question for r in got["findings"].collect()}
    assert len(asked) == 400 and asked.pop("7") == "new" and set(asked.values()) == {"a\nb"}


def session(root, name, findings="[]", meta=None, files=("report.md", "findings.json", "sources.json", "meta.json")):
    texts = {"report.md": "# R", "findings.json": findings, "sources.json": '[{"title": "t", "url": "http://x"}]', "meta.json": meta or f'{{"researchId": "{name}", "query": "q"}}'}
    folder = root / "rapid" / name
    folder.mkdir(parents=True, exist_ok=True)
    for f in files:
        (folder / f).write_text(texts[f])


def test_broken_sessions_fail_and_enter_once_mended(spark, tmp_path):
    root = tmp_path / "in"
    good, half = '[{"question": "a", "iteration": 1}]', '[{"question": "a", "itera'
    session(root, "2026-01-01_000001", good)
    session(root, "2026-01-01_000002", half)
    session(root, "2026-01-01_000003", good, "{broken")
    session(root, "2026-01-01_000004", good, files=("report.md",))
    session(root, "2026-01-01_000005", " ")
    session(root, "2026-01-01_000006", '{"no": "list"}')
    made = files.read_sessions(spark, str(root))
    plan = archive.plan_import(made["sessions"], made["runs"].limit(0))
    assert [(r.session_ts[-1], r.status, r.reason) for r in plan.orderBy("session_ts").collect()] == [
        ("1", "imported", None), ("2", "failed", "unreadable: findings.json"), ("3", "failed", "unreadable: meta.json"),
        ("4", "skipped", "missing files"), ("5", "failed", "unreadable: findings.json"), ("6", "failed", "unreadable: findings.json"),
    ]
    assert archive.import_summary(plan).first().asDict() == {"scanned": 6, "imported": 1, "upgraded": 0, "skipped": 1, "failed": 4}
    assert [r.run_id for r in made["runs"].collect()] == ["2026-01-01_000001"] and made["findings"].count() == 1

    base, calls = str(tmp_path / "archive"), []

    def take(tables):
        calls.append(1)
        if len(calls) == 1:
            raise ValueError("no room")
        runs = tables["runs"].withColumn("archived_at", F.to_timestamp(F.lit(DAY)))
        archive.archive_batch(base, runs, tables["findings"], tables["sources"], tables["reports"], buckets=4)

    def run():
        feeds.stream_sessions(spark, str(root), take, str(tmp_path / "check"), str(tmp_path / "out"), 3).awaitTermination()
        return {r.folder[-1]: r.status for r in feeds.session_outcomes(spark, str(tmp_path / "out")).collect()}

    # a refused batch comes again with the next one
    assert run() == {"1": "archived", "2": "failed", "3": "failed", "4": "waiting", "5": "failed", "6": "failed"}
    session(root, "2026-01-01_000002", good)
    session(root, "2026-01-01_000004", good)
    assert run() == {"1": "archived", "2": "archived", "3": "failed", "4": "archived", "5": "failed", "6": "failed"}
    kept = archive.read_archive(spark, base)
    assert sorted(r.run_id[-1] for r in kept["runs"].collect()) == ["1", "2", "4"] and kept["sources"].count() == 3


def test_lifecycle_keeps_what_nulls_leave(spark):
    rows = [(1, "r", "queued", None, None), (2, "r", "running", "x", None), (3, "r", "completed", None, None)]
    df = frame(spark, rows, "id int, run_id string, status string, report string, error string").withColumn("created_at", F.to_timestamp(F.lit(DAY)))
    row = feeds.run_lifecycle(df).first()
    assert (row.status, row.report, row.error) == ("completed", "x", None) and row.completed_at is not None


def test_users_columns_of_any_name_stay(spark):
    rows = [("r", 1, 1, "http://a", "t", "s"), ("r", 1, 2, "http://a", "t", "s"), ("r", 2, 1, "http://b", "t", "s")]
    df = frame(spark, rows, "run_id string, finding_index int, source_index int, url string, title string, snippet string")
    df = df.withColumns({c: F.lit("own") for c in ("n", "_n", "_key", "place", "u", "same", "mark", "row")})
    for got in (sources.dedupe_sources(df), sources.last_sources(df, 2), sources.enrichment_candidates(df.withColumn("iteration", F.lit(1)).withColumn("fetch_status", F.lit("ok")))):
        assert set(df.columns) <= set(got.columns) and {r["_n"] + r["n"] + r["_key"] + r["place"] for r in got.collect()} == {"own" * 4}
    taken = sources.interleave(df.withColumnsRenamed({"run_id": "question", "finding_index": "batch", "source_index": "item_index"}))
    assert [(r.url, r.position, r.row) for r in taken.orderBy("position").collect()] == [("http://a", 1, "own"), ("http://b", 2, "own")]


def test_rounds_read_pages_and_judge_sources(spark):
    queries = frame(spark, [("r", "whales of the north")], "run_id string, query string")
    corpus = frame(spark, [(f"p{i}", f"Whales of the north sing, part {i}.") for i in range(4)], "path string, content string")
    seen = []

    def ask(told, n):
        seen.append(told.first().context)
        return told.select("run_id", F.lit(1).alias("position"), F.lit("whales sing").alias("question"))

    def read(urls):
        failed = F.col("url") == "p1"
        return urls.select("url", F.lit(None).cast("string").alias("title"), F.concat(F.lit("page of "), "url").alias("content"), F.when(failed, "failed").otherwise("ok").alias("status"), F.when(failed, "gone").alias("error"))

    judge = lambda found: found.select("run_id", "url").distinct().select("run_id", "url", (F.col("url") != "p2").alias("keep"), F.lit(0.9).alias("score"), F.lit("").alias("reason"))
    findings, found = rounds.run_rounds(queries, "source-based", ask, lambda q: rounds.search_round(q, corpus, k=3), read=read, judge=judge, per_finding=2, total=9)
    got = {(r.finding_index, r.url): (r.content, r.fetch_status, r.fetch_error) for r in found.collect()}
    # the first finding reads two pages, the second those that are left; p2 isn't kept; the next round begins anew
    assert got[(1, "p0")] == ("page of p0", "ok", None) and got[(1, "p1")] == (None, "failed", "gone")
    assert got[(2, "p0")] == (None, None, None) and got[(3, "p0")] == ("page of p0", "ok", None) and not any(url == "p2" for _, url in got)
    assert findings.count() == 3 and "page of p0" in seen[1] and "page of p2" in seen[1]
    plain, _ = rounds.run_rounds(queries, "rapid", ask, lambda q: rounds.search_round(q, corpus, k=3), read=read, judge=judge)
    assert plain.count() == 2


def test_history_comes_back_from_sqlite(spark, tmp_path):
    path = tmp_path / "research.db"
    con = sqlite3.connect(path)
    con.executescript("""
        CREATE TABLE research_history (id TEXT PRIMARY KEY, query TEXT, status TEXT, strategy TEXT, report TEXT, error TEXT, created_at TEXT, updated_at TEXT, completed_at TEXT);
        CREATE TABLE research_logs (id INTEGER PRIMARY KEY AUTOINCREMENT, research_id TEXT, level TEXT, message TEXT, progress INTEGER, created_at TEXT);
        CREATE TABLE sources (id INTEGER PRIMARY KEY AUTOINCREMENT, research_id TEXT, title TEXT, url TEXT, snippet TEXT, engine TEXT, created_at TEXT);""")
    con.executemany("INSERT INTO research_history VALUES (?, 'q', 'completed', 'rapid', NULL, NULL, ?, '', NULL)", [("a", "2026-01-01"), ("b", "2026-01-02")])
    con.executemany("INSERT INTO research_logs (research_id, level, message, progress, created_at) VALUES (?, 'info', ?, ?, '')", [("ab"[i % 2], f"m{i}", i if i % 3 else None) for i in range(10)])
    con.execute("DELETE FROM research_logs WHERE id IN (4, 5)")
    con.commit()
    con.close()
    got = files.read_history(spark, str(path))
    assert [(r.run_id, r.report) for r in got["history"].collect()] == [("b", None), ("a", None)]
    logs = [(r.run_id, r.id, r.message, r.progress) for r in got["logs"].collect()]
    assert logs == sorted(("ab"[i % 2], i + 1, f"m{i}", i if i % 3 else None) for i in range(10) if i not in (3, 4)) and got["history_sources"].count() == 0
    parted = sqlite.read_table(spark, str(path), "research_logs", rows=3)
    assert parted.count() == 8 and parted.rdd.getNumPartitions() == 4


def test_parts_of_a_compile_share_one_table_of_sources(spark):
    """Every part of a compile joined documents, pages and conversations anew before."""
    made = queries._compiled(Views(spark, "/root/testdata/sf0.001"))
    for name in ("pages", "manifest", "topics", "summary", "old"):
        read = made[name].inputFiles()
        assert read and not any("documents.parquet" in f for f in read)
