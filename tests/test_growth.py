"""What a query takes must not outgrow its input."""

import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from factloom.functions.text import SPACE, SPACES, trimmed
from factloom.operators import archive, pages, wiki
from factloom.plans import rounds


def test_strategies_share_the_search_of_a_round(spark):
    queries = spark.createDataFrame([(i, f"query {i}", name) for i, name in enumerate(["rapid", "parallel", "source-based"] * 2)], "run_id long, query string, strategy string")
    searches = []

    def ask(told, count):
        return told.select("run_id", F.lit(1).alias("position"), F.concat(F.lit("more of "), "query", F.lit(" after "), F.length("context").cast("string")).alias("question"))

    def search(asked):
        searches.append(asked)
        return rounds.search_round(asked, search=lambda q: [{"title": q, "url": q, "snippet": "s"}])

    findings, sources = rounds.run_strategies(queries, ask, search, count=1)
    together = sorted(map(tuple, findings.collect())), sorted(map(tuple, sources.collect()))
    assert len(searches) == 2
    apart = [], []
    for name in ("rapid", "parallel", "source-based"):
        made = rounds.run_rounds(queries.where(F.col("strategy") == name).select("run_id", "query"), name, ask, search, count=1)
        for rows, df in zip(apart, made, strict=True):
            rows += [tuple(r) for r in df.select(*(findings if rows is apart[0] else sources).columns).collect()]
    assert together == (sorted(apart[0]), sorted(apart[1]))


def test_best_pages_by_all_scores():
    """Against all scores; no table of questions by pages is held."""
    n, k = 2000, 3
    questions = [" ".join(f"w{(i * j) % 97:02}" for j in range(1, 6)) for i in range(n)]
    texts = [" ".join(f"w{(p * j) % 97:02}" for j in range(2, 20)) for p in range(2000)]
    words = [q.split(" ") for q in questions]

    class Held:
        value = (list(range(n)), questions, words)

    batch = pa.record_batch([pa.array([f"p{p}" for p in range(len(texts))]), pa.array(texts)], ["path", "text"])
    tracemalloc.start()
    (out,) = pages._best_pages(Held, k)([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    got: dict[int, list] = {}
    for i, path, score in zip(*(c.to_pylist() for c in out.columns), strict=True):
        got.setdefault(i, []).append((-score, path))
    for i in range(0, n, 40):
        scores = [(-(sum(w in t for w in words[i]) + 5 * (questions[i] in t)), f"p{p}") for p, t in enumerate(texts)]
        assert sorted(got.get(i, [])) == sorted(s for s in scores if s[0])[:k]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_front_matter_is_matched_once(spark):
    df = spark.createDataFrame([("p", "---\na: 1\na: 'two'\nb:\n  - x\n  - y\n---\n\nbody")], "path string, content string")
    told = pages.read_frontmatter(df).select("path", "fields", "lists")
    assert plan(told).count("regexp_extract_all") == 5
    assert tuple(told.first()) == ("p", {"a": "two"}, {"b": ["x", "y"]})


def test_white_space_is_taken_from_ends_only(spark):
    texts = ["", " ", "\u3000a b\ufeff\n", "a \x85", "\x1c a", "a" * 50 + " " * 50 + "b", "\t\u2003é\u202f\r"]
    space = "".join(chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and re.match(SPACE.replace(r"\x{", r"\u{").translate({ord("{"): None, ord("}"): None}).replace(r"\ua0", r"\xa0"), chr(i)))
    assert sorted(space) == sorted(SPACES)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", trimmed("t")).orderBy("i").collect()
    assert [r[1] for r in rows] == [t.strip(SPACES) for t in texts]


def test_lint_matches_front_matter_once(spark):
    found = [("Sources/r/a.md", "---\ntype: source\nurl: null\n---\n"), ("Topics/t.md", "---\ntype: topic\nsources:\n---\n[[x]]"), ("Topics/u.md", "---\ntype: topic\nsources:\n  - s\n---\n"), ("Home.md", "[[Topics/t]]")]
    df = spark.createDataFrame(found, "path string, content string")
    manifest = spark.createDataFrame([("s", ["Topics/u.md", "gone.md"])], "source_id string, pages array<string>")
    issues = wiki.lint_wiki(df, manifest)
    assert plan(issues).count("regexp_extract_all") <= 2  # those of links
    assert sorted(map(tuple, issues.fillna("").collect())) == [
        ("error", "broken_wikilink", "Topics/t.md", "x"), ("error", "manifest_missing_page", "gone.md", "s"),
        ("warn", "missing_url", "Sources/r/a.md", ""), ("warn", "topic_no_sources", "Topics/t.md", ""),
    ]


def test_prompts_are_not_held_by_the_thousand(spark):
    """400 MB of prompts in one partition; the callable tells how much its process holds."""

    def held(text):
        if not text.startswith("p"):
            raise ValueError("odd")
        with open("/proc/self/statm") as f:
            return str(int(f.read().split()[1]) * 4096)

    prompts = spark.range(0, 4000, 1, 1).select(F.col("id").alias("prompt_id"), F.repeat(F.when(F.col("id") == 7, "q").otherwise("p"), F.lit(100_000)).alias("prompt"))
    told = rounds.complete_prompts(prompts, held).drop("prompt").collect()
    assert len(told) == 4000
    assert [(r.prompt_id, r.response, r.error) for r in told if r.error] == [(7, None, "ValueError: odd")]
    assert max(int(r.response) for r in told if r.response) < 200e6


def test_archive_goes_over_sources_for_sources_and_counts_only(spark):
    day = F.current_timestamp().alias("archived_at")
    runs = spark.createDataFrame([("r", "q"), (" ", "none")], "run_id string, query string").select("*", day)
    findings = spark.createDataFrame([("r", 1, "q")], "run_id string, seq int, question string")
    sources = spark.createDataFrame([("r", 1, "t", "u", "s")], "run_id string, source_index int, title string, url string, snippet string")
    reports = spark.createDataFrame([("r", "text")], "run_id string, report string")
    made = archive.archive_runs(None, runs, findings, sources, reports)
    assert [plan(made[name]).count("LogicalRDD") for name in ("reports", "findings")] == [2, 2]  # its own rows, and runs for their time
    assert [(r.run_id, r.report) for r in made["reports"].collect()] == [("r", "text")]
    assert [(r.run_id, r.seq) for r in made["findings"].collect()] == [("r", 1)]
    assert [(r.run_id, r.sources_count, r.report_length) for r in made["runs"].collect()] == [("r", 1, 4)]
