"""A query for each operator over the given tables, and the DuckDB SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import SPACE
from factloom.operators import archive, claims, pages, sources, wiki
from factloom.plans import evaluation, rounds
from factloom.sources import files
from factloom.sources.scratch import shared_dir, written
from factloom.sources.views import Views, with_views
from factloom.streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAY = "2026-01-01"


def query(name: str, sql: str | None = None):
    """Registers a function of the views."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(Views(spark, folder))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add


# ---- SQL that several oracles share ----

TRIM = lambda x: f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"
COLLAPSE = lambda x: TRIM(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")
EVIDENCE = lambda s="": f"coalesce({TRIM(f'coalesce(nullif({s}summary, {chr(39)*2}), nullif({s}content, {chr(39)*2}), nullif({s}snippet, {chr(39)*2}))')}, '')"
CITES = r"""
    matches AS (
        SELECT run_id, claim_index, m, ord FROM (
            SELECT run_id, claim_index, unnest(ms) AS m, generate_subscripts(ms, 1) AS ord
            FROM (SELECT run_id, claim_index, regexp_extract_all(text, '\[\d+\.\d+(?:-\d+\.\d+)?\]') AS ms FROM told_claims))
    ), parts AS (
        SELECT run_id, claim_index, ord, CAST(regexp_extract(m, '\[(\d+)\.(\d+)', 1) AS BIGINT) AS a, CAST(regexp_extract(m, '\[(\d+)\.(\d+)', 2) AS BIGINT) AS b,
               TRY_CAST(regexp_extract(m, '-(\d+)\.(\d+)\]', 1) AS BIGINT) AS c, TRY_CAST(regexp_extract(m, '-(\d+)\.(\d+)\]', 2) AS BIGINT) AS d
        FROM matches
    ), firsts AS (
        SELECT *, unnest(range(a, coalesce(c, a) + 1)) AS finding_index FROM parts
    ), seconds AS (
        SELECT run_id, claim_index, ord, finding_index, unnest(range(b, coalesce(d, b) + 1)) AS source_index FROM firsts
    ), citations AS (
        SELECT run_id, claim_index, finding_index, source_index,
               CAST(row_number() OVER (PARTITION BY run_id, claim_index ORDER BY min(ord), finding_index, source_index) AS INTEGER) AS position
        FROM seconds GROUP BY run_id, claim_index, finding_index, source_index
    ), cited AS (
        SELECT c.*, c.finding_index || '.' || c.source_index AS key, s.run_id IS NOT NULL AS resolved, s.title, s.url, s.engine, s.evidence,
               s.run_id IS NOT NULL AND TRIM_TITLE <> '' AND TRIM_URL <> '' AND s.evidence <> '' AS complete
        FROM citations c LEFT JOIN (SELECT *, EVIDENCE AS evidence FROM f_sources) s USING (run_id, finding_index, source_index)
    )""".replace("TRIM_TITLE", TRIM("coalesce(s.title, '')")).replace("TRIM_URL", TRIM("coalesce(s.url, '')")).replace("EVIDENCE", EVIDENCE())
LINE_CLAIMS = "told_claims AS (SELECT run_id, finding_index AS claim_index, line AS text FROM f_report_lines)"
SKIP, SUMMARY, LIST = ("|".join(x) for x in (claims.SKIPPED_SECTIONS, claims.SUMMARY_SECTIONS, claims.LIST_SECTIONS))
PLAIN = lambda x: TRIM(
    rf"regexp_replace(regexp_replace(regexp_replace({x}, '\*\*(.*?)\*\*', '\1', 'g'), '\[(.*?)\]\((.*?)\)', '\1', 'g'), '`([^`]+)`', '\1', 'g')"
)
LINES = rf"""
    split_lines AS (
        SELECT run_id, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_no
        FROM (SELECT run_id, regexp_split_to_array(report, '\r?\n') AS ls FROM f_reports)
    ), headed AS (
        SELECT *, nullif({TRIM(rf"regexp_extract(line, '^###?{SPACE}+(.+)$', 1)")}, '') AS heading, {TRIM("line")} AS bare FROM split_lines
    ), sectioned AS (
        SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'Introduction') AS section
        FROM headed
    )"""
CLAIMS = rf"""{LINES}, kinds AS (
        SELECT *, CASE WHEN regexp_matches(name, '^(?:{SKIP})(?:$|：|:)') THEN 'skip' WHEN regexp_matches(name, '^(?:{SUMMARY})(?:$|：|:)') THEN 'summary'
                       WHEN regexp_matches(name, '^(?:{LIST})(?:$|：|:)') THEN 'list' ELSE 'body' END AS kind,
               bare = '' OR starts_with(bare, '|') OR regexp_matches(bare, '^-{{3,}}$') OR starts_with(bare, '```') AS skipped
        FROM (SELECT *, regexp_replace(lower(section), '^\d+(?:\.\d+)*[.)]{SPACE}*', '') AS name FROM sectioned)
    ), items AS (
        SELECT *, regexp_matches(line, '{claims.ITEM}') AND NOT skipped AND heading IS NULL AS item FROM kinds
    ), islands AS (
        SELECT *, sum(CAST(heading IS NOT NULL OR item OR bare = '' AS INTEGER)) OVER (PARTITION BY run_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS paragraph
        FROM items
    ), raw_claims AS (
        SELECT run_id, section, min(line_no) AS line_start, string_agg(bare, ' ' ORDER BY line_no) AS text
        FROM islands WHERE heading IS NULL AND NOT skipped AND kind = 'summary' AND NOT item GROUP BY run_id, section, paragraph
        UNION ALL
        SELECT run_id, section, line_no, t FROM (
            SELECT *, CASE WHEN item THEN {PLAIN(f"regexp_replace(line, '{claims.ITEM}', '')")} ELSE bare END AS t
            FROM islands WHERE heading IS NULL AND NOT skipped AND kind IN ('list', 'body'))
        WHERE kind = 'list' OR regexp_matches(t, '\[\d+\.\d+(?:-\d+\.\d+)?\]')
    ), plain_claims AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, text ORDER BY line_start) AS n
                       FROM (SELECT run_id, section, line_start, {PLAIN("text")} AS text FROM raw_claims) WHERE length(text) >= 8) WHERE n = 1
    ), told_claims AS (
        SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY line_start) AS INTEGER) AS claim_index, section, text, line_start FROM plain_claims
    )"""
WORDS = r"list_filter(list_distinct(regexp_extract_all(lower({}), '[一-鿿]{{2,}}|[a-z0-9]{{3,}}')), lambda w: NOT list_contains(STOP, w))".replace(
    "STOP", "[" + ", ".join(f"'{w}'" for w in claims.STOP_WORDS) + "]"
)
SCORES = rf"""{CITES}, heard AS (
        SELECT DISTINCT run_id, claim_index, word FROM (
            SELECT run_id, claim_index, unnest({WORDS.format("coalesce(title, '') || ' ' || coalesce(evidence, '')")}) AS word FROM cited WHERE resolved)
    ), said AS (
        SELECT run_id, claim_index, text, len({WORDS.format("text")}) AS n_words FROM told_claims
    ), spoken AS (
        SELECT run_id, claim_index, unnest({WORDS.format("text")}) AS word FROM told_claims
    ), shared AS (
        SELECT run_id, claim_index, count(*) AS shared FROM spoken JOIN heard USING (run_id, claim_index, word) GROUP BY ALL
    ), per AS (
        SELECT run_id, claim_index, string_agg(key, ',' ORDER BY position) AS citation_keys, count(*) AS n_keys, count(*) FILTER (resolved) AS n_resolved,
               count(*) FILTER (complete) AS n_complete FROM cited GROUP BY ALL
    ), scored AS (
        SELECT run_id, claim_index, coalesce(citation_keys, '') AS citation_keys, coalesce(n_keys, 0) AS n_keys, coalesce(n_resolved, 0) AS n_resolved,
               coalesce(n_complete, 0) AS n_complete, CASE WHEN n_words > 0 THEN coalesce(shared, 0) / n_words ELSE 0.0 END AS overlap
        FROM said LEFT JOIN per USING (run_id, claim_index) LEFT JOIN shared USING (run_id, claim_index)
    ), flagged AS (
        SELECT *, array_to_string(list_filter([
            CASE WHEN n_keys = 0 THEN 'no_citation' END, CASE WHEN n_keys > 0 AND n_resolved < n_keys THEN 'citation_unresolved' END,
            CASE WHEN n_resolved > 0 AND n_complete < n_resolved THEN 'missing_source_fields' END,
            CASE WHEN n_keys > 0 AND overlap < 0.08 THEN 'low_keyword_overlap' END], lambda f: f IS NOT NULL), ',') AS flags FROM scored
    )"""
HEALTH = """
    health AS (
        SELECT run_id, n_findings, n_errors, coalesce(n_sources, 0) AS n_sources, coalesce(n_evidence, 0) AS n_evidence, coalesce(n_content, 0) AS n_content,
               coalesce(n_ok, 0) AS n_ok, coalesce(n_failed, 0) AS n_failed, coalesce(n_with_sources, 0) AS n_with_sources, coalesce(n_attempted, 0) AS n_attempted
        FROM (SELECT run_id, count(*) AS n_findings, count(error) AS n_errors FROM f_findings GROUP BY run_id)
        LEFT JOIN (
            SELECT run_id, count(*) AS n_sources, count(coalesce(nullif(summary, ''), nullif(content, ''), nullif(snippet, ''))) AS n_evidence,
                   count(nullif(content, '')) AS n_content, count(*) FILTER (fetch_status = 'ok') AS n_ok, count(*) FILTER (fetch_status = 'failed') AS n_failed,
                   count(DISTINCT finding_index) AS n_with_sources, count(nullif(fetch_status, '')) AS n_attempted
            FROM f_sources GROUP BY run_id) USING (run_id)
    )"""
RATE = lambda a, b: f"CASE WHEN coalesce({b}, 0) = 0 THEN 0.0 ELSE round(CAST({a} AS DOUBLE) / ({b}), 4) END"


def line_claims(v: Views) -> DataFrame:
    return v["f_report_lines"].select(
        "run_id", F.col("finding_index").alias("claim_index"), F.lit("Key Findings").alias("section"), F.col("line").alias("text"), F.col("finding_index").alias("line_start")
    )


def wiki_inputs(v: Views) -> tuple[DataFrame, DataFrame]:
    """Wiki sources and reports of all runs."""
    runs = v["f_runs"].withColumn("archived_at", F.timestamp_seconds(F.col("archived_rank").cast("long")))
    order = v["f_sources"].withColumn("source_index", (F.col("finding_index") * 1000 + F.col("source_index")).cast("int"))
    return wiki.normalize_wiki_sources(wiki.load_wiki_sources(runs, order)), v["f_reports"]


# ---- claims and evaluation ----


@query("t3_parse_citations", f"WITH {LINE_CLAIMS}, {CITES} SELECT run_id, claim_index, position, finding_index, source_index FROM citations")
def _(v):
    return claims.parse_citations(line_claims(v)).drop("finding_to", "source_to")


@query("j1_resolve_citations", f"WITH {LINE_CLAIMS}, {CITES} SELECT run_id, claim_index, position, key, resolved, complete, url FROM cited")
def _(v):
    rows = claims.resolve_citations(claims.parse_citations(line_claims(v)), v["f_sources"])
    return rows.select("run_id", "claim_index", "position", "key", "resolved", "complete", "url")


@query("t5_score_claims", f"WITH {LINE_CLAIMS}, {SCORES} SELECT run_id, claim_index, citation_keys, n_resolved, n_complete, round(overlap, 6) AS overlap, flags, n_keys > 0 AS has_citations, n_resolved = n_keys AS citations_resolved, n_complete = n_resolved AS sources_complete, true AS platform_match FROM flagged")
def _(v):
    resolved = claims.resolve_citations(claims.parse_citations(line_claims(v)), v["f_sources"])
    rows = claims.score_claims(line_claims(v), resolved)
    return rows.select(
        "run_id", "claim_index", F.array_join("citation_keys", ",").alias("citation_keys"), "n_resolved", "n_complete", F.round("overlap", 6).alias("overlap"),
        F.array_join("flags", ",").alias("flags"), "has_citations", "citations_resolved", "sources_complete", "platform_match",
    )


@query("t4_keyword_overlap", f"WITH {CLAIMS}, {SCORES} SELECT run_id, claim_index, round(overlap, 6) AS overlap FROM scored")
def _(v):
    told = written(claims.extract_claims(v["f_reports"]), "claims")
    rows = claims.keyword_overlap(told, claims.resolve_citations(claims.parse_citations(told), v["f_sources"]))
    return rows.select("run_id", "claim_index", F.round("overlap", 6).alias("overlap"))


@query("w7_number_lines", f"WITH {LINES} SELECT run_id, line_no, line, heading, section FROM sectioned")
def _(v):
    return claims.number_lines(v["f_reports"])


@query("t1_extract_claims", f"WITH {CLAIMS} SELECT run_id, claim_index, section, text, line_start FROM told_claims")
def _(v):
    return claims.extract_claims(v["f_reports"])


BULLETS = rf"""bullet_lines AS (
        SELECT run_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT run_id, string_split(report, chr(10)) AS ls FROM f_reports)
    ), bullet_heads AS (
        SELECT *, nullif({TRIM(rf"regexp_extract(line, '^##{SPACE}+(.+)$', 1)")}, '') AS heading, {TRIM("line")} AS bare FROM bullet_lines
    ), bullet_sections AS (
        SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS section FROM bullet_heads
    ), bullets AS (
        SELECT run_id, line_no, section, {TRIM(f"regexp_replace(bare, '^[-*]{SPACE}+', '')")} AS text FROM bullet_sections
        WHERE heading IS NULL AND (starts_with(bare, '-') OR starts_with(bare, '*'))
    ), numbered AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS INTEGER) AS claim_index FROM bullets WHERE length(text) >= 20
    )"""


@query("t2_bullet_claims", rf"WITH {BULLETS} SELECT run_id, claim_index, section, text, regexp_matches(text, '\[\d+\.\d+\]') AS has_citation FROM numbered WHERE claim_index <= 50")
def _(v):
    return claims.extract_bullet_claims(v["f_reports"])


@query("a1_findings_health", f"""
    WITH {HEALTH} SELECT *, {RATE("n_evidence", "n_sources")} AS evidence_rate, {RATE("n_content", "n_sources")} AS content_rate,
        {RATE("n_ok", "n_attempted")} AS ok_rate,
        array_to_string(list_filter([CASE WHEN n_sources = 0 THEN 'empty_sources' END, CASE WHEN n_errors = n_findings THEN 'all_findings_failed' END,
            CASE WHEN n_with_sources = 0 THEN 'no_finding_sources' END, CASE WHEN n_attempted > 0 AND n_ok = 0 THEN 'enrichment_all_failed' END],
            lambda f: f IS NOT NULL), ',') AS flags
    FROM health""")  # fmt: skip
def _(v):
    return evaluation.findings_health(v["f_findings"], v["f_sources"])


RATES = f"""
    rates AS (
        SELECT run_id, count(*) AS claim_count, {RATE("count(*) FILTER (n_keys > 0)", "count(*)")} AS claims_with_citations_rate,
               {RATE("sum(n_resolved)", "sum(n_keys)")} AS citation_resolution_rate, {RATE("sum(n_complete)", "sum(n_resolved)")} AS source_presence_rate
        FROM flagged GROUP BY run_id
    ), all_rates AS (
        SELECT run_id, coalesce(claim_count, 0) AS claim_count, coalesce(claims_with_citations_rate, 0.0) AS claims_with_citations_rate,
               coalesce(citation_resolution_rate, 0.0) AS citation_resolution_rate, coalesce(source_presence_rate, 0.0) AS source_presence_rate,
               CASE WHEN claim_count > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS platform_match_rate, {RATE("n_ok", "n_attempted")} AS enrich_ok_rate,
               {RATE("n_content", "n_sources")} AS content_presence_rate
        FROM health LEFT JOIN rates USING (run_id)
    )"""
METRICS = f"""
    WITH {CLAIMS}, {SCORES}, {HEALTH}, {RATES}
    SELECT *, 0.0::DOUBLE AS supported_rate, 0.0::DOUBLE AS partially_supported_rate, 0.0::DOUBLE AS unsupported_rate, 0.0::DOUBLE AS unverifiable_rate FROM all_rates"""


@query("l3_evaluate_runs", METRICS)
def _(v):
    return evaluation.evaluate_runs(v["f_reports"], v["f_findings"], v["f_sources"])["metrics"]


@query("w3_risk_examples", f"""
    WITH {CLAIMS}, {SCORES}, risky AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY claim_index) AS INTEGER) AS rank FROM flagged WHERE flags <> '')
    SELECT run_id, claim_index, rank, flags FROM risky WHERE rank <= 10""")  # fmt: skip
def _(v):
    rows = evaluation.evaluate_runs(v["f_reports"], v["f_findings"], v["f_sources"])["risks"]
    return rows.select("run_id", "claim_index", "rank", F.array_join("flags", ",").alias("flags"))


VERDICT_RATE = lambda x: RATE(f"count(*) FILTER (verdict = '{x}')", "count(*) FILTER (verdict IS NOT NULL)")


@query("a2_benchmark_metrics", rf"""
    WITH {CLAIMS}, {SCORES}, {HEALTH}, {RATES}, told AS (
        SELECT doc_id AS run_id, trim(CAST(regexp_extract(response, '(?s)\{{.*\}}') AS JSON)->>'verdict') AS verdict FROM f_verdicts
    ), judged AS (
        SELECT f.run_id, CASE WHEN n_resolved = 0 THEN 'unverifiable' WHEN claim_index = 1 THEN verdict END AS verdict FROM flagged f LEFT JOIN told USING (run_id)
    ), verdicts AS (
        SELECT run_id, {VERDICT_RATE("supported")} AS supported_rate, {VERDICT_RATE("partially_supported")} AS partially_supported_rate,
               {VERDICT_RATE("unsupported")} AS unsupported_rate, {VERDICT_RATE("unverifiable")} AS unverifiable_rate FROM judged GROUP BY run_id
    )
    SELECT a.*, coalesce(supported_rate, 0.0) AS supported_rate, coalesce(partially_supported_rate, 0.0) AS partially_supported_rate,
           coalesce(unsupported_rate, 0.0) AS unsupported_rate, coalesce(unverifiable_rate, 0.0) AS unverifiable_rate
    FROM all_rates a LEFT JOIN verdicts v ON v.run_id = a.run_id""")  # fmt: skip
def _(v):
    """With recorded verdicts: the first claim of a run takes the one of the label whose id is the run's."""
    scored = evaluation.evaluate_runs(v["f_reports"], v["f_findings"], v["f_sources"])["claims"]
    told = claims.parse_verdicts(v["f_verdicts"]).select(F.col("doc_id").alias("run_id"), F.lit(1).alias("claim_index"), "verdict", "confidence", "reason")
    plain = scored.drop("verdict", "confidence", "reason", "skipped")
    health = evaluation.findings_health(v["f_findings"], v["f_sources"], v["f_runs"])
    return evaluation.benchmark_metrics(claims.judge_claims(plain, told), health, v["f_runs"])


@query("t10_parse_verdicts", r"""
    SELECT doc_id, trim(j->>'verdict') AS verdict, least(1.0, greatest(0.0, CAST(j->>'confidence' AS DOUBLE))) AS confidence, trim(j->>'reason') AS reason,
           CAST(NULL AS VARCHAR) AS parse_error
    FROM (SELECT doc_id, CAST(regexp_extract(response, '(?s)\{.*\}') AS JSON) AS j FROM f_verdicts)""")  # fmt: skip
def _(v):
    return claims.parse_verdicts(v["f_verdicts"]).drop("response")


@query("a11_claim_prompts", f"""
    WITH {LINE_CLAIMS}, {CITES}, shown AS (
        SELECT run_id, claim_index, string_agg('[' || key || ']' || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || 'URL: ' || coalesce(url, '') || chr(10)
                   || 'Evidence: ' || evidence || chr(10) || 'Engine: ' || coalesce(engine, ''), chr(10) || chr(10) ORDER BY position) AS sources
        FROM cited WHERE resolved GROUP BY ALL)
    SELECT t.run_id, t.claim_index, 'Claim:' || chr(10) || text || chr(10) || chr(10) || 'Cited sources:' || chr(10) || coalesce(sources, '(none)') AS prompt
    FROM told_claims t LEFT JOIN shown s ON s.run_id = t.run_id AND s.claim_index = t.claim_index""")  # fmt: skip
def _(v):
    return claims.claim_prompts(line_claims(v), claims.resolve_citations(claims.parse_citations(line_claims(v)), v["f_sources"]))


SUMMED = ("claims_with_citations", "citation_resolution", "source_presence", "platform_match", "supported", "partially_supported", "unsupported", "unverifiable", "enrich_ok", "content_presence")


@query("s7_benchmark_summary", f"""
    WITH {CLAIMS}, {SCORES}, {HEALTH}, {RATES}, metrics AS (
        SELECT *, 0.0::DOUBLE AS supported_rate, 0.0::DOUBLE AS partially_supported_rate, 0.0::DOUBLE AS unsupported_rate, 0.0::DOUBLE AS unverifiable_rate FROM all_rates
    ), nested AS (
        SELECT f.run_id, string_agg(concat_ws('|', f.claim_index, t.section, t.text, citation_keys, round(overlap, 6), flags), chr(10) ORDER BY f.claim_index) AS claims
        FROM flagged f JOIN told_claims t ON t.run_id = f.run_id AND t.claim_index = f.claim_index GROUP BY f.run_id)
    SELECT m.*, {", ".join(f"CAST(round({n}_rate * 100) AS BIGINT) || '%' AS {n}_percent" for n in SUMMED)}, claims
    FROM metrics m LEFT JOIN nested n ON n.run_id = m.run_id""")  # fmt: skip
def _(v):
    """The nested claims are shown as lines of text."""
    found = evaluation.evaluate_runs(v["f_reports"], v["f_findings"], v["f_sources"])
    rows = evaluation.benchmark_summary(found["metrics"], found["claims"])
    line = lambda c: F.concat_ws("|", c["claim_index"], c["section"], c["text"], F.array_join(c["citation_keys"], ","), F.round(c["overlap"], 6), F.array_join(c["flags"], ","))
    return rows.withColumn("claims", F.array_join(F.transform("claims", line), "\n"))


# ---- sources ----


@query("d1_dedupe_sources", """
    SELECT run_id, finding_index, source_index, url FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id, coalesce(nullif(url, ''), coalesce(title, '') || ':' || coalesce(snippet, ''))
                                     ORDER BY finding_index, source_index) AS n FROM f_sources) WHERE n = 1""")  # fmt: skip
def _(v):
    return sources.dedupe_sources(v["f_sources"]).select("run_id", "finding_index", "source_index", "url")


@query("d2_add_dedup_id", f"""
    SELECT run_id, finding_index, source_index, coalesce(nullif({TRIM("url")}, ''), sha256(concat_ws(':', coalesce(title, ''), coalesce(snippet, ''), coalesce(content, '')))) AS dedup_id
    FROM f_sources""")  # fmt: skip
def _(v):
    return sources.add_dedup_id(v["f_sources"]).select("run_id", "finding_index", "source_index", "dedup_id")


@query("d3_clean_questions", f"""
    SELECT run_id, position, question FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id, question ORDER BY position) AS n
        FROM (SELECT conv_id AS run_id, turn AS position, {TRIM("text")} AS question FROM conversations) WHERE question <> '') WHERE n = 1""")  # fmt: skip
def _(v):
    rows = v.table("conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("position"), F.col("text").alias("question"))
    return sources.clean_questions(rows)


@query("a12_question_counts", f"""
    SELECT conv_id AS run_id, count(DISTINCT nullif({TRIM("text")}, '')) AS n_questions FROM conversations GROUP BY 1""")  # fmt: skip
def _(v):
    return sources.question_counts(v.table("conversations").select(F.col("conv_id").alias("run_id"), F.col("text").alias("question")))


@query("p5_classify_urls", r"""
    SELECT page_id, nullif(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '') AS host,
           coalesce(regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '(^|\.)example\.(com|org)$'), false) AS on_host,
           CASE WHEN regexp_matches(url, '(?i)/en/\d+') THEN 'english' WHEN regexp_matches(url, '(?i)/(de|fr|es)/\d+') THEN 'other' END AS kind
    FROM pages""")  # fmt: skip
def _(v):
    kinds = (("english", r"/en/\d+"), ("other", r"/(de|fr|es)/\d+"))
    return sources.classify_urls(v.table("pages").select("page_id", "url"), ("example.com", "example.org"), kinds).drop("url")


@query("p11_with_evidence", f"SELECT run_id, finding_index, source_index, {EVIDENCE()} AS evidence FROM f_sources")
def _(v):
    return sources.with_evidence(v["f_sources"]).select("run_id", "finding_index", "source_index", "evidence")


@query("p12_complete_sources", f"""
    SELECT run_id, finding_index, source_index FROM f_sources
    WHERE {TRIM("coalesce(title, '')")} <> '' AND {TRIM("coalesce(url, '')")} <> '' AND {EVIDENCE()} <> ''""")  # fmt: skip
def _(v):
    return sources.complete_sources(v["f_sources"]).select("run_id", "finding_index", "source_index")


@query("p13_list_run_findings", """
    SELECT f.run_id, f.finding_index AS n, question, iteration, error, coalesce(source_count, 0) AS source_count
    FROM f_findings f LEFT JOIN (SELECT run_id, finding_index, count(*) AS source_count FROM f_sources GROUP BY ALL) s
      ON s.run_id = f.run_id AND s.finding_index = f.finding_index WHERE f.finding_index <= 50""")  # fmt: skip
def _(v):
    return archive.list_run_findings(v["f_findings"], v["f_sources"])


@query("p13_list_run_sources", """
    SELECT run_id, n, coalesce(nullif(title, ''), 'Untitled source') AS title, coalesce(url, '') AS url, engine, fetch_status FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY finding_index, source_index) AS INTEGER) AS n FROM f_sources) WHERE n <= 50""")  # fmt: skip
def _(v):
    return archive.list_run_sources(v["f_sources"])


@query("w2_top_relevant", """
    SELECT run_id, doc_id, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY score DESC, finding_index, source_index) AS INTEGER) AS rank
        FROM (SELECT *, (doc_id % 10) / 10.0 AS score FROM f_sources) WHERE fetch_status IS NOT NULL) WHERE rank <= 5""")  # fmt: skip
def _(v):
    scored = v["f_sources"].withColumn("score", (F.col("doc_id") % 10) / 10.0).withColumn("keep", F.col("fetch_status").isNotNull())
    return sources.top_relevant(scored, 5).select("run_id", "doc_id", "rank")


LAST = """
    SELECT run_id, doc_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY finding_index, source_index) AS INTEGER) AS number, title, url, summary, content, snippet
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY finding_index DESC, source_index DESC) AS n FROM f_sources) WHERE n <= {}"""


@query("w5_last_sources", f"SELECT run_id, doc_id, number FROM ({LAST.format(12)})")
def _(v):
    return sources.last_sources(v["f_sources"], 12).select("run_id", "doc_id", "number")


@query("w6_interleave", f"""
    WITH RECURSIVE items AS (
        SELECT run_id, coalesce(fetch_status, 'none') AS batch, doc_id, coalesce({TRIM("url")}, '') AS u FROM f_sources
    ), queues AS (
        SELECT run_id, batch, list(struct_pack(d := doc_id, u := u) ORDER BY doc_id) AS q FROM items GROUP BY ALL
    ), turns AS (
        SELECT run_id, list(q ORDER BY batch) AS qs FROM queues GROUP BY run_id
    ), fold AS (
        SELECT run_id, qs, 0 AS step, CAST([] AS STRUCT(d BIGINT, u VARCHAR)[]) AS taken FROM turns
        UNION ALL
        SELECT run_id, qs, step + 1,
               taken || list_filter(qs[step % len(qs) + 1], lambda x: len(list_filter(taken, lambda t: t.d = x.d OR (x.u <> '' AND t.u = x.u))) = 0)[1:1]
        FROM fold WHERE step < 8 * len(qs) AND len(taken) < 8
    ), last AS (
        SELECT run_id, taken FROM fold QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC) = 1
    ), placed AS (
        SELECT run_id, unnest(taken) AS t, CAST(generate_subscripts(taken, 1) AS INTEGER) AS position FROM last
    )
    SELECT s.run_id AS question, coalesce(fetch_status, 'none') AS batch, doc_id AS item_index, url, position
    FROM placed p JOIN f_sources s ON s.run_id = p.run_id AND s.doc_id = t.d""")  # fmt: skip
def _(v):
    """Every source as an item, in batches by how it was fetched."""
    batch = F.coalesce("fetch_status", F.lit("none")).alias("batch")
    return sources.interleave(v["f_sources"].select(F.col("run_id").alias("question"), batch, F.col("doc_id").alias("item_index"), "url"), 8)


@query("w8_enrichment_candidates", f"""
    WITH RECURSIVE told AS (
        SELECT s.run_id, iteration, s.finding_index, source_index, url, fetch_status, coalesce({TRIM("url")}, '') AS u FROM f_sources s JOIN f_findings f USING (run_id, finding_index)
    ), ordered AS (
        SELECT run_id, iteration, list(l ORDER BY finding_index) AS ls FROM (
            SELECT run_id, iteration, finding_index,
                   list(struct_pack(f := finding_index, s := source_index, u := u, ok := coalesce(fetch_status = 'ok', false)) ORDER BY source_index) AS l
            FROM (SELECT * FROM told WHERE u <> '' QUALIFY row_number() OVER (PARTITION BY run_id, iteration, finding_index, u ORDER BY source_index) = 1)
            GROUP BY ALL) GROUP BY ALL
    ), fold AS (
        SELECT run_id, iteration, ls, 0 AS step, CAST([] AS STRUCT(f INTEGER, s INTEGER, u VARCHAR, ok BOOLEAN)[]) AS chosen FROM ordered
        UNION ALL
        SELECT run_id, iteration, ls, step + 1, CASE WHEN len(list_filter(chosen, lambda c: c.ok)) >= 6 THEN chosen
               ELSE chosen || list_filter(ls[step + 1], lambda x: len(list_filter(chosen, lambda c: c.u = x.u)) = 0)[1:3] END
        FROM fold WHERE step < len(ls)
    ), picked AS (
        SELECT run_id, iteration, unnest(chosen) AS c FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY run_id, iteration ORDER BY step DESC) = 1)
    )
    SELECT t.run_id, t.iteration, finding_index, source_index, url, fetch_status, p.run_id IS NOT NULL AS chosen
    FROM told t LEFT JOIN picked p ON p.run_id = t.run_id AND p.iteration = t.iteration AND c.f = finding_index AND c.s = source_index""")  # fmt: skip
def _(v):
    rows = v["f_sources"].join(v["f_findings"].select("run_id", "finding_index", "iteration"), ["run_id", "finding_index"])
    return sources.enrichment_candidates(rows.select("run_id", "iteration", "finding_index", "source_index", "url", "fetch_status"), 3, 6)


@query("p9_add_archive_fields", f"""
    SELECT run_id, finding_index, source_index, length({TRIM("coalesce(content, summary, '')")}) AS content_length,
           length({TRIM("coalesce(content, summary, '')")}) > 0 AS has_content FROM f_sources""")  # fmt: skip
def _(v):
    return archive.add_archive_fields(v["f_sources"]).select("run_id", "finding_index", "source_index", F.col("content_length").cast("bigint").alias("content_length"), "has_content")


# ---- search payloads and nested findings ----


def _payloads(v: Views, item: dict[str, Column]) -> DataFrame:
    """``items`` of each finding: its sources as structs of these columns, in order."""
    listed = F.array_sort(F.collect_list(F.struct("source_index", F.struct(*[c.alias(n) for n, c in item.items()]).alias("item"))))
    return v["f_sources"].groupBy("run_id", "finding_index").agg(F.transform(listed, lambda x: x["item"]).alias("items"))


@query("p1_web_results", """
    SELECT run_id, finding_index, source_index, coalesce(nullif(title, ''), nullif(url, ''), 'Untitled source') AS title, coalesce(url, '') AS url,
           coalesce(nullif(content, ''), nullif(snippet, ''), '') AS snippet, 'web' AS engine FROM f_sources
    WHERE source_index <= 3 AND coalesce(nullif(url, ''), nullif(content, ''), nullif(snippet, '')) IS NOT NULL""")  # fmt: skip
def _(v):
    made = _payloads(v, {n: F.col(n) for n in ("title", "url", "content", "snippet")})
    return sources.normalize_web_results(made.select("run_id", "finding_index", F.to_json(F.struct(F.col("items").alias("results"))).alias("payload")), 3)


@query("p2_platform_items", f"""
    SELECT run_id, finding_index, skill, CAST(place AS INTEGER) AS source_index, title, url, snippet, engine FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id, finding_index ORDER BY source_index) AS place FROM (
            SELECT run_id, finding_index, source_index, CASE run_id % 3 WHEN 0 THEN 'zhihu-ops' WHEN 1 THEN 'my-Reddit' ELSE 'Plain' END AS skill,
                   CASE run_id % 3 WHEN 0 THEN 'skill:zhihu' WHEN 1 THEN 'skill:reddit' ELSE 'skill:plain' END AS engine,
                   coalesce(nullif({TRIM("title")}, ''), 'Untitled source') AS title, coalesce({TRIM("url")}, '') AS url,
                   concat_ws(chr(10), nullif({TRIM("snippet")}, ''), 'Author: ' || nullif(engine, ''), 'Score: ' || doc_id) AS snippet FROM f_sources)
        WHERE url <> '' OR snippet <> '') WHERE place <= 4""")  # fmt: skip
def _(v):
    """Items in each of the places where a payload may have them, by skill."""
    made = _payloads(v, {"name": F.col("title"), "link": F.col("url"), "desc": F.col("snippet"), "author": F.col("engine"), "score": F.col("doc_id").cast("string")})
    at = F.col("run_id") % 4
    inner = lambda name: F.to_json(F.struct(F.struct(F.col("items").alias(name)).alias("result")))
    payload = F.when(at == 0, F.to_json(F.struct("items"))).when(at == 1, inner("items")).when(at == 2, inner("tweets")).otherwise(inner("notes"))
    skill = F.element_at(F.array(*map(F.lit, ("zhihu-ops", "my-Reddit", "Plain"))), (F.col("run_id") % 3 + 1).cast("int"))
    return sources.normalize_platform_items(made.select("run_id", "finding_index", skill.alias("skill"), payload.alias("payload")), 4)


@query("p3_unified_items", f"""
    SELECT run_id, finding_index, CAST(place AS INTEGER) AS source_index, title, url, snippet, engine FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id, finding_index ORDER BY source_index) AS place FROM (
            SELECT run_id, finding_index, source_index, coalesce(nullif({TRIM("title")}, ''), nullif({TRIM("url")}, ''), 'Untitled source') AS title, coalesce({TRIM("url")}, '') AS url,
                   coalesce({TRIM("snippet")}, '') AS snippet, CASE WHEN coalesce(fetch_status, '') = '' THEN 'skill' ELSE 'skill:' || fetch_status END AS engine FROM f_sources)
        WHERE url <> '' OR snippet <> '') WHERE place <= 4""")  # fmt: skip
def _(v):
    """With the fetch status in the platform's place."""
    made = _payloads(v, {"title": F.col("title"), "url": F.col("url"), "snippet": F.col("snippet"), "platform": F.col("fetch_status")})
    return sources.normalize_unified_items(made.select("run_id", "finding_index", F.to_json(F.struct("items")).alias("payload")), 4)


def _nested(v: Views) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("finding_index", F.struct("question", "iteration", "error").alias("f"))))
    return v["f_findings"].groupBy("run_id").agg(F.transform(listed, lambda x: x["f"]).alias("findings"))


@query("p6_explode_findings", "SELECT run_id, finding_index AS seq, question, iteration, error FROM f_findings")
def _(v):
    return sources.explode_findings(_nested(v)).select("run_id", "seq", "question", "iteration", "error")


@query("p7_reconstruct_findings", """
    SELECT run_id, string_agg(concat_ws('|', question, iteration, error), chr(10) ORDER BY finding_index) AS findings FROM f_findings GROUP BY run_id""")  # fmt: skip
def _(v):
    """Half of the rows by their raw text, half by their columns; shown as lines of text."""
    rows = sources.explode_findings(_nested(v)).withColumn("raw", F.when(F.col("seq") % 2 == 0, F.col("raw")).otherwise(""))
    back = sources.reconstruct_findings(rows, "question string, iteration int, error string, sources array<string>")
    return back.select("run_id", F.array_join(F.transform("findings", lambda f: F.concat_ws("|", f["question"], f["iteration"], f["error"])), "\n").alias("findings"))


@query("p8_strip_archive_fields", "SELECT run_id, finding_index, source_index, title, url, snippet, content, summary, engine, fetch_status, page_id, doc_id FROM f_sources")
def _(v):
    kept = sources.add_dedup_id(v["f_sources"]).withColumns({"_seq": F.lit(1), "raw": F.lit("{}"), "archived_at": F.current_timestamp()})
    return archive.strip_archive_fields(kept, wiki=True)


# ---- pages ----


def _text_sql(html: str) -> str:
    out = f"regexp_replace({html}, '(?s)<[^>]+>', ' ', 'g')"
    for entity, char in pages.ENTITIES:
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return COLLAPSE(out)


PAGE_TEXT = rf"""
    WITH bare AS (
        SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'),
               '(?is)<noscript\b[^>]*>.*?</noscript>', ' ', 'g') AS h, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t,
               regexp_matches(html, '(?is)<(!doctype|html|head|body|title|p|div)\b') AS is_html, html FROM pages
    ), texts AS (
        SELECT page_id, url, CASE WHEN is_html THEN {_text_sql("h")} ELSE {TRIM("html")} END AS c, {_text_sql("t")} AS t FROM bare
    )
    SELECT page_id, url, coalesce(nullif(t, ''), url) AS title,
           CASE WHEN c <> '' THEN CASE WHEN length(c) > 8000 THEN substring(c, 1, 8000) || chr(10) || '[...truncated]' ELSE c END END AS content,
           CASE WHEN c = '' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN c = '' THEN 'Empty page content' END AS error FROM texts"""


@query("t6_extract_page_text", PAGE_TEXT)
def _(v):
    return pages.extract_page_text(v.table("pages"))


@query("p14_filter_pages", "SELECT page_id, 'Sources/' || url AS path, 'Page ' || page_id AS title FROM pages WHERE contains(lower('Sources/' || url), 'example.org') OR contains(lower('Page ' || page_id), 'example.org')")
def _(v):
    rows = v.table("pages").select("page_id", F.concat(F.lit("Sources/"), "url").alias("path"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"))
    return pages.filter_pages(rows, " Example.org ")


@query("a6_page_groups", """
    SELECT CASE source WHEN 'src0' THEN 'Topics' WHEN 'src1' THEN 'Sources' WHEN 'src2' THEN '(root)' ELSE source END AS segment, count(*) AS n_pages,
           CASE source WHEN 'src0' THEN 2 WHEN 'src1' THEN 3 WHEN 'src2' THEN 1 ELSE 7 END AS place FROM documents GROUP BY source""")  # fmt: skip
def _(v):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    folder = F.when(F.col("source") == "src0", "Topics/").when(F.col("source") == "src1", "Sources/").when(F.col("source") == "src2", "").otherwise(F.concat("source", F.lit("/")))
    return pages.page_groups(v.table("documents").select(F.concat(folder, name).alias("path")))


ASKED = f"""SELECT conv_id * 1000 + turn AS question_id, lower({TRIM("text")}) AS q FROM conversations WHERE role = 'user' AND conv_id % 20 = 0"""


@query("j8_retrieve", f"""
    WITH asked AS ({ASKED}), words AS (
        SELECT question_id, unnest(regexp_split_to_array(q, '{SPACE}+')) AS w FROM asked
    ), texts AS (SELECT 'docs/' || doc_id AS path, lower(text) AS t FROM documents),
    asked_whole AS (SELECT conv_id * 1000 + turn AS question_id, lower(text) AS q FROM conversations WHERE role = 'user' AND conv_id % 20 = 0),
    hits AS (SELECT question_id, path, count(*) AS n FROM words JOIN texts ON length(w) > 2 AND contains(t, w) GROUP BY ALL),
    whole AS (SELECT question_id, path FROM asked_whole JOIN texts ON trim(q) <> '' AND contains(t, q)),
    ranked AS (
        SELECT question_id, path, coalesce(n, 0) + CASE WHEN w.path IS NULL THEN 0 ELSE 5 END AS score
        FROM hits h FULL JOIN whole w USING (question_id, path)
    )
    SELECT question_id, CAST(rank AS INTEGER) AS rank, path, CAST(score AS BIGINT) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, path) AS rank FROM ranked) WHERE rank <= 5""")  # fmt: skip
def _(v):
    """The query set is every conversation whose id is divisible by 20, against all documents."""
    asked = v.table("conversations").where("role = 'user' AND conv_id % 20 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    texts = v.table("documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return pages.retrieve(asked, texts).select("question_id", "rank", "path", "score")


# ---- archive ----


def _runs(v: Views) -> DataFrame:
    return v["f_runs"].withColumn("archived_at", F.col("archived_rank"))


@query("w1_list_runs", "SELECT run_id, query, strategy, status, archived_rank FROM f_runs ORDER BY archived_rank DESC, run_id LIMIT 50")
def _(v):
    return archive.list_runs(_runs(v), 50).drop("archived_at")


@query("w4_latest_run_id", "SELECT run_id FROM f_runs ORDER BY archived_rank DESC, run_id DESC LIMIT 1")
def _(v):
    return archive.latest_run_id(_runs(v))


@query("j9_show_runs", """
    SELECT r.run_id, coalesce(length(p.report), 0) AS report_length, coalesce(f.n, 0) AS n_findings, coalesce(s.n, 0) AS n_sources FROM f_runs r
    LEFT JOIN f_reports p ON p.run_id = r.run_id LEFT JOIN (SELECT run_id, count(*) AS n FROM f_findings GROUP BY 1) f ON f.run_id = r.run_id
    LEFT JOIN (SELECT run_id, count(*) AS n FROM f_sources GROUP BY 1) s ON s.run_id = r.run_id""")  # fmt: skip
def _(v):
    rows = archive.show_runs(v["f_runs"], v["f_reports"], v["f_findings"], v["f_sources"])
    return rows.select("run_id", F.col("report_length").cast("bigint").alias("report_length"), "n_findings", "n_sources")


PLAN = """
    SELECT strategy, session_ts, run_id, CASE WHEN NOT complete THEN 'skipped' WHEN broken THEN 'failed' WHEN known THEN 'upgraded' ELSE 'imported' END AS status,
           CASE WHEN NOT complete THEN 'missing files' WHEN broken THEN 'unreadable: meta.json' END AS reason FROM (
        SELECT strategy, CAST(run_id AS VARCHAR) AS session_ts,
               CASE WHEN run_id % 3 = 0 THEN CAST(run_id AS VARCHAR) ELSE 'imported__' || strategy || '__' || run_id END AS run_id,
               status = 'completed' AS complete, run_id % 7 = 3 AS broken, run_id % 3 = 0 AND archived_rank > 500 AS known FROM f_runs)"""


def _plan(v: Views) -> DataFrame:
    number = F.col("run_id").cast("string")
    sessions = v["f_runs"].select("strategy", number.alias("session_ts"), F.when(F.col("run_id") % 3 == 0, number).alias("meta_run_id"), (F.col("status") == "completed").alias("complete"), F.when(F.col("run_id") % 7 == 3, "meta.json").alias("broken"))
    known = v["f_runs"].where("archived_rank > 500").select(number.alias("run_id"))
    return archive.plan_import(sessions, known, upgrade_existing=True)


@query("j6_plan_import", PLAN)
def _(v):
    return _plan(v).select("strategy", "session_ts", "run_id", "status", "reason")


@query("a3_import_summary", f"""
    SELECT count(*) AS scanned, count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'upgraded') AS upgraded,
           count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM ({PLAN})""")  # fmt: skip
def _(v):
    return archive.import_summary(_plan(v))


@query("j11_delete_runs", "SELECT id, run_id, message FROM f_logs WHERE run_id NOT IN (SELECT run_id FROM f_runs WHERE status = 'failed')")
def _(v):
    gone = v["f_runs"].where("status = 'failed'")
    return archive.delete_runs(v["f_runs"], v["f_logs"], v["f_sources"], gone)["logs"].select("id", "run_id", "message")


@query("j12_load_runs", """
    SELECT r.run_id, query, strategy, status, archived_rank, report, f.findings, s.sources FROM f_runs r LEFT JOIN f_reports p ON p.run_id = r.run_id
    LEFT JOIN (SELECT run_id, string_agg(concat_ws('|', finding_index, iteration, question, error), chr(10) ORDER BY finding_index) AS findings FROM f_findings GROUP BY run_id) f
      ON f.run_id = r.run_id
    LEFT JOIN (SELECT run_id, string_agg(concat_ws('|', finding_index, source_index, title, url, content, fetch_status), chr(10) ORDER BY finding_index, source_index) AS sources
               FROM f_sources GROUP BY run_id) s ON s.run_id = r.run_id""")  # fmt: skip
def _(v):
    """The nested findings and sources are shown as lines of text."""
    rows = archive.load_runs(v["f_runs"], v["f_findings"], v["f_sources"], v["f_reports"])
    lines = lambda name, *fields: F.array_join(F.transform(name, lambda x: F.concat_ws("|", *[x[f] for f in fields])), "\n")
    return rows.withColumn("findings", lines("findings", "finding_index", "iteration", "question", "error")).withColumn(
        "sources", lines("sources", "finding_index", "source_index", "title", "url", "content", "fetch_status")
    )


@query("s4_archive_runs", f"""
    SELECT run_id, source_index, dedup_id FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id, dedup_id ORDER BY source_index) AS n FROM (
            SELECT run_id, finding_index * 1000 + source_index AS source_index,
                   coalesce(nullif({TRIM("url")}, ''), sha256(concat_ws(':', coalesce(title, ''), coalesce(snippet, ''), coalesce(content, '')))) AS dedup_id FROM f_sources))
    WHERE n = 1""")  # fmt: skip
def _(v):
    """All runs archived, and archived again: the sources after both."""
    flat = v["f_sources"].withColumn("source_index", F.col("finding_index") * 1000 + F.col("source_index")).drop("finding_index")
    findings = v["f_findings"].withColumnRenamed("finding_index", "seq")
    batch = (_runs(v), findings, flat, v["f_reports"])
    once = archive.archive_runs(None, *batch)
    return archive.archive_runs(once, *batch)["sources"].select("run_id", "source_index", "dedup_id")


def _session_root(v: Views) -> str:
    """All runs written as sessions into the shared folder."""
    root = f"{shared_dir(v.spark)}/factloom/sessions-{uuid.uuid4().hex}"
    runs = v["f_runs"].select("run_id", "query", "strategy", F.timestamp_seconds(F.col("run_id")).alias("created_at"))
    findings = v["f_findings"].select("run_id", F.col("finding_index").alias("seq"), "question", "iteration")
    flat = v["f_sources"].select("run_id", (F.col("finding_index") * 1000 + F.col("source_index")).alias("source_index"), "title", "url", "snippet", "content", "summary", "engine", F.col("fetch_status").alias("fetchStatus"))
    files.write_sessions(runs, findings, flat, v["f_reports"], root)
    return root


def _sessions(v: Views) -> dict[str, DataFrame]:
    return files.read_sessions(v.spark, _session_root(v))


def _break(v: Views, root: str) -> Callable[[], None]:
    """Leaves half of findings.json in every seventh session; what mends them again."""
    number = F.unix_timestamp(F.to_timestamp("session_ts", "yyyy-MM-dd_HHmmss"))
    whole = written(files.session_files(v.spark.read, root).where("file = 'findings.json'").where(number % 7 == 3).select("strategy", "session_ts", "file", "value"), "whole-files")

    def put(value: Column) -> None:
        files.put_files(whole.withColumn("value", value), root)

    put(F.expr("substring(value, 1, length(value) - 2)"))
    return lambda: put(F.col("value"))


@query("s1_broken_sessions", """
    SELECT strategy, strftime(make_timestamp(run_id * 1000000), '%Y-%m-%d_%H%M%S') AS session_ts, CASE WHEN run_id % 7 = 3 THEN 'failed' ELSE 'imported' END AS status,
           CASE WHEN run_id % 7 = 3 THEN 'unreadable: findings.json' END AS reason, CASE WHEN run_id % 7 = 3 THEN 0 ELSE n END AS n_findings
    FROM f_runs JOIN (SELECT run_id, count(*) AS n FROM f_findings GROUP BY run_id) USING (run_id)""")  # fmt: skip
def _(v):
    """The plan of an import where every seventh session is broken, and how many findings it brings."""
    root = _session_root(v)
    _break(v, root)
    made = files.read_sessions(v.spark, root)
    plan = archive.plan_import(made["sessions"], made["runs"].select("run_id").limit(0))
    n = made["findings"].groupBy("run_id").agg(F.count("*").alias("n_findings"))
    return plan.join(n, "run_id", "left").fillna(0, ["n_findings"]).select("strategy", "session_ts", "status", "reason", "n_findings")


@query("st3_stream_sessions", """
    SELECT CAST(run_id AS VARCHAR) AS run_id, query, strategy, n AS n_findings, CASE WHEN run_id % 7 = 3 THEN 'failed' ELSE 'archived' END AS first, 'archived' AS last
    FROM f_runs JOIN (SELECT run_id, count(*) AS n FROM f_findings GROUP BY run_id) USING (run_id)""")  # fmt: skip
def _(v):
    """All sessions archived as they come, every seventh of them broken; and again when those are mended."""
    root = _session_root(v)
    mend, base = _break(v, root), f"{shared_dir(v.spark)}/factloom/stream-{uuid.uuid4().hex}"

    def take(tables: dict[str, DataFrame]) -> None:
        runs = tables["runs"].withColumn("archived_at", F.col("created_at"))
        archive.archive_batch(f"{base}/archive", runs, tables["findings"], tables["sources"], tables["reports"])

    seen = []
    for _ in range(2):
        feeds.stream_sessions(v.spark, root, take, f"{base}/checkpoint", f"{base}/outcomes").awaitTermination()
        now = feeds.session_outcomes(v.spark, f"{base}/outcomes")
        seen.append(written(now.select(F.regexp_extract("folder", r"([^/=]+)$", 1).alias("session_ts"), "status"), "outcomes"))
        mend()
    kept = archive.read_archive(v.spark, f"{base}/archive")
    rows = kept["runs"].select("run_id", "query", "strategy", "session_ts").join(kept["findings"].groupBy("run_id").agg(F.count("*").alias("n_findings")), "run_id")
    for name, some in zip(("first", "last"), seen, strict=True):
        rows = rows.join(some.withColumnRenamed("status", name), "session_ts")
    return rows.drop("session_ts")


@query("s1_read_sessions", """
    SELECT CAST(r.run_id AS VARCHAR) AS run_id, query, strategy, strftime(make_timestamp(r.run_id * 1000000), '%Y-%m-%d_%H%M%S') AS session_ts, coalesce(report, '') AS report,
           questions, n_findings
    FROM f_runs r LEFT JOIN f_reports p ON p.run_id = r.run_id
    JOIN (SELECT run_id, count(*) AS n_findings, string_agg(iteration || '|' || question, chr(10) ORDER BY finding_index) AS questions FROM f_findings GROUP BY run_id) f ON f.run_id = r.run_id""")  # fmt: skip
def _(v):
    made = _sessions(v)
    line = F.struct("seq", F.concat_ws("|", "iteration", "question").alias("text"))
    asked = made["findings"].groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), "\n").alias("questions"), F.count("*").alias("n_findings"))
    return made["runs"].select("run_id", "query", "strategy", "session_ts").join(made["reports"], "run_id").join(asked, "run_id")


@query("s2_write_sessions", """
    SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY finding_index, source_index) AS INTEGER) AS source_index,
           title, url, snippet, content, summary, engine, fetch_status FROM f_sources""")  # fmt: skip
def _(v):
    return _sessions(v)["sources"].select("run_id", "source_index", "title", "url", "snippet", "content", "summary", "engine", F.col("fetchStatus").alias("fetch_status"))


@query("s3_archive_in_place", f"""
    SELECT run_id, finding_index * 1000 + source_index AS source_index, title, url, archive_runs FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id, coalesce(nullif({TRIM("url")}, ''), sha256(concat_ws(':', coalesce(title, ''), coalesce(snippet, ''), coalesce(content, ''))))
                                     ORDER BY finding_index, source_index) AS n, (SELECT count(*) FROM f_runs) AS archive_runs FROM f_sources) WHERE n = 1""")  # fmt: skip
def _(v):
    """Runs with even ids are archived, then all runs into the same archive; its sources and number of runs."""
    base = f"{shared_dir(v.spark)}/factloom/archive-{uuid.uuid4().hex}"
    flat = v["f_sources"].withColumn("source_index", F.col("finding_index") * 1000 + F.col("source_index")).drop("finding_index")
    batch = (_runs(v), v["f_findings"].withColumnRenamed("finding_index", "seq"), flat, v["f_reports"])
    batch = [written(df, "batch") for df in batch]  # both batches ask for each several times
    for some in ([df.where("run_id % 2 = 0") for df in batch], batch):
        archive.archive_batch(base, *some)
    kept = archive.read_archive(v.spark, base)
    return kept["sources"].select("run_id", "source_index", "title", "url").crossJoin(kept["runs"].agg(F.count("*").alias("archive_runs")))  # with a single row


@query("s3_archive_of_some_runs", """
    SELECT run_id, query, strategy, coalesce(length(report), 0) AS report_length, n AS n_findings
    FROM f_runs LEFT JOIN f_reports USING (run_id) JOIN (SELECT run_id, count(*) AS n FROM f_findings GROUP BY run_id) USING (run_id)
    WHERE run_id IN (SELECT run_id FROM f_runs ORDER BY archived_rank DESC, run_id DESC LIMIT 5)""")  # fmt: skip
def _(v):
    """The archive of all runs, read for the five archived last: of the folders only those runs' buckets."""
    base = f"{shared_dir(v.spark)}/factloom/archive-{uuid.uuid4().hex}"
    flat = v["f_sources"].withColumn("source_index", F.col("finding_index") * 1000 + F.col("source_index")).drop("finding_index")
    archive.archive_batch(base, _runs(v), v["f_findings"].withColumnRenamed("finding_index", "seq"), flat, v["f_reports"])
    last = [r[0] for r in v["f_runs"].orderBy(F.desc("archived_rank"), F.desc("run_id")).limit(5).select("run_id").collect()]
    kept = archive.read_archive(v.spark, base, last)
    n = kept["findings"].groupBy("run_id").agg(F.count("*").alias("n_findings"))
    return kept["runs"].join(n, "run_id").select("run_id", "query", "strategy", F.col("report_length").cast("bigint").alias("report_length"), "n_findings")


@query("s6_read_history", """
    SELECT 'history' AS part, CAST(run_id AS VARCHAR) AS run_id, CAST(archived_rank AS BIGINT) AS id, status AS text FROM f_runs
    UNION ALL SELECT 'logs', CAST(run_id AS VARCHAR), id, message FROM f_logs
    UNION ALL SELECT 'sources', CAST(run_id AS VARCHAR), finding_index * 1000 + source_index, url FROM f_sources""")  # fmt: skip
def _(v):
    """The three tables written under their stored names, and read."""
    base = f"{shared_dir(v.spark)}/factloom/history-{uuid.uuid4().hex}"
    own = F.col("run_id").cast("string")
    v["f_runs"].select(own.alias("id"), "status", F.col("archived_rank").cast("bigint").alias("created_at")).write.parquet(f"{base}/history")
    v["f_logs"].select("id", own.alias("research_id"), "message").write.parquet(f"{base}/logs")
    v["f_sources"].select((F.col("finding_index") * 1000 + F.col("source_index")).cast("bigint").alias("id"), own.alias("research_id"), "url").write.parquet(f"{base}/history_sources")
    made = files.read_history(v.spark, base)
    rows = [("history", "created_at", "status"), ("logs", "id", "message"), ("history_sources", "id", "url")]
    parts = [made[n].select(F.lit(n.removeprefix("history_")).alias("part"), "run_id", F.col(i).alias("id"), F.col(t).alias("text")) for n, i, t in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("w9_history_list", "SELECT run_id, status, archived_rank AS created_at FROM f_runs")
def _(v):
    return archive.history_list(v["f_runs"].select("run_id", "status", F.col("archived_rank").alias("created_at")))


# ---- wiki ----


FILE = lambda x, n=120: (
    "(SELECT CASE WHEN length(c) > {n} THEN {cut} ELSE c END FROM (SELECT coalesce(nullif(regexp_replace({clean}, '\\.+$', ''), ''), 'Untitled') AS c))".format(
        n=n, cut=TRIM(f"substring(c, 1, {n})"), clean=COLLAPSE(rf"""regexp_replace({x}, '[<>:"/\\|?*#^\[\]]', '', 'g')""")
    )
)
YAML = lambda x: rf"""CASE WHEN regexp_matches({x}, '[:#\[\]{{}}&*!|>''"%@`\n]') THEN '"' || replace(replace({x}, '\', '\\'), '"', '\"') || '"' ELSE {x} END"""
ESCAPED = lambda x: rf"regexp_replace({x}, '\[\[([^\]]+)\]\]', '`[[\1]]`', 'g')"
N = "chr(10)"
#: Wiki sources with the paths and names of their pages.
WIKI = rf"""
    wiki_told AS (
        SELECT s.run_id, s.finding_index * 1000 + s.source_index AS i, coalesce(title, '') AS title, coalesce(url, '') AS url, coalesce(snippet, '') AS snippet,
               coalesce(content, summary, '') AS content, coalesce(query, '') AS query, strategy, coalesce(engine, '') AS engine, status, archived_rank,
               array_to_string(list_transform(string_split({COLLAPSE("coalesce(nullif(query, ''), CAST(s.run_id AS VARCHAR))")}, ' '), lambda w: replace(upper(w[1]), 'ẞ', 'SS') || lower(w[2:])), ' ') AS topic
        FROM f_sources s JOIN f_runs r ON r.run_id = s.run_id
    ), wiki_sources AS (
        SELECT *, run_id || '/source-' || i AS id, 'Sources/' || {FILE("CAST(run_id AS VARCHAR)", 80)} || '/' || {FILE("('Source ' || i || ' - ' || coalesce(nullif(title, ''), 'Untitled'))", 100)} AS page,
               'Topics/' || {FILE("topic")} AS topic_page, 'Claims/' || {FILE("(topic || ' Claims')")} AS claims_page FROM wiki_told
    ), source_pages AS (
        SELECT page || '.md' AS path, 'source' AS type, run_id, id AS source_id, topic, status,
               '---' || {N} || 'type: source' || {N} || 'title: ' || {YAML("coalesce(nullif(title, ''), 'Source ' || i)")} || {N} || 'researchId: ' || run_id || {N} || 'sourceId: ' || id || {N}
               || 'url: ' || CASE WHEN url = '' THEN 'null' ELSE {YAML("url")} END || {N} || 'tags:' || {N} || '  - source' || {N} || '  - ' || strategy || {N}
               || 'topic: ' || {YAML("topic")} || {N} || 'updated: {DAY}' || {N} || '---' || {N} || {N}
               || {TRIM(f'''concat_ws({N}, '# ' || coalesce(nullif(title, ''), 'Untitled Source'), {N} || '## Metadata' || {N}, '- URL: ' || coalesce(nullif(url, ''), '(none)'),
                   '- Research: ' || run_id, '- Query: ' || coalesce(nullif(query, ''), '(none)'), '- Engine: ' || nullif(engine, ''), {N} || '## Evidence' || {N},
                   CASE WHEN snippet = '' THEN '_No snippet._' ELSE '> ' || {ESCAPED("snippet")} END, '',
                   CASE WHEN content <> '' AND content <> snippet THEN '### Content' || {N} || {N} || {ESCAPED("substring(content, 1, 4000)")} END,
                   {N} || '## Artifact Paths' || {N}, {N} || '## Related' || {N}, '- Topic: [[' || topic_page || ']]')''')} || {N} AS content
        FROM wiki_sources
    ), wiki_runs AS (
        SELECT run_id, any_value(topic) AS topic, any_value(topic_page) AS topic_page, any_value(claims_page) AS claims_page, any_value(archived_rank) AS archived_rank, count(*) AS n_sources,
               string_agg('  - ' || id, {N} ORDER BY i) AS ids, string_agg('- [[' || page || '|' || coalesce(nullif(title, ''), 'Source ' || i) || ']]', {N} ORDER BY i) AS links,
               string_agg('- [[' || page || '|' || coalesce(nullif(title, ''), id) || ']]', {N} ORDER BY i) AS claim_links
        FROM wiki_sources GROUP BY run_id
    ), topic_runs AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_page ORDER BY archived_rank DESC, run_id DESC) AS n FROM wiki_runs) WHERE n = 1
    ), topic_pages AS (
        SELECT topic_page || '.md' AS path, 'topic' AS type, t.run_id, topic, n_sources,
               '---' || {N} || 'type: topic' || {N} || 'title: ' || {YAML("topic")} || {N} || 'aliases:' || {N} || '  - ' || {YAML("topic")} || {N} || 'tags:' || {N} || '  - topic'
               || array_to_string(list_transform(list_filter(string_split(lower(topic), ' '), lambda w: w <> '')[1:3], lambda w: {N} || '  - ' || {YAML("w")}), '') || {N}
               || 'sources:' || {N} || ids || {N} || 'updated: {DAY}' || {N} || '---' || {N} || {N}
               || {TRIM(f'''concat_ws({N}, '# ' || topic, {N} || '## Summary' || {N},
                   coalesce(nullif(substring({TRIM(f"list_filter(string_split(coalesce(report, ''), {N}), lambda l: {TRIM('l')} <> '' AND NOT starts_with(l, '#'))[1]")}, 1, 800), ''), '_Compiled from research sources._'),
                   {N} || '## Related Sources' || {N}, links, {N} || '## Claims' || {N}, '- [[' || claims_page || '|' || topic || ' Claims]]')''')} || {N} AS content
        FROM topic_runs t LEFT JOIN f_reports r ON r.run_id = t.run_id
    ), {BULLETS}, bullets_told AS (
        SELECT run_id, count(*) AS n, string_agg(claim_index || '. **' || coalesce(nullif(section, ''), 'General') || '**: ' || text
            || CASE WHEN regexp_matches(text, '\[\d+\.\d+\]') THEN ' _(has citation)_' ELSE ' _(no citation)_' END, {N} ORDER BY claim_index) AS told
        FROM numbered WHERE claim_index <= 50 GROUP BY run_id
    ), claim_runs AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claims_page ORDER BY archived_rank DESC, run_id DESC) AS n FROM wiki_runs) WHERE n = 1
    ), claim_pages AS (
        SELECT claims_page || '.md' AS path, 'claim' AS type, c.run_id, topic, coalesce(b.n, 0) AS claim_count,
               '---' || {N} || 'type: claim' || {N} || 'topic: ' || {YAML("topic")} || {N} || 'tags:' || {N} || '  - claim' || {N} || 'claimCount: ' || coalesce(b.n, 0) || {N}
               || 'updated: {DAY}' || {N} || '---' || {N} || {N}
               || {TRIM(f'''concat_ws({N}, '# ' || topic || ' Claims', {N} || 'Topic: [[' || topic_page || ']]', {N} || '## Extracted Claims' || {N},
                   coalesce(told, '_No extractable claims from report._'), {N} || '## Source Index' || {N}, claim_links)''')} || {N} AS content
        FROM claim_runs c LEFT JOIN bullets_told b ON b.run_id = c.run_id
    ), index_lines AS (
        SELECT string_agg('- [[' || t.topic_page || '|' || topic || ']]', {N} ORDER BY topic) AS home,
               string_agg('### [[' || t.topic_page || '|' || topic || ']]' || {N} || {N} || '- Sources: ' || n_sources || {N} || '- Claims: [[' || claims_page || '|Claims]]' || {N}, {N} ORDER BY topic) AS map
        FROM topic_runs t
    ), index_pages AS (
        SELECT 'Home.md' AS path, 'home' AS type, '---' || {N} || 'type: home' || {N} || 'title: Home' || {N} || 'updated: {DAY}' || {N} || '---' || {N} || {N}
               || {TRIM(f"'# Home' || {N} || {N} || '- [[Map of Content|Map of Content]]' || {N} || {N} || '## Topics' || {N} || {N} || home")} || {N} AS content FROM index_lines
        UNION ALL
        SELECT 'Map of Content.md', 'moc', '---' || {N} || 'type: moc' || {N} || 'title: Map of Content' || {N} || 'updated: {DAY}' || {N} || '---' || {N} || {N}
               || {TRIM(f"'# Map of Content' || {N} || {N} || '## Topics' || {N} || {N} || map")} || {N} FROM index_lines
    ), wiki_pages AS (
        SELECT path, type, content FROM source_pages WHERE status IN ('failed', 'cancelled') UNION ALL SELECT path, type, content FROM topic_pages
        UNION ALL SELECT path, type, content FROM claim_pages UNION ALL SELECT path, type, content FROM index_pages
    )"""
HASH = "sha256(CAST(to_json(struct_pack(title := title, url := url, snippet := snippet, content := content, run_id := CAST(run_id AS VARCHAR), query := query)) AS VARCHAR))"
LINK = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
LINT = rf"""{WIKI}, bare_pages AS (
        SELECT path, regexp_replace(regexp_replace(content, '`[^`]*`', ' ', 'g'), '(?s)```.*?```', ' ', 'g') AS t FROM wiki_pages
    ), page_links AS (
        SELECT path, CAST(position AS INTEGER) AS position, {TRIM(f"regexp_extract(m, '{LINK}', 1)")} AS target, nullif({TRIM(f"regexp_extract(m, '{LINK}', 2)")}, '') AS alias
        FROM (SELECT path, unnest(ms) AS m, generate_subscripts(ms, 1) AS position FROM (SELECT path, regexp_extract_all(t, '{LINK}') AS ms FROM bare_pages))
    ), resolved_links AS (
        SELECT l.*, coalesce(a.path, b.path) AS resolved_path, a.path IS NOT NULL OR b.path IS NOT NULL AS exists
        FROM page_links l LEFT JOIN (SELECT DISTINCT path FROM wiki_pages) a ON a.path = regexp_replace(l.path, '[^/]*$', '') || target || '.md'
        LEFT JOIN (SELECT DISTINCT path FROM wiki_pages) b ON b.path = target || '.md'
    ), issues AS (
        SELECT 'warn' AS severity, 'missing_url' AS code, page || '.md' AS path, CAST(NULL AS VARCHAR) AS detail FROM wiki_sources WHERE status IN ('failed', 'cancelled') AND url = ''
        UNION ALL SELECT 'error', 'broken_wikilink', path, target FROM resolved_links WHERE NOT exists
        UNION ALL SELECT 'error', 'manifest_missing_page', page || '.md', id FROM wiki_sources WHERE status <> 'failed' AND page || '.md' NOT IN (SELECT path FROM wiki_pages)
    ), summed AS (
        SELECT count(*) AS issue_count, count(*) FILTER (severity = 'error') AS error_count, count(*) FILTER (severity = 'warn') AS warn_count,
               count(*) FILTER (severity = 'error') = 0 AS ok FROM issues
    )"""


@query("p10_normalize_wiki_sources", f"""
    SELECT run_id || '/source-' || lpad(CAST(finding_index * 1000 + source_index AS VARCHAR), CAST(greatest(3, length(CAST(finding_index * 1000 + source_index AS VARCHAR))) AS INTEGER), '0') AS id,
           run_id, title, url, coalesce(content, summary, '') AS content, length(coalesce(content, summary, '')) AS content_length,
           {TRIM("coalesce(content, summary, '')")} <> '' AS has_content, 'research-source' AS kind FROM f_sources""")  # fmt: skip
def _(v):
    return wiki_inputs(v)[0].select("id", "run_id", "title", "url", "content", F.col("content_length").cast("bigint").alias("content_length"), "has_content", "kind")


@query("j10_missing_runs", "SELECT DISTINCT doc_id AS run_id, 'run not found' AS error FROM documents WHERE doc_id NOT IN (SELECT run_id FROM f_runs)")
def _(v):
    """Every document's id is asked for as a run's."""
    return wiki.missing_runs(v.table("documents").select(F.col("doc_id").alias("run_id")).distinct(), v["f_runs"])


@query("j10_run_reports", """
    SELECT run_id, CASE WHEN run_id % 2 = 0 THEN coalesce(report, 'of the file ' || run_id) WHEN run_id % 3 = 0 THEN 'of the file ' || run_id ELSE '' END AS report
    FROM f_runs LEFT JOIN f_reports USING (run_id)""")  # fmt: skip
def _(v):
    """Reports of runs with even ids are in the archive; those of others, of every third, in a file."""
    reports = v["f_reports"].select("run_id", F.when(F.col("run_id") % 2 == 0, F.col("report")).otherwise("").alias("report"))
    known = v["f_runs"].where("run_id % 2 = 0 OR run_id % 3 = 0").select("run_id", F.concat(F.lit("of the file "), F.col("run_id").cast("string")).alias("text"))
    return wiki.run_reports(v["f_runs"], reports, known)


@query("a5_group_sources", f"""
    WITH {WIKI} SELECT run_id, count(*) AS n_sources, string_agg(concat_ws('|', i, id, title, url, content), {N} ORDER BY i) AS sources FROM wiki_sources GROUP BY run_id""")  # fmt: skip
def _(v):
    """The nested sources are shown as lines of text."""
    line = lambda s: F.concat_ws("|", s["source_index"], s["id"], s["title"], s["url"], s["content"])
    return wiki.group_sources(wiki_inputs(v)[0]).select("run_id", "n_sources", F.array_join(F.transform("sources", line), "\n").alias("sources"))


@query("t13_source_hashes", f"WITH {WIKI} SELECT id, {HASH} AS hash FROM wiki_sources")
def _(v):
    return wiki.source_hashes(wiki_inputs(v)[0]).select("id", "hash")


def _manifest(v: Views, told: DataFrame | None = None) -> DataFrame:
    """As after a compile of all sources, but for those of failed runs, and with stale hashes for cancelled ones."""
    hashed = wiki.source_hashes(wiki_inputs(v)[0] if told is None else told).join(v["f_runs"].select("run_id", "status"), "run_id").where("status <> 'failed'")
    old = F.when(F.col("status") == "cancelled", "stale").otherwise(F.col("hash"))
    path = wiki.source_path(F.col("run_id"), F.col("source_index"), F.col("title"))
    return hashed.select(F.col("id").alias("source_id"), old.alias("hash"), F.array(path).alias("pages"), "run_id", F.to_timestamp(F.lit(DAY)).alias("updated_at"))


@query("j7_plan_recompile", f"WITH {WIKI} SELECT id, status IN ('failed', 'cancelled') AS recompile FROM wiki_sources")
def _(v):
    return wiki.plan_recompile(wiki.source_hashes(wiki_inputs(v)[0]), _manifest(v)).select("id", "recompile")


def _compiled(v: Views) -> dict[str, DataFrame]:
    """A compile after that manifest (``old``). Sources and manifest are scratch tables: many parts of a compile ask for them."""
    told, reports = wiki_inputs(v)
    told = written(told, "wiki-sources")
    old = written(_manifest(v, told), "manifest")
    made = wiki.compile_wiki(told, written(reports, "reports"), old.where("hash <> 'stale'"), DAY)
    return made | {"old": old}


def _pages(v: Views) -> tuple[DataFrame, DataFrame]:
    """Pages of a compile, and the manifest before it."""
    made = _compiled(v)
    return written(made["pages"], "pages"), made["old"]


@query("k6_compile_wiki", f"""
    WITH {WIKI} SELECT compiled, skipped, n_topics, compiled + 2 * n_topics + 2 AS n_pages FROM (
        SELECT count(*) FILTER (status IN ('failed', 'cancelled')) AS compiled, count(*) FILTER (status NOT IN ('failed', 'cancelled')) AS skipped,
               (SELECT count(*) FROM topic_runs) AS n_topics FROM wiki_sources)""")  # fmt: skip
def _(v):
    return _compiled(v)["summary"]


@query("k1_source_pages", f"WITH {WIKI}, hashes AS (SELECT id, {HASH} AS hash FROM wiki_sources) SELECT path, type, run_id, source_id, hash, topic, content FROM source_pages JOIN hashes ON id = source_id")
def _(v):
    told, _ = wiki_inputs(v)
    return wiki.compile_source_pages(wiki.plan_recompile(wiki.source_hashes(told), _manifest(v), force=True), DAY)


@query("k2_topic_pages", f"WITH {WIKI} SELECT * FROM topic_pages")
def _(v):
    return wiki.compile_topic_pages(*wiki_inputs(v), DAY)


@query("k3_claim_pages", f"WITH {WIKI} SELECT * FROM claim_pages")
def _(v):
    told, reports = wiki_inputs(v)
    return wiki.compile_claim_pages(reports, told, DAY)


@query("k4_index_pages", f"WITH {WIKI} SELECT * FROM index_pages")
def _(v):
    return wiki.compile_index_pages(wiki.compile_topic_pages(*wiki_inputs(v), DAY), DAY)


@query("k5_update_manifest", f"WITH {WIKI} SELECT id AS source_id, {HASH} AS hash, page || '.md' AS pages, run_id FROM wiki_sources")
def _(v):
    """After a compile the manifest holds every source once, with its present hash."""
    return _compiled(v)["manifest"].select("source_id", "hash", F.array_join("pages", "|").alias("pages"), "run_id")


@query("k7_lint_wiki", f"WITH {LINT} SELECT * FROM issues")
def _(v):
    return wiki.lint_wiki(*_pages(v))


@query("a4_lint_summary", f"WITH {LINT} SELECT * FROM summed")
def _(v):
    return wiki.lint_summary(wiki.lint_wiki(*_pages(v)))


@query("a7_wiki_status", f"""
    WITH {LINT} SELECT (SELECT count(*) FROM wiki_sources WHERE status <> 'failed') AS n_sources, TIMESTAMP '{DAY} 00:00:00' AS compiled_at,
        (SELECT count(DISTINCT topic) FROM topic_runs) AS n_topics, summed.* FROM summed""")  # fmt: skip
def _(v):
    made = _compiled(v)
    return wiki.wiki_status(made["old"], made["topics"], wiki.lint_wiki(written(made["pages"], "pages"), made["old"]))


@query("j5_missing_manifest_pages", f"WITH {WIKI} SELECT id AS source_id, page || '.md' AS path FROM wiki_sources WHERE status NOT IN ('failed', 'cancelled')")
def _(v):
    """Pages that this compile didn't write anew are missing from its own output."""
    made, old = _pages(v)
    return wiki.missing_manifest_pages(old.where("hash <> 'stale'"), made)


@query("t7_j4_links", f"WITH {LINT} SELECT * FROM resolved_links")
def _(v):
    made, _ = _pages(v)
    return pages.resolve_links(pages.extract_links(made), made)


@query("t8_frontmatter", rf"""
    WITH {WIKI}, fronts AS (SELECT path, regexp_extract(content, '(?s)^---\n(.*?)\n---', 1) AS b FROM wiki_pages)
    SELECT path, array_to_string(list_transform(regexp_extract_all(b, '(?m)^[a-zA-Z0-9_-]+:[ \t]*\S.*$'), lambda l: regexp_extract(l, '^([a-zA-Z0-9_-]+):', 1) || '='
        || {TRIM(r"""regexp_replace(regexp_extract(l, '^[a-zA-Z0-9_-]+:[ \t]*(.*)$', 1), '^["'']|["'']$', '', 'g')""")}), chr(10)) AS fields,
        CAST(len(regexp_extract_all(b, '(?m)^[a-zA-Z0-9_-]+:[ \t]*$')) AS INTEGER) AS n_lists FROM fronts""")  # fmt: skip
def _(v):
    """The fields are shown as lines of text."""
    rows = pages.read_frontmatter(_pages(v)[0])
    shown = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")
    return rows.select("path", shown.alias("fields"), F.size("lists").alias("n_lists"))


@query("t9_page_titles", rf"""
    WITH {WIKI}, named AS (
        SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(?i)\.md$', '') AS name, regexp_extract(regexp_extract(content, '(?s)^---\n(.*?)\n---', 1), '(?m)^title: (.*)$', 1) AS title
        FROM wiki_pages)
    SELECT path, coalesce(nullif({TRIM(r"""regexp_replace(title, '^["'']|["'']$', '', 'g')""")}, ''), regexp_replace(name, '^Source \d{{3}} - ', '')) AS title FROM named""")  # fmt: skip
def _(v):
    return pages.page_titles(_pages(v)[0])


# ---- rounds ----

BLOCKS = f"""
    blocks AS (
        SELECT f.run_id, f.finding_index, 'Question: ' || f.question || chr(10) || 'Sources:' || chr(10) || coalesce(string_agg(
            '[' || s.finding_index || '.' || s.source_index || '] ' || s.title || chr(10) || s.url || chr(10) || 'Evidence: ' || {EVIDENCE("s.")},
            chr(10) || chr(10) ORDER BY s.source_index) FILTER (s.run_id IS NOT NULL), '') AS block
        FROM f_findings f LEFT JOIN f_sources s ON s.run_id = f.run_id AND s.finding_index = f.finding_index GROUP BY f.run_id, f.finding_index, f.question
    )"""


@query("a8_evidence_block", f"WITH {BLOCKS} SELECT run_id, md5(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY finding_index)) AS evidence_md5 FROM blocks GROUP BY run_id")
def _(v):
    return rounds.evidence_block(v["f_findings"], v["f_sources"]).select("run_id", F.md5("evidence").alias("evidence_md5"))


@query("a9_recent_context", f"""
    SELECT run_id, md5(string_agg('Source ' || number || ': ' || coalesce(nullif(title, ''), 'Untitled') || chr(10) || 'URL: ' || url || chr(10) || 'Evidence: '
        || CASE WHEN length(e) > 500 THEN substring(e, 1, 500) || '...' ELSE e END, chr(10) || chr(10) ORDER BY number)) AS context_md5
    FROM (SELECT *, {EVIDENCE()} AS e FROM ({LAST.format(30)})) GROUP BY run_id""")  # fmt: skip
def _(v):
    return rounds.recent_context(v["f_sources"]).select("run_id", F.md5("context").alias("context_md5"))


def _prompts(v: Views) -> DataFrame:
    return rounds.batch_prompts(v["f_sources"], v["f_runs"])


PROMPTS = f"""
    prompts AS (
        SELECT run_id, batch, count(*) AS n_items, 'Research query: ' || any_value(query) || chr(10) || chr(10) || 'Rate source relevance:' || chr(10)
               || string_agg(i || '. ' || coalesce(nullif(title, ''), 'Untitled') || chr(10) || 'URL: ' || coalesce(url, '') || chr(10) || 'Evidence: ' || e, chr(10) || chr(10) ORDER BY i) AS prompt
        FROM (
            SELECT s.*, {EVIDENCE("s.")} AS e, CAST(floor((n - 1) / 10) AS INTEGER) AS batch, (n - 1) % 10 + 1 AS i FROM (
                SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY finding_index, source_index) AS n FROM (
                    SELECT *, row_number() OVER (PARTITION BY run_id, coalesce(nullif(url, ''), coalesce(title, '') || ':' || coalesce(snippet, ''))
                                                 ORDER BY finding_index, source_index) AS again FROM f_sources) WHERE again = 1) s) b
        JOIN f_runs USING (run_id) GROUP BY run_id, batch
    )"""


@query("a10_batch_prompts", f"WITH {PROMPTS} SELECT run_id, batch, n_items, prompt FROM prompts")
def _(v):
    return _prompts(v)


DECISIONS = "SELECT run_id, url, min(doc_id) % 7 <> 0 AS keep, (min(doc_id) % 10) / 10.0 AS score, 'r' AS reason FROM f_sources WHERE url <> '' GROUP BY run_id, url"


@query("j3_filter_by_relevance", f"""
    WITH decided AS ({DECISIONS}), firsts AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, coalesce(nullif(url, ''), coalesce(title, '') || ':' || coalesce(snippet, ''))
                                                    ORDER BY finding_index, source_index) AS n FROM f_sources) WHERE n = 1
    ), kept AS (
        SELECT run_id, url, score FROM (
            SELECT f.run_id, f.url, coalesce(score, 0.5) AS score,
                   row_number() OVER (PARTITION BY f.run_id ORDER BY coalesce(score, 0.5) DESC, finding_index, source_index) AS place
            FROM firsts f LEFT JOIN decided d ON d.run_id = f.run_id AND d.url = f.url WHERE coalesce(keep, true)) WHERE place <= 4 AND url <> '')
    SELECT run_id, finding_index, source_index, CAST(score AS DOUBLE) AS score FROM f_sources JOIN kept USING (run_id, url)""")  # fmt: skip
def _(v):
    told = v["f_sources"].where("url <> ''").groupBy("run_id", "url").agg(F.min("doc_id").alias("d"))
    told = told.select("run_id", "url", (F.col("d") % 7 != 0).alias("keep"), ((F.col("d") % 10) / 10.0).alias("score"), F.lit("r").alias("reason"))
    return rounds.filter_by_relevance(v["f_sources"], told, 4).select("run_id", "finding_index", "source_index", "score")


def _page_text(v: Views) -> DataFrame:
    return pages.extract_page_text(v.table("pages")).dropDuplicates(["url"])


@query("j2_enrich_sources", """
    SELECT run_id, finding_index, source_index, CASE WHEN p.url IS NULL THEN fetch_status ELSE 'ok' END AS fetch_status
    FROM f_sources s LEFT JOIN (SELECT DISTINCT url FROM pages) p ON p.url = s.url AND s.url <> ''""")  # fmt: skip
def _(v):
    return rounds.enrich_sources(v["f_sources"], _page_text(v)).select("run_id", "finding_index", "source_index", "fetch_status")


@query("u2_resolve_content", "SELECT DISTINCT url, 'ok' AS status FROM f_sources WHERE url <> ''")
def _(v):
    urls = v["f_sources"].where("url <> ''").select("url").distinct()
    handler = _page_text(v).withColumn("status", F.when(F.contains("url", F.lit("example.com")), "ok").otherwise("unsupported"))
    return rounds.resolve_content(urls, [_page_text(v), handler]).select("url", "status")


@query("u1_complete_prompts", f"""
    WITH {PROMPTS} SELECT run_id || '-' || batch AS prompt_id, '[' || ((length(prompt) - length(replace(prompt, 'URL: ', ''))) // 5) || ']' AS response,
        CAST(NULL AS VARCHAR) AS error FROM prompts""")  # fmt: skip
def _(v):
    """Every batch prompt answered by a callable on the executors."""
    named = _prompts(v).select(F.concat_ws("-", "run_id", "batch").alias("prompt_id"), "prompt")
    return rounds.complete_prompts(named, lambda text: f"[{text.count('URL: ')}]").drop("prompt")


@query("t11_parse_relevance", f"""
    WITH {PROMPTS} SELECT run_id, batch, CAST(i AS INTEGER) AS item, i > told OR i % 3 <> 0 AS keep, CASE WHEN i > told THEN 0.5 ELSE CAST(i % 10 AS DOUBLE) / 10 END AS score,
        '' AS reason, true AS parsed
    FROM (SELECT run_id, batch, greatest(n_items - 1, 1) AS told, unnest(range(1, n_items + 1)) AS i FROM prompts)""")  # fmt: skip
def _(v):
    item = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_items").cast("int") - 1, F.lit(1))), lambda i: F.format_string('{"index": %d, "keep": %s, "score": 0.%d}', i, F.when(i % 3 == 0, "false").otherwise("true"), i % 10))
    told = _prompts(v).withColumn("response", F.concat(F.lit("Here: ["), F.array_join(item, ", "), F.lit("] done")))
    return rounds.parse_relevance(told)


@query("t12_parse_questions", f"""
    SELECT conv_id AS run_id, turn, array_to_string(CASE WHEN turn % 2 = 0 AND {TRIM("text")} <> '' THEN [{TRIM("text")}] ELSE [role] END, '|') AS questions FROM conversations""")  # fmt: skip
def _(v):
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Sure: "), F.to_json(F.array("text", F.lit(" "))), F.lit("."))).otherwise(F.lit("nothing"))
    rows = v.table("conversations").select(F.col("conv_id").alias("run_id"), "turn", F.col("role").alias("query"), reply.alias("response"))
    return rounds.parse_questions(rows).select("run_id", "turn", F.array_join("questions", "|").alias("questions"))


def _corpus(v: Views) -> DataFrame:
    return v.table("documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


CLEANED = lambda name, of: f"""{name} AS (
        SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY position) AS INTEGER) AS finding_index, question FROM (
            SELECT *, row_number() OVER (PARTITION BY run_id, question ORDER BY position) AS n
            FROM (SELECT run_id, position, {TRIM("question")} AS question FROM ({of})) WHERE question <> '') WHERE n = 1)"""  # noqa: E731
#: The best pages of a round's cleaned questions.
FOUND = lambda name, asked, k: f"""{name} AS (
        SELECT run_id, finding_index, CAST(place AS INTEGER) AS source_index, path AS title, path AS url, substring(text, 1, 400) AS snippet FROM (
            SELECT *, row_number() OVER (PARTITION BY run_id, finding_index ORDER BY score DESC, path) AS place FROM (
                SELECT run_id, finding_index, path, any_value(text) AS text, sum(points) AS score FROM (
                    SELECT run_id, finding_index, path, text, 1 AS points
                    FROM (SELECT run_id, finding_index, unnest(regexp_split_to_array(lower(question), '{SPACE}+')) AS w FROM {asked}) JOIN corpus ON length(w) > 2 AND contains(t, w)
                    UNION ALL SELECT run_id, finding_index, path, text, 5 FROM {asked} JOIN corpus ON contains(t, lower(question)))
                GROUP BY ALL)) WHERE place <= {k})"""  # noqa: E731
CORPUS = "corpus AS (SELECT 'docs/' || doc_id AS path, text, lower(text) AS t FROM documents)"


@query("l1_search_round", f"""
    WITH {CORPUS}, {CLEANED("asked", "SELECT run_id, finding_index AS position, question FROM f_findings WHERE run_id % 20 = 0")}, {FOUND("found", "asked", 3)}
    SELECT found.*, question FROM found JOIN asked USING (run_id, finding_index)""")  # fmt: skip
def _(v):
    """The query set is every conversation whose id is divisible by 20."""
    asked = v["f_findings"].where("run_id % 20 = 0").select("run_id", F.col("finding_index").alias("position"), "question")
    findings, found = rounds.search_round(asked, _corpus(v), k=3)
    return found.join(findings.select("run_id", "finding_index", "question"), ["run_id", "finding_index"])


@query("l2_run_rounds", f"""
    WITH {CORPUS}, {CLEANED("first_asked", "SELECT run_id, finding_index AS position, question FROM f_findings WHERE run_id % 20 = 0 AND finding_index <= 2")},
    {FOUND("first_found", "first_asked", 3)},
    {CLEANED("next_asked", """SELECT f.run_id, f.finding_index AS position, f.question FROM f_findings f JOIN f_runs r ON r.run_id = f.run_id
        WHERE f.run_id % 20 = 0 AND strategy <> 'rapid' AND f.finding_index = CASE WHEN f.run_id IN (SELECT run_id FROM first_found) THEN 3 ELSE 2 END""")},
    {FOUND("next_found", "next_asked", 3)}, ahead AS (SELECT run_id, max(finding_index) AS n FROM first_asked GROUP BY run_id)
    SELECT found.*, question, 1 AS iteration, strategy FROM first_found found JOIN first_asked USING (run_id, finding_index) JOIN f_runs USING (run_id)
    UNION ALL
    SELECT found.run_id, found.finding_index + n, source_index, title, url, snippet, question, 2, strategy
    FROM next_found found JOIN next_asked USING (run_id, finding_index) JOIN ahead USING (run_id) JOIN f_runs USING (run_id)""")  # fmt: skip
def _(v):
    """Two rounds under its own strategy of every run whose id is divisible by 20; once sources give a context, the run's next question follows."""
    runs = v["f_runs"].where("run_id % 20 = 0")
    later = v["f_findings"].select("run_id", F.col("finding_index").alias("position"), "question")

    def ask(told: DataFrame, count: int) -> DataFrame:
        passed = F.when(F.col("context") == "", 1).otherwise(1 + count)
        rows = later.join(told.select("run_id", "context"), "run_id")
        return rows.where((F.col("position") > passed) & (F.col("position") <= passed + count)).drop("context")

    asked = runs.select("run_id", "query", "strategy")
    findings, found = rounds.run_strategies(asked, ask, lambda q: rounds.search_round(q, _corpus(v), k=3), count=1)
    rows = found.join(findings.select("run_id", "finding_index", "question", "iteration"), ["run_id", "finding_index"])
    return rows.join(asked.select("run_id", "strategy"), "run_id")


@query("l2_rounds_that_read", f"""
    WITH {CORPUS}, runs AS (SELECT * FROM f_runs WHERE run_id % 10 = 0 AND strategy = 'source-based'),
    {CLEANED("first_asked", "SELECT run_id, finding_index AS position, question FROM f_findings WHERE run_id IN (SELECT run_id FROM runs) AND finding_index <= 2")},
    {FOUND("first_found", "first_asked", 3)},
    {CLEANED("next_asked", """SELECT run_id, finding_index AS position, question FROM f_findings
        WHERE run_id IN (SELECT run_id FROM runs) AND finding_index = CASE WHEN run_id IN (SELECT run_id FROM first_found) THEN 3 ELSE 2 END""")},
    {FOUND("next_found", "next_asked", 3)}, ahead AS (SELECT run_id, max(finding_index) AS n FROM first_asked GROUP BY run_id), found AS (
        SELECT 1 AS iteration, finding_index AS local, * FROM first_found
        UNION ALL SELECT 2, finding_index, run_id, finding_index + n, source_index, title, url, snippet FROM next_found JOIN ahead USING (run_id)
    ), read AS (
        SELECT f.*, doc_id, text, CASE WHEN doc_id % 4 = 3 THEN 'failed' ELSE 'ok' END AS status FROM found f JOIN documents ON url = 'docs/' || doc_id
    ), ones AS (SELECT *, status = 'ok' AS good FROM read WHERE local = 1 AND source_index <= 2), twos AS (
        SELECT r.iteration, r.run_id, r.local, r.url, row_number() OVER (PARTITION BY r.iteration, r.run_id ORDER BY r.source_index) AS place
        FROM read r WHERE local = 2 AND NOT EXISTS (SELECT 1 FROM ones o WHERE o.iteration = r.iteration AND o.run_id = r.run_id AND o.url = r.url)
          AND (SELECT count(*) FILTER (good) FROM ones o WHERE o.iteration = r.iteration AND o.run_id = r.run_id) < 2
    ), chosen AS (
        SELECT iteration, run_id, local, url FROM ones UNION ALL SELECT iteration, run_id, local, url FROM twos WHERE place <= 2
    ), enriched AS (
        SELECT r.*, c.url IS NOT NULL AS asked FROM read r LEFT JOIN chosen c ON c.iteration = r.iteration AND c.run_id = r.run_id AND c.local = r.local AND c.url = r.url
    ), best AS (
        SELECT run_id, url, row_number() OVER (PARTITION BY run_id ORDER BY doc_id % 10 DESC, finding_index, source_index) AS place
        FROM (SELECT * FROM enriched QUALIFY row_number() OVER (PARTITION BY run_id, url ORDER BY finding_index, source_index) = 1) WHERE doc_id % 3 <> 0
    )
    SELECT e.run_id, e.finding_index, iteration, source_index, e.url, CASE WHEN asked AND status = 'ok' THEN text END AS content,
           CASE WHEN asked THEN status END AS fetch_status, CASE WHEN asked AND status = 'failed' THEN 'gone' END AS fetch_error, (doc_id % 10) / 10.0::DOUBLE AS score
    FROM enriched e JOIN best b ON b.run_id = e.run_id AND b.url = e.url AND place <= 4""")  # fmt: skip
def _(v):
    """Two rounds of every source-based run whose id is divisible by 10: pages are read in each, two a finding, and sources judged at the end."""
    asked = v["f_runs"].where("run_id % 10 = 0 AND strategy = 'source-based'").select("run_id", "query")
    later = v["f_findings"].select("run_id", F.col("finding_index").alias("position"), "question")
    number = F.regexp_extract("url", r"(\d+)$", 1).cast("bigint")

    def ask(told: DataFrame, count: int) -> DataFrame:
        passed = F.when(F.col("context") == "", 1).otherwise(1 + count)
        rows = later.join(told.select("run_id", "context"), "run_id")
        return rows.where((F.col("position") > passed) & (F.col("position") <= passed + count)).drop("context")

    def read(urls: DataFrame) -> DataFrame:
        failed = number % 4 == 3
        pages = urls.join(_corpus(v).withColumnRenamed("path", "url"), "url")
        return pages.select("url", F.lit(None).cast("string").alias("title"), "content", F.when(failed, "failed").otherwise("ok").alias("status"), F.when(failed, "gone").alias("error"))

    def judge(found: DataFrame) -> DataFrame:
        return found.select("run_id", "url").distinct().select("run_id", "url", (number % 3 != 0).alias("keep"), (number % 10 / 10).alias("score"), F.lit("").alias("reason"))

    findings, found = rounds.run_rounds(
        asked, "source-based", ask, lambda q: rounds.search_round(q, _corpus(v), k=3), count=1, read=read, judge=judge, per_finding=2, total=2, max_sources=4
    )
    rows = found.join(findings.select("run_id", "finding_index", "iteration"), ["run_id", "finding_index"])
    return rows.select("run_id", "finding_index", "iteration", "source_index", "url", "content", "fetch_status", "fetch_error", "score")


@query("u3_strategy_labels", """
    SELECT run_id, CASE strategy WHEN 'rapid' THEN 'one round of the query and a few follow-ups' WHEN 'parallel' THEN 'rounds with the last 12 sources as context'
           ELSE 'rounds with evidence of the last 30 sources as context' END AS label FROM f_runs""")  # fmt: skip
def _(v):
    return v["f_runs"].select("run_id", rounds.label_of(F.col("strategy")).alias("label"))


@query("d4_union_rounds", "SELECT run_id, finding_index, CASE WHEN iteration = 1 THEN 1 ELSE 2 END AS iteration FROM f_findings")
def _(v):
    rows = v["f_findings"]
    return sources.union_rounds([rows.where("iteration = 1"), rows.where("iteration > 1")]).select("run_id", "finding_index", "iteration")


# ---- feeds ----

STAGES = ("research_started", "generating_questions", "searching", "search_item_complete", "search_progress", "enriching_sources", "filtering_sources", "synthesizing_report", "research_complete", "other")


def _events(v: Views) -> DataFrame:
    at = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("event_id") % 10 + 1).cast("int"))
    return v.table("events").select(
        "event_id", at.alias("stage"), (F.col("event_id") % 3 + 1).cast("int").alias("iteration"), F.lit(3).alias("iterations"), (F.col("event_id") % 6).cast("int").alias("completed"),
        F.lit(5).alias("total"), F.col("event_type").alias("question"), F.lit(None).cast("string").alias("level"),
    )


@query("st1_progress", """
    SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'Research started' WHEN 1 THEN 'Generating research questions' WHEN 2 THEN 'Running 5 searches' WHEN 3 THEN 'Search complete: ' || event_type
               WHEN 4 THEN 'Completed ' || event_id % 6 || '/5 searches for iteration ' || (event_id % 3 + 1) WHEN 5 THEN 'Enriching sources for iteration ' || (event_id % 3 + 1) || '/3'
               WHEN 6 THEN 'Filtering sources for relevance' WHEN 7 THEN 'Synthesizing report' WHEN 8 THEN 'Research complete' ELSE 'Research progress: other' END AS message,
           CAST(CASE event_id % 10 WHEN 0 THEN 5 WHEN 1 THEN base WHEN 2 THEN base + 5 WHEN 3 THEN 25 + floor(done * 45 + 0.5) WHEN 4 THEN base + 5 + floor(done * 50 / 3 + 0.5)
        WHEN 5 THEN base + 8 WHEN 6 THEN 75 WHEN 7 THEN 80 WHEN 8 THEN 100 END AS INTEGER) AS progress
    FROM (SELECT event_id, event_type, 10 + floor((event_id % 3) / 3.0 * 60 + 0.5) AS base, (event_id % 6) / 5.0 AS done FROM events)""")  # fmt: skip
def _(v):
    return feeds.progress_from_events(_events(v)).select("event_id", "message", "progress")


@query("st2_latest_status", """
    SELECT run_id, max(id) AS last_id, arg_max(message, id) AS message, arg_max(created_at, id) AS updated_at, arg_max(progress, id) FILTER (progress IS NOT NULL) AS progress,
           count(*) AS n_logs, count(*) FILTER (level = 'error') AS n_errors FROM f_logs GROUP BY run_id""")  # fmt: skip
def _(v):
    return feeds.latest_status(v["f_logs"])


@query("st4_log_feed", """
    SELECT run_id, CAST(0 AS BIGINT) AS seq, 'status' AS kind, status AS message, CAST(NULL AS INTEGER) AS progress FROM f_runs
    UNION ALL SELECT run_id, id + 1, 'log', message, progress FROM f_logs""")  # fmt: skip
def _(v):
    return feeds.log_feed(v["f_runs"], v["f_logs"])
