"""Research records drawn from the given tables, whole, in SQL that Spark and DuckDB both read.

Every user turn of a conversation is a finding; a document is a source of the finding whose number it shares by
counting round, unless that finding failed, with the page it shares in the same way; every error and label gives a report, a log row or a verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each view by name, in order; later ones use earlier ones.
VIEWS = {
    "f_findings": """
        SELECT conv_id AS run_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS finding_index,
               CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 2) AS INT) + 1 AS iteration,
               text AS question, turn, CASE WHEN (conv_id + turn) % 17 = 0 THEN 'boom' END AS error
        FROM {conversations} WHERE role = 'user'""",
    "f_runs": """
        SELECT run_id, question AS query,
               CASE run_id % 3 WHEN 0 THEN 'rapid' WHEN 1 THEN 'parallel' ELSE 'source-based' END AS strategy,
               CASE run_id % 10 WHEN 8 THEN 'failed' WHEN 9 THEN 'cancelled' ELSE 'completed' END AS status,
               CAST(run_id * 37 % 1009 AS INT) AS archived_rank
        FROM {f_findings} WHERE finding_index = 1""",
    "f_sizes": """
        SELECT (SELECT max(conv_id) + 1 FROM {conversations}) AS n_runs, (SELECT max(page_id) + 1 FROM {pages}) AS n_pages""",
    "f_sources": """
        SELECT f.run_id, f.finding_index,
               CAST(row_number() OVER (PARTITION BY f.run_id, f.finding_index ORDER BY d.doc_id) AS INT) AS source_index,
               'Page ' || CAST(p.page_id AS STRING) AS title,
               CASE WHEN d.doc_id % 13 = 0 THEN '' ELSE p.url END AS url,
               split_part(d.text, chr(10), 1) AS snippet,
               CASE WHEN d.doc_id % 4 < 2 THEN d.text END AS content,
               CASE WHEN d.doc_id % 8 = 0 THEN split_part(d.text, chr(10), 2) END AS summary,
               d.source AS engine,
               CASE d.doc_id % 8 WHEN 2 THEN 'failed' WHEN 6 THEN 'failed' WHEN 3 THEN 'skipped' WHEN 7 THEN NULL ELSE 'ok' END AS fetch_status,
               p.page_id, d.doc_id
        FROM (SELECT x.*, doc_id % n_runs AS run, doc_id % n_pages AS page FROM {documents} x CROSS JOIN {f_sizes}) d
        JOIN (SELECT run_id, max(finding_index) AS last FROM {f_findings} GROUP BY run_id) r ON r.run_id = d.run
        JOIN {f_findings} f ON f.run_id = d.run AND f.finding_index = 1 + d.doc_id % r.last
        JOIN {pages} p ON p.page_id = d.page
        WHERE f.error IS NULL""",
    "f_report_lines": """
        SELECT f.run_id, f.finding_index,
               '- ' || s.snippet || CASE f.finding_index % 4
                   WHEN 0 THEN '' WHEN 1 THEN ' [' || CAST(f.finding_index AS STRING) || '.1]'
                   WHEN 2 THEN ' [' || CAST(f.finding_index AS STRING) || '.1-' || CAST(f.finding_index AS STRING) || '.3]'
                   ELSE ' [9.9][' || CAST(f.finding_index AS STRING) || '.2]' END AS line
        FROM {f_findings} f JOIN {f_sources} s ON s.run_id = f.run_id AND s.finding_index = f.finding_index AND s.source_index = 1""",
    "f_logs": """
        SELECT event_id AS id, user_id AS run_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
               event_type AS message, CAST(floor(value) AS INT) % 101 AS progress, ts AS created_at
        FROM {events}""",
    "f_verdicts": """
        SELECT doc_id, 'ok: {{"verdict": "' || CASE WHEN quality = 1 AND toxic = 0 THEN 'supported'
                 WHEN quality = 1 THEN 'partially_supported' WHEN toxic = 0 THEN 'unverifiable' ELSE 'unsupported' END
               || '", "confidence": ' || CASE doc_id % 3 WHEN 0 THEN '1.4' WHEN 1 THEN '0.6' ELSE '-1' END || ', "reason": " r "}} end' AS response
        FROM {labels}""",
}
REPORT = """
        SELECT run_id, '# Report' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10)
               || 'Run ' || CAST(run_id AS STRING) || ' looks at the first topic [1.1].' || chr(10) || 'It spans two lines.' || chr(10) || chr(10)
               || '## Key Findings' || chr(10) || chr(10) || {lines} || chr(10) || chr(10)
               || '## Sources' || chr(10) || chr(10) || '- [1.1] list' || chr(10) AS report
        FROM {f_report_lines} GROUP BY run_id"""
TABLES = ("conversations", "pages", "documents", "events", "labels")


class Views:
    """The views over the tables in a folder, as DataFrames by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            lines = "array_join(transform(array_sort(collect_list(struct(finding_index, line))), x -> x.line), chr(10))"
            text = VIEWS.get(name) or REPORT.replace("{lines}", lines)
            used = {v for v in (*VIEWS, *TABLES) if f"{{{v}}}" in text}
            frames = {v: self.table(v) if v in TABLES else self[v] for v in used}
            self._made[name] = self.spark.sql(text, **frames)
        return self._made[name]


def with_views(query: str) -> str:
    """DuckDB SQL of a query over the views: the views as WITH clauses before it."""
    names = {t: t for t in (*TABLES, *VIEWS)} | {"lines": "string_agg(line, chr(10) ORDER BY finding_index)"}
    made = {name: text.format(**names) for name, text in (VIEWS | {"f_reports": REPORT}).items()}
    query = query.strip()
    clauses = ", ".join(f"{name} AS ({text})" for name, text in made.items())
    if query.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {clauses}, {query[14:].lstrip()}"
    return f"WITH {clauses}" + (", " + query[4:].lstrip() if query.upper().startswith("WITH") else f" {query}")
