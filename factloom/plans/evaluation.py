"""Runs judged by their claims: health of findings, rates, examples of risk, and all of it from raw reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import filled, percent, rate
from factloom.operators import claims as C
from factloom.sources.scratch import written


def findings_health(findings: DataFrame, sources: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Per run: findings, errors, sources, what could be read, rates and flags. Evidence of spaces counts here.

    Every status of a source is an attempt to read it. With ``runs`` those without findings have a row too.
    """
    told = sources.withColumn("_e", filled("summary", "content", "snippet").isNotNull())
    per = told.groupBy("run_id").agg(
        F.count("*").alias("n_sources"),
        F.count_if("_e").alias("n_evidence"),
        F.count_if(filled("content").isNotNull()).alias("n_content"),
        F.count_if(F.col("fetch_status") == "ok").alias("n_ok"),
        F.count_if(F.col("fetch_status") == "failed").alias("n_failed"),
        F.countDistinct("finding_index").alias("n_with_sources"),
        F.count(filled("fetch_status")).alias("n_attempted"),
    )
    rows = findings.groupBy("run_id").agg(F.count("*").alias("n_findings"), F.count("error").alias("n_errors"))
    if runs is not None:
        rows = runs.select("run_id").join(rows, "run_id", "left")
    rows = rows.join(per, "run_id", "left")
    rows = rows.fillna(0, [c for c in rows.columns if c != "run_id"])
    flags = {
        "empty_sources": F.col("n_sources") == 0,
        "all_findings_failed": (F.col("n_findings") > 0) & (F.col("n_errors") == F.col("n_findings")),
        "no_finding_sources": (F.col("n_findings") > 0) & (F.col("n_with_sources") == 0),
        "enrichment_all_failed": (F.col("n_attempted") > 0) & (F.col("n_ok") == 0),
    }
    return rows.select(
        "*",
        rate(F.col("n_evidence"), F.col("n_sources")).alias("evidence_rate"),
        rate(F.col("n_content"), F.col("n_sources")).alias("content_rate"),
        rate(F.col("n_ok"), F.col("n_attempted")).alias("ok_rate"),
        F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in flags.items()])), ",").alias("flags"),
    )


def benchmark_metrics(judged: DataFrame, health: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Per run: claims and rates of citation, resolution, complete sources, platform and verdicts (of those not skipped).

    With ``runs`` those without claims have a row of zeros.
    """
    spoken = ~F.col("skipped")
    verdict = lambda v: F.count_if(spoken & (F.col("verdict") == v))
    sums = judged.groupBy("run_id").agg(
        F.count("*").alias("claim_count"),
        F.count_if("has_citations").alias("cited"),
        F.sum("n_citations").alias("citations"),
        F.sum("n_resolved").alias("resolved"),
        F.sum("n_complete").alias("complete"),
        F.count_if("platform_match").alias("matching"),
        F.count_if(spoken).alias("judged"),
        *[verdict(v).alias(v) for v in C.VERDICTS],
    )
    if runs is not None:
        sums = runs.select("run_id").join(sums, "run_id", "left")
        sums = sums.fillna(0, [c for c in sums.columns if c != "run_id"])
    c = F.col
    out = sums.select(
        "run_id",
        "claim_count",
        rate(c("cited"), c("claim_count")).alias("claims_with_citations_rate"),
        rate(c("resolved"), c("citations")).alias("citation_resolution_rate"),
        rate(c("complete"), c("resolved")).alias("source_presence_rate"),
        rate(c("matching"), c("claim_count")).alias("platform_match_rate"),
        *[rate(c(v), c("judged")).alias(f"{v}_rate") for v in C.VERDICTS],
    )
    if health is not None:
        told = health.select("run_id", c("ok_rate").alias("enrich_ok_rate"), c("content_rate").alias("content_presence_rate"))
        out = out.join(told, "run_id", "left").fillna(0.0, ["enrich_ok_rate", "content_presence_rate"])
    return out


def risk_examples(judged: DataFrame, n: int = 10) -> DataFrame:
    """Of each run the first n claims with a flag or a verdict of unsupported or partly supported."""
    risky = (F.size("flags") > 0) | F.coalesce(F.col("verdict").isin("unsupported", "partially_supported"), F.lit(False))
    order = Window.partitionBy("run_id").orderBy("claim_index")
    return judged.where(risky).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def evaluate_runs(
    reports: DataFrame, findings: DataFrame, sources: DataFrame, verdicts: DataFrame | None = None, platform: str | None = None, runs: DataFrame | None = None
) -> dict[str, DataFrame]:
    """From raw reports: claims with scores and verdicts, metrics, health and risk examples.

    Every run has metrics and health: those in ``runs``, by default those with a report or a finding. Claims and their citations, without
    texts of sources, are written once, as four results read them.
    """
    claims = written(C.extract_claims(reports), "claims")
    resolved = written(C.resolve_citations(C.parse_citations(claims), sources, claims), "citations")
    judged = C.judge_claims(C.score_claims(claims, resolved, platform), verdicts)
    if runs is None:
        runs = reports.select("run_id").union(findings.select("run_id")).distinct()
    health = findings_health(findings, sources, runs)
    return {"claims": judged, "health": health, "metrics": benchmark_metrics(judged, health, runs), "risks": risk_examples(judged)}


def benchmark_summary(metrics: DataFrame, judged: DataFrame) -> DataFrame:
    """One row for each run with its metrics, percent texts and claims nested: what ``write_benchmark_summary`` writes."""
    claim = F.struct("claim_index", "section", "text", "citation_keys", "unresolved", "overlap", "flags", "verdict")
    nested = judged.groupBy("run_id").agg(F.array_sort(F.collect_list(claim)).alias("claims"))
    shown = [percent(c).alias(c.removesuffix("_rate") + "_percent") for c in metrics.columns if c.endswith("_rate")]
    return metrics.select("*", *shown).join(nested, "run_id", "left")


def write_benchmark_summary(metrics: DataFrame, judged: DataFrame, path: str) -> None:
    benchmark_summary(metrics, judged).write.mode("overwrite").json(path)
