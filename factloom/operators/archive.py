"""The archive of runs: four keyed tables, brought in without repeats, planned, read back and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import filled, trimmed, unused
from factloom.operators.sources import add_dedup_id
from factloom.sources import store

VERSION = 2
ARCHIVE_FIELDS = ("_post_id", "_entity_id", "_seq", "seq", "dedup_id", "raw")


def strip_archive_fields(rows: DataFrame, wiki: bool = False) -> DataFrame:
    """Without the archive's own columns; for the wiki without ``archived_at`` too."""
    return rows.drop(*ARCHIVE_FIELDS, *(["archived_at"] if wiki else []))


def add_archive_fields(sources: DataFrame) -> DataFrame:
    """``sources`` with has_content, content_length (of content, else summary, trimmed) and archived_at, fetch fields null where absent."""
    rows = sources
    for name in ("summary", "content", "fetch_status", "fetch_error"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    if "archived_at" not in rows.columns:
        rows = rows.withColumn("archived_at", F.current_timestamp())
    length = F.length(F.coalesce(trimmed(F.coalesce("content", "summary")), F.lit("")))
    return rows.withColumn("content_length", length).withColumn("has_content", F.col("content_length") > 0)


def _best(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key, whatever the columns are called."""
    name = unused(rows, "n")
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) == 1).drop(name)


def latest_rows(old: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row with the highest ``order``; the new one among equals."""
    mark = unused(new, "new")
    both = new.withColumn(mark, F.lit(1))
    if old is not None:
        both = both.unionByName(old.withColumn(mark, F.lit(0)), allowMissingColumns=True)
    return _best(both, keys, F.col(order).desc_nulls_last(), F.desc(mark)).drop(mark)


def absent_rows(old: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``old`` and the first new row of each key that it lacks."""
    fresh = _best(new, keys, F.col(order))
    if old is None:
        return fresh
    return old.unionByName(fresh.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def archive_runs(old: dict[str, DataFrame] | None, runs: DataFrame, findings: DataFrame, sources: DataFrame, reports: DataFrame, upgrade: bool = False) -> dict[str, DataFrame]:
    """The four tables after a batch, and ``rejected`` runs without an id.

    Runs (with counts taken before deduplication) and reports replace what is there; findings are kept once
    by (run_id, seq); sources enter only where their (run_id, dedup_id) is new, with their own index, or
    replace it with ``upgrade``.
    """
    old = old or {}
    known = F.coalesce(trimmed(F.col("run_id").cast("string")), F.lit("")) != ""
    count = lambda df, name: df.groupBy("run_id").agg(F.count("*").cast("int").alias(name))
    length = reports.select("run_id", F.length(F.coalesce("report", F.lit(""))).alias("report_length"))
    summary = runs.where(known)
    for extra in (count(findings, "findings_count"), count(sources, "sources_count"), length):
        summary = summary.join(extra, "run_id", "left")
    summary = summary.fillna(0, ["findings_count", "sources_count", "report_length"]).withColumn("archive_version", F.lit(VERSION))
    told = add_dedup_id(add_archive_fields(sources.where(known)))
    keys = ["run_id", "dedup_id"]
    stamps = runs.where(known).select("run_id", "archived_at")  # not of the summary, whose counts go over all sources
    stamped = reports.where(known).join(stamps, "run_id")
    return {
        "runs": latest_rows(old.get("runs"), summary, ["run_id"], "archived_at"),
        "reports": latest_rows(old.get("reports"), stamped, ["run_id"], "archived_at"),
        "findings": latest_rows(old.get("findings"), findings.where(known).join(stamps, "run_id"), ["run_id", "seq"], "archived_at"),
        "sources": latest_rows(old.get("sources"), told, keys, "archived_at") if upgrade else absent_rows(old.get("sources"), told, keys, "source_index"),
        "rejected": runs.where(~known),
    }


KEYS = {"runs": ["run_id"], "reports": ["run_id"], "findings": ["run_id", "seq"], "sources": ["run_id", "dedup_id"]}


def _merged(name: str):
    """Of each key of a table in deltas the row archived last, and of equals the one that came last."""
    return lambda rows: _best(rows, KEYS[name], F.col("archived_at").desc_nulls_last(), F.desc("delta")).drop("delta", "bucket")


def archive_batch(
    base: str, runs: DataFrame, findings: DataFrame, sources: DataFrame, reports: DataFrame, upgrade: bool = False, buckets: int = store.BUCKETS
) -> DataFrame:
    """Brings a batch into the archive under ``base``, as ``archive_runs`` says; the rejected runs.

    Only the batch's own rows are written, into the buckets of their runs; of the archive no more is read than the
    keys of sources in those buckets. The same batch again changes nothing.
    """
    spark = runs.sparkSession
    made = archive_runs(None, runs, findings, sources, reports, upgrade)
    tables = {name: made[name] for name in KEYS}
    there = store.read(spark, base)
    if there and not upgrade:
        known = there["sources"]
        number = store.bucket_count(spark, base)
        touched = [r[0] for r in sources.select(store.bucket_of(F.col("run_id"), number)).distinct().collect()]  # as many as buckets at most
        known = known.where(F.col("bucket").isin(touched)).select(*KEYS["sources"])
        tables["sources"] = tables["sources"].join(known, KEYS["sources"], "left_anti")
    store.write(tables, base, {name: _merged(name) for name in KEYS}, buckets)
    return made["rejected"]


def read_archive(spark: SparkSession, base: str, run_ids: list | None = None) -> dict[str, DataFrame]:
    """The four tables of the archive, or those rows of them that ``run_ids`` name, of which only their buckets are read; {} where there is none."""
    return {name: _merged(name)(rows) for name, rows in store.read(spark, base, run_ids).items()}


def plan_import(sessions: DataFrame, runs: DataFrame, skip_existing: bool = True, upgrade_existing: bool = False, dry_run: bool = False) -> DataFrame:
    """``sessions`` (strategy, session_ts, meta_run_id, complete, and ``broken`` if any can be) with run_id, ``status`` and ``reason``."""
    own = F.concat_ws("__", F.lit("imported"), "strategy", "session_ts")
    rows = sessions.withColumn("run_id", filled("meta_run_id", own))
    mark = unused(rows, "known")
    rows = rows.join(runs.select("run_id", F.lit(True).alias(mark)).distinct(), "run_id", "left")
    known = F.coalesce(mark, F.lit(False))
    upgrade = known & F.lit(upgrade_existing)
    broken = F.col("broken") if "broken" in sessions.columns else F.lit(None).cast("string")
    status = (
        F.when(~F.col("complete"), "skipped")
        .when(broken.isNotNull(), "failed")
        .when(known & F.lit(skip_existing and not upgrade_existing), "skipped")
        .when(F.lit(dry_run), F.when(upgrade, "dry-run-upgrade").otherwise("dry-run"))
        .when(upgrade, "upgraded")
        .otherwise("imported")
    )
    reason = F.when(~F.col("complete"), "missing files").when(broken.isNotNull(), F.concat(F.lit("unreadable: "), broken)).when(known & F.lit(skip_existing and not upgrade_existing), "already archived")
    return rows.withColumns({"status": status, "reason": reason}).drop(mark)


def import_summary(plan: DataFrame) -> DataFrame:
    n = lambda *names: F.count_if(F.col("status").isin(*names))
    return plan.agg(
        F.count("*").alias("scanned"),
        n("imported", "dry-run").alias("imported"),
        n("upgraded", "dry-run-upgrade").alias("upgraded"),
        n("skipped").alias("skipped"),
        n("failed").alias("failed"),
    )


def list_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest first by archived_at, else last_seen, else first_seen; ties by id."""
    at = F.coalesce(*[F.col(c) for c in ("archived_at", "last_seen", "first_seen") if c in runs.columns])
    return runs.orderBy(at.desc_nulls_last(), "run_id").limit(limit)


def latest_run_id(runs: DataFrame) -> DataFrame:
    """The run archived last; of equals the largest id."""
    return runs.agg(F.max(F.struct("archived_at", "run_id"))["run_id"].alias("run_id"))


def show_runs(runs: DataFrame, reports: DataFrame, findings: DataFrame, sources: DataFrame) -> DataFrame:
    """Each run with its report's length and its numbers of findings and sources."""
    count = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias(name))
    told = reports.select("run_id", F.length("report").alias("_length"))
    rows = runs.join(told, "run_id", "left").join(count(findings, "n_findings"), "run_id", "left").join(count(sources, "n_sources"), "run_id", "left")
    own = F.col("report_length") if "report_length" in runs.columns else F.lit(None).cast("int")
    length = F.coalesce("_length", own, F.lit(0))
    rows = rows.withColumn("report_length", length).drop("_length")
    return rows.fillna(0, ["n_findings", "n_sources"])


def list_run_sources(sources: DataFrame, limit: int = 50) -> DataFrame:
    """Of each run the first sources by index, with their title, url, engine and fetch status."""
    order = Window.partitionBy("run_id").orderBy("finding_index", "source_index")
    rows = sources.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    return rows.select("run_id", "n", filled("title", F.lit("Untitled source")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), "engine", "fetch_status")


def list_run_findings(findings: DataFrame, sources: DataFrame, limit: int = 50) -> DataFrame:
    """Of each run the first findings, with how many sources each has."""
    order = Window.partitionBy("run_id").orderBy("finding_index")
    rows = findings.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    counts = sources.groupBy("run_id", "finding_index").agg(F.count("*").alias("source_count"))
    rows = rows.join(counts, ["run_id", "finding_index"], "left").fillna(0, ["source_count"])
    return rows.select("run_id", "n", "question", "iteration", "error", "source_count")


def load_runs(runs: DataFrame, findings: DataFrame, sources: DataFrame, reports: DataFrame) -> DataFrame:
    """One row for each run: its columns, report, and findings and sources nested in order."""
    nested = lambda df, order, name: df.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in ("run_id", *order)]))).alias(name)
    )
    rows = runs.join(reports.select("run_id", "report"), "run_id", "left")
    rows = rows.join(nested(strip_archive_fields(findings), ["finding_index"], "findings"), "run_id", "left")
    return rows.join(nested(strip_archive_fields(sources), ["finding_index", "source_index"], "sources"), "run_id", "left")


def delete_runs(history: DataFrame, logs: DataFrame, sources: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """The three tables without the runs in ``ids``, and which of those ids there were."""
    gone = ids.select("run_id").distinct()
    left = {name: df.join(gone, "run_id", "left_anti") for name, df in (("history", history), ("logs", logs), ("sources", sources))}
    there = history.select("run_id", F.lit(True).alias("deleted")).distinct()
    return left | {"deleted": gone.join(there, "run_id", "left").fillna(False, ["deleted"])}


def history_list(history: DataFrame) -> DataFrame:
    """Newest first; ties by id."""
    return history.orderBy(F.col("created_at").desc(), "run_id")
