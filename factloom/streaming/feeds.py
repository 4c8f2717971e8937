"""Logs and progress of runs, in batch or as they come; sessions archived as they arrive."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.files import session_files, tables_of_sessions
from factloom.sources.scratch import listed, remove, written

TERMINAL = ("completed", "failed", "cancelled")


def _whole(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + 0.5)


def progress_from_events(events: DataFrame) -> DataFrame:
    """``events`` (stage, iteration, iterations, completed, total, question, level) with ``message`` and ``progress``; works on streams."""
    c = F.col
    rounds = (F.coalesce("iteration", F.lit(0)) > 0) & (F.coalesce("iterations", F.lit(0)) > 0)
    # of none there is no share, and no progress to tell
    base = 10 + _whole(F.try_divide(c("iteration") - 1, c("iterations")) * 60)
    done = F.try_divide("completed", "total")
    text = lambda column: c(column).cast("string")
    #: What each stage says and how far it is.
    stages = {
        "research_started": (F.lit("Research started"), F.lit(5)),
        "generating_questions": (F.lit("Generating research questions"), F.when(rounds, base).otherwise(10)),
        "searching": (F.concat(F.lit("Running "), text("total"), F.lit(" searches")), F.when(rounds, base + 5).otherwise(25)),
        "search_item_complete": (F.concat(F.lit("Search complete: "), "question"), 25 + _whole(done * 45)),
        "search_progress": (
            F.concat(F.lit("Completed "), text("completed"), F.lit("/"), text("total"), F.lit(" searches for iteration "), text("iteration")),
            base + 5 + _whole(done * F.try_divide(F.lit(50), c("iterations"))),
        ),
        "enriching_sources": (F.concat(F.lit("Enriching sources for iteration "), text("iteration"), F.lit("/"), text("iterations")), F.when(rounds, base + 8).otherwise(55)),
        "filtering_sources": (F.lit("Filtering sources for relevance"), F.lit(75)),
        "synthesizing_report": (F.lit("Synthesizing report"), F.lit(80)),
        "research_complete": (F.lit("Research complete"), F.lit(100)),
    }
    message, progress = F.concat(F.lit("Research progress: "), "stage"), F.lit(None).cast("int")
    for stage, (said, value) in stages.items():
        message = F.when(c("stage") == stage, said).otherwise(message)
        progress = F.when(c("stage") == stage, value.cast("int")).otherwise(progress)
    return events.withColumns({"message": message, "progress": progress, "level": F.coalesce("level", F.lit("info"))})


def latest_status(logs: DataFrame) -> DataFrame:
    """Of each run the last log row's id, message, progress (the last that isn't null), and how many rows and errors. Streams: update mode."""
    last = F.max(F.struct("id", "message", "created_at"))
    known = F.max(F.when(F.col("progress").isNotNull(), F.struct("id", "progress")))["progress"]
    return logs.groupBy("run_id").agg(last.alias("l"), known.alias("progress"), F.count("*").alias("n_logs"), F.count_if(F.col("level") == "error").alias("n_errors")).select(
        "run_id", F.col("l.id").alias("last_id"), F.col("l.message").alias("message"), F.col("l.created_at").alias("updated_at"), "progress", "n_logs", "n_errors"
    )


def run_lifecycle(updates: DataFrame) -> DataFrame:
    """Of each run its state after all ``updates`` (id, run_id, status, report, error, created_at); nulls keep what was there."""
    keep = lambda name: F.max(F.when(F.col(name).isNotNull(), F.struct("id", name)))[name].alias(name)
    ended = F.max(F.when(F.col("status").isin(*TERMINAL), F.col("created_at")))
    return updates.groupBy("run_id").agg(keep("status"), keep("report"), keep("error"), ended.alias("completed_at"))


def log_feed(history: DataFrame, logs: DataFrame) -> DataFrame:
    """One feed: of each run a status row first (``seq`` 0), then its log rows in order of id."""
    status = history.select("run_id", F.lit(0).cast("bigint").alias("seq"), F.lit("status").alias("kind"), F.col("status").alias("message"), F.lit(None).cast("int").alias("progress"))
    rows = logs.select("run_id", (F.col("id") + 1).cast("bigint").alias("seq"), F.lit("log").alias("kind"), "message", F.col("progress").cast("int").alias("progress"))
    return status.unionByName(rows).orderBy("run_id", "seq")


def stream_sessions(
    spark: SparkSession, root: str, archive: Callable[[dict[str, DataFrame]], None], checkpoint: str, outcomes: str, max_files: int = 1000
):
    """A started query over session folders that come under ``root``: each session is handed on once its four files are there.

    Files of a session may come in several micro-batches; with each, the sessions that it touches are read whole, and
    with them those that failed before. Readable ones go to ``archive`` (tables of ``read_sessions``), which must be
    idempotent by key, as ``archive_batch`` is. What became of each session (``archived``, ``waiting`` or ``failed``, with
    a reason) is a row of ``session_outcomes``. A session that can't be read, or that ``archive`` refuses, is tried again
    with every batch and at every start; so it enters once it is mended, and the stream never stops for it.
    """

    def taken(folders: DataFrame | None) -> None:
        before = session_outcomes(spark, outcomes)
        number = before.agg(F.max("batch")).first()[0] + 1 if before else 0
        _take_sessions(spark, folders, archive, outcomes, number, max_files)

    if session_outcomes(spark, outcomes):
        taken(None)

    def each(df: DataFrame, number: int) -> None:
        taken(df.select("folder").distinct())

    files = session_files(spark.readStream, root, maxFilesPerTrigger=str(max_files))
    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_outcomes(spark: SparkSession, outcomes: str) -> DataFrame | None:
    """``folder``, ``status``, ``reason`` and ``batch`` of each session as it stands last; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{outcomes}/batch=*/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
        return None
    rows = spark.read.schema("folder string, status string, reason string, batch long").parquet(outcomes)
    return rows.groupBy("folder").agg(F.max(F.struct("batch", "status", "reason")).alias("l")).select("folder", "l.status", "l.reason", "l.batch")


def _take_sessions(spark: SparkSession, folders: DataFrame | None, archive: Callable, outcomes: str, number: int, most: int) -> None:
    touched = folders if folders is not None else spark.createDataFrame([], "folder string")
    if before := session_outcomes(spark, outcomes):
        touched = touched.union(before.where("status = 'failed'").orderBy("batch", "folder").limit(most).select("folder"))
    made: list[str] = []
    with listed(made):
        tables = _tables_of(spark, written(touched.distinct(), "touched"))
    if tables:
        _archive_sessions(tables, archive, f"{outcomes}/batch={number}")
    remove(spark, made)


def _tables_of(spark: SparkSession, touched: DataFrame) -> dict[str, DataFrame] | None:
    # packed sessions are found in the files of their base; of others, whose folders are read, a batch has max_files at most
    base = F.regexp_extract("folder", r"^(.*/packed)/", 1)
    packed = touched.where(base != "")
    rows = [session_files(spark.read, [r[0]]).join(packed, "folder", "left_semi") for r in packed.select(base).distinct().collect()]
    if plain := sorted(r[0] for r in touched.where(base == "").collect()):
        rows.append(session_files(spark.read, plain))
    return tables_of_sessions(functools.reduce(DataFrame.unionByName, rows)) if rows else None


def _archive_sessions(tables: dict[str, DataFrame], archive: Callable, path: str) -> None:
    waiting, failed = F.lit("waiting"), F.lit("failed")
    status = F.when(~F.col("complete"), waiting).when(F.col("broken").isNotNull(), failed).otherwise("archived")
    told = F.col("folder"), status.alias("status"), F.col("broken").alias("reason")
    try:
        archive(tables)
    except Exception as error:  # of the batch; its sessions are tried again
        told = (told[0], F.when(~F.col("complete"), waiting).otherwise(failed).alias("status"), F.lit(f"{type(error).__name__}: {error}"[:500]).alias("reason"))
    tables["sessions"].select(*told).write.mode("overwrite").parquet(path)
