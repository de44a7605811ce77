"""Import jobs as tables of jobs, files and events: lists, transitions, stops and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reports

# Phases, messages, the log's layout and limits.
DONE, BROKEN, STOPPED, BEGUN = "完成文件", "文件失败", "已停止", "开始处理"
STOP_MESSAGE = "收到停止请求，稍后可恢复处理"
ACTIVE = ("queued", "running", "stopping")
JOBS_SHOWN, FILES_SHOWN, CANDIDATES_SHOWN, RECENT_SHOWN = 20, 500, 80, 10
LEAST_K, MOST_K = 3, 20
RULE = "=" * 72


def job_list(jobs: DataFrame, limit: int = JOBS_SHOWN) -> DataFrame:
    """The newest jobs, ties by id."""
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def job(jobs: DataFrame, job_id) -> DataFrame:
    return jobs.where(F.col("job_id") == job_id)


def file_rows(files: DataFrame, job_id, limit: int = FILES_SHOWN) -> DataFrame:
    """The first files of a job by path."""
    return files.where(F.col("job_id") == job_id).orderBy("file_path", "file_id").limit(limit)


def failed_rows(files: DataFrame, job_id=None) -> DataFrame:
    """All failed files, of one job or of every job: (job_id, file_path, error, message)."""
    rows = files if job_id is None else files.where(F.col("job_id") == job_id)
    return rows.where("status = 'failed'").select("job_id", "file_path", "error", "message")


def import_active(jobs: DataFrame) -> DataFrame:
    """One row (active): whether any job is queued, runs or is about to stop. One task's first hit ends the search."""
    return jobs.where(F.col("status").isin(*ACTIVE)).limit(1).agg((F.count("*") > 0).alias("active"))


def transitions(files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Files (file_id, file_path, status, phase, message, error) with the outcomes (file_id, outcome, failure) of those that were handled.

    An outcome is imported, updated, skipped, failed or interrupted. Success clears the error; a failure is told by its class; an interrupted file is pending again; files
    without an outcome stay as they are. Outcomes may have a ``kind``, the name of what failed (as 'timeout'), whose class goes before that of the message, as messages
    quote names and numbers of files.
    """
    kind = F.col("kind") if "kind" in outcomes.columns else F.lit(None).cast("string")
    rows = files.join(outcomes.select("file_id", "outcome", "failure", kind.alias("failure_kind")), "file_id", "left")
    told = reports.error_class(F.coalesce("failure", F.lit("")), F.coalesce(F.nullif("phase", F.lit("")), F.lit(reports.HANDLING)), F.col("failure_kind"))
    o = F.col("outcome")
    good = o.isin(*reports.SUCCESS)
    status = F.when(o == "interrupted", "pending").when(o.isNotNull(), o).otherwise(F.col("status"))
    phase = F.when(good, DONE).when(o == "interrupted", STOPPED).otherwise(F.col("phase"))
    message = F.when(good, reports.status_message(o)).when(o == "failed", told).when(o == "interrupted", STOP_MESSAGE).otherwise(F.col("message"))
    error = F.when(o == "failed", told).when(o.isNull(), F.col("error"))
    changed = {"status": status, "phase": phase, "message": message, "error": error}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in files.columns])


def events_of(files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The events (job_id, level, phase, message, file_path) that outcomes of files leave, from their rows after transitions."""
    rows = files.join(outcomes.select("file_id", "outcome"), "file_id")
    level = F.when(F.col("outcome") == "failed", "error").otherwise("info")
    phase = F.when(F.col("outcome") == "failed", BROKEN).otherwise(F.col("phase"))
    return rows.select("job_id", level.alias("level"), phase.alias("phase"), F.concat(F.regexp_extract("file_path", "([^/]*)$", 1), F.lit("："), "message").alias("message"), "file_path")


def started(jobs: DataFrame, job_id) -> DataFrame:
    """Jobs with this one running, unless it is to stop."""
    go = (F.col("job_id") == job_id) & (F.col("status") != "stopping")
    return jobs.withColumn("status", F.when(go, "running").otherwise(F.col("status")))


def stop_requested(jobs: DataFrame, job_id=None) -> DataFrame:
    """Jobs of which this one, or every one, is to stop: running ones say so, queued ones are interrupted at once."""
    hit = F.lit(True) if job_id is None else F.col("job_id") == job_id
    status = F.when(hit & (F.col("status") == "running"), "stopping").when(hit & (F.col("status") == "queued"), "interrupted")
    return jobs.withColumn("status", F.coalesce(status, F.col("status")))


class Stop:
    """A stop that a job's driver asks for between its steps; cancelling its group of Spark jobs breaks off what runs."""

    class Asked(Exception):
        pass

    def __init__(self, spark: SparkSession, job_id: str):
        self.context, self.job_id, self.asked = spark.sparkContext, job_id, False

    def begin(self) -> None:
        self.context.setJobGroup(self.job_id, f"import {self.job_id}", interruptOnCancel=True)

    def ask(self) -> None:
        self.asked = True
        self.context.cancelJobGroup(self.job_id)

    def check(self) -> None:
        if self.asked:
            raise Stop.Asked(self.job_id)


def report(files: DataFrame) -> DataFrame:
    """One row (scanned, imported, updated, skipped, failed, errors) of handled files; errors are (file_path, error) in order of paths.

    Errors are gathered, so this is for a job's files; failed_rows gives them as rows.
    """
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("imported", "updated", "skipped", "failed")]
    errors = F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.struct("file_path", "error"))))
    return files.agg(F.count("*").alias("scanned"), *counts, errors.alias("errors"))


def summary(files: DataFrame) -> DataFrame:
    """One row (scanned, imported, updated, skipped, failed, errors, first_error) of the handled files of any number of jobs.

    ``errors`` counts the failed files; first_error is that of the first path that has one. Nothing is gathered.
    """
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("imported", "updated", "skipped", "failed")]
    failed = F.col("status") == "failed"
    first = F.min(F.when(failed & F.col("error").isNotNull(), F.struct("file_path", "error")))["error"]
    return files.agg(F.count("*").alias("scanned"), *counts, F.count_if(failed).cast("int").alias("errors"), first.alias("first_error"))


def session_log(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """(job_id, entry): each job's entry in the session log, with its failed files by path, those of one path by error (none: last). Jobs hold their counters."""
    name = F.regexp_extract("file_path", "([^/]*)$", 1)
    why = F.coalesce(F.nullif("error", F.lit("")), F.nullif("message", F.lit("")), F.lit("未知"))
    line = F.concat(F.lit("    ["), name, F.lit("] "), F.col("file_path"), F.lit("\n      原因: "), why)
    failed = files.where("status = 'failed'").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("file_path", F.col("error").isNull().alias("none"), "error", line.alias("line")))).alias("failed_files"))
    rows = jobs.join(failed, "job_id", "left")
    shown = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))
    pairs = [("任务ID   ", F.col("job_id").cast("string")), ("目录     ", F.col("source_path")), ("开始时间 ", shown("started_at")), ("结束时间 ", shown("finished_at")), ("状态     ", F.col("status"))]
    pairs += [(label, F.coalesce(F.col(c), F.lit(0)).cast("string")) for label, c in (("新增     ", "imported"), ("更新     ", "updated"), ("跳过     ", "skipped"), ("删除     ", "deleted"), ("失败     ", "failed"))]
    head = [F.concat(F.lit(f"{label}: "), v) for label, v in pairs]
    tail = F.when(F.col("failed_files").isNotNull(), F.concat(F.lit("失败文件 :\n"), F.array_join(F.transform("failed_files", lambda x: x["line"]), "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return rows.select("job_id", F.concat(F.lit(f"\n{RULE}\n"), F.concat_ws("\n", *head), F.lit("\n"), tail, F.lit(RULE)).alias("entry"))


def append_log(entries: DataFrame, path: str) -> None:
    """Append log entries as text files to a folder of the shared store."""
    entries.select("entry").write.mode("append").text(path)


def shown_k(k: Column) -> Column:
    """A number of results as the slider allows it."""
    return F.least(F.lit(MOST_K), F.greatest(F.lit(LEAST_K), k))
