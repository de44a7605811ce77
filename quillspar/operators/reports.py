"""Counters, progress and lists of import jobs and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Status sets and messages.
RESUMABLE = ("queued", "running", "interrupted", "failed", "completed_with_errors")
RETRYABLE = ("pending", "processing", "failed")
RETRY_FIRST = "重新尝试"
SUCCESS = {"imported": "新增文件已完成向量化", "updated": "已更新文件向量", "skipped": "文件未变化或哈希已入库，已跳过重复向量化"}
ERRORS = (
    ("大模型 API token 或鉴权错误", ("api key", "unauthorized", "401", "403", "invalid token", "deepseek", "crs")),
    ("服务器连接或响应失败", ("timeout", "connection", "connect", "network", "503", "502", "504")),
    ("OCR 处理失败", ("ocr", "paddle")),
    ("向量化失败", ("embedding", "flagembedding", "bge", "huggingface", "torch")),
    ("向量库写入或检索失败", ("chroma", "vector")),
    ("文档解析失败", ("no indexable text", "pdf", "docx", "parse")),
    ("本地文件访问失败", ("permission", "not found", "no such file", "access")),
)
PARSING, HANDLING, FAILED = "解析", "处理", "失败"


def status_counts(files: DataFrame) -> DataFrame:
    """(job_id, status, files)."""
    return files.groupBy("job_id", "status").agg(F.count("*").alias("files"))


def job_counters(files: DataFrame) -> DataFrame:
    """Per job: files scanned, imported, updated, skipped and failed."""
    kinds = ("imported", "updated", "skipped", "failed")
    return files.groupBy("job_id").agg(F.count("*").alias("scanned"), *[F.count_if(F.col("status") == k).alias(k) for k in kinds])


def with_progress(jobs: DataFrame) -> DataFrame:
    """Jobs with their completed and pending files, the share completed, and whether they can be resumed. Deleted files don't count."""
    total = F.col("total_files")
    completed = F.least(total, F.greatest(F.lit(0), F.col("imported") + F.col("updated") + F.col("skipped") + F.col("failed")))
    out = jobs.withColumn("completed", completed).withColumn("pending", F.greatest(F.lit(0), total - F.col("completed")))
    ratio = F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("completed") / total))).otherwise(F.lit(0.0))
    return out.withColumn("ratio", F.round(ratio, 6)).withColumn("can_resume", F.col("status").isin(*RESUMABLE))


def finished(jobs: DataFrame) -> DataFrame:
    """Jobs with their final status and a JSON report of the counters."""
    status = F.when(F.col("failed") > 0, "completed_with_errors").otherwise("completed")
    report = F.to_json(F.struct("scanned", "imported", "updated", "skipped", "deleted", "failed"))
    return jobs.withColumn("status", status).withColumn("report_json", report)


def stats(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: published documents, documents being indexed, chunks of published ones, and vectors."""
    counts = documents.agg(F.count_if(F.col("status") == "imported").alias("documents"), F.count_if(F.col("status") == "indexing").alias("indexing"))
    shown = chunks.join(documents.where("status = 'imported'").select("document_id"), "document_id", "left_semi").agg(F.count("*").alias("chunks"))
    return counts.join(F.broadcast(shown)).join(F.broadcast(vectors.agg(F.count("*").alias("vectors"))))  # one row each


def newest(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Published documents, newest first, ties by id."""
    rows = documents.where("status = 'imported'").orderBy(F.desc("imported_at"), "document_id")
    return rows.limit(limit) if limit else rows


def recent_events(events: DataFrame, job_id, limit: int = 80) -> DataFrame:
    """The last events of a job, oldest first, their time as HH:mm:ss."""
    last = events.where(F.col("job_id") == job_id).orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)
    return last.orderBy("created_at", "event_id").withColumn("time", F.date_format("created_at", "HH:mm:ss"))


def latest_resumable(jobs: DataFrame) -> DataFrame:
    """(source_path, job_id): the newest job of each path that can be resumed."""
    return jobs.where(F.col("status").isin(*RESUMABLE)).groupBy("source_path").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))


def retry_queue(files: DataFrame) -> DataFrame:
    """Files to be imported or retried with their turn per job: marked ones first, then by path."""
    first = F.when(F.col("phase") == RETRY_FIRST, 0).otherwise(1)
    turn = F.row_number().over(Window.partitionBy("job_id").orderBy(first, "file_path", "file_id"))
    return files.where(F.col("status").isin(*RETRYABLE)).withColumn("turn", turn)


def recover_jobs(jobs: DataFrame, alive: DataFrame) -> DataFrame:
    """Jobs that say they run but have no live worker become interrupted."""
    rows = jobs.join(alive.select("job_id").distinct().withColumn("alive", F.lit(True)), "job_id", "left")
    lost = F.col("status").isin("running", "stopping") & F.col("alive").isNull()
    return rows.withColumn("status", F.when(lost, "interrupted").otherwise(F.col("status"))).drop("alive")


def recover_files(files: DataFrame, interrupted: DataFrame) -> DataFrame:
    """Files in progress of interrupted jobs become pending again. Only files in progress are joined, which are few; the others stay where they are read."""
    stuck = F.coalesce(F.col("status") == "processing", F.lit(False))
    rows = files.where(stuck).join(interrupted.select("job_id").distinct().withColumn("lost", F.lit(True)), "job_id", "left")
    back = rows.withColumn("status", F.when(F.col("lost"), "pending").otherwise(F.col("status"))).drop("lost")
    return back.unionByName(files.where(~stuck))


def error_class(message: Column, phase: Column, kind: Column | None = None) -> Column:
    """The message under the heading of the first class with one of its words in it, or of its kind's class, if that is given and has one."""

    def heading(text: Column, parsing: Column) -> Column:
        low, out = F.lower(text), None
        for heading, words in ERRORS:
            hit = low.rlike("|".join(words))
            hit = hit | parsing if heading == "文档解析失败" else hit
            out = F.when(hit, heading) if out is None else out.when(hit, heading)
        return out

    out = heading(message, phase.contains(PARSING)).otherwise(F.concat(F.coalesce(F.nullif(phase, F.lit("")), F.lit(HANDLING)), F.lit(FAILED)))
    if kind is not None:
        out = F.coalesce(heading(kind, F.lit(False)), out)
    return F.concat(out, F.lit("："), message)


def status_message(status: Column) -> Column:
    """What a success status means; other statuses stand for themselves."""
    known = F.create_map(*[F.lit(x) for pair in SUCCESS.items() for x in pair])
    return F.coalesce(F.element_at(known, status), status)
