"""Queries of synchronisation and reporting, over the tables as manifests, scans, jobs, files and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.operators import chunking, reports, sync
from quillspar.operators.chunking import chunk_id, next_index

from . import tables as D

TARGET = sync.index_profile("text")
WITH_OCR = sync.index_profile("pdf", ocr=True)
OTHER = sync.index_profile("text", chunk_size=256)
#: What the manifest has, by source: src3 moved, src4 changed, src5 broke off, src6 has another index, src7 an OCR index, src8 none noted, src9 failed; src0 isn't in it.
_OLD_PATH = "'/data/' || CASE source WHEN 'src3' THEN 'old' ELSE source END || '/' || CAST(doc_id AS STRING) || '.txt'"
_OLD_HASH = "CASE source WHEN 'src4' THEN md5({text} || '!') ELSE md5({text}) END"
_OLD_STATUS = "CASE source WHEN 'src5' THEN 'indexing' WHEN 'src9' THEN 'failed' ELSE 'imported' END"
_OLD_PROFILE = f"CASE source WHEN 'src6' THEN '{OTHER}' WHEN 'src7' THEN '{WITH_OCR}' WHEN 'src8' THEN NULL ELSE '{TARGET}' END"
_PATH = "'/data/' || source || '/' || CAST(doc_id AS STRING) || '.txt'"


def manifest(spark, sf_dir: str) -> DataFrame:
    d = D.table(spark, sf_dir, "documents").where("source <> 'src0'")
    return d.selectExpr("doc_id AS document_id", f"{_OLD_PATH} AS file_path", f"{_OLD_HASH.format(text='text')} AS file_hash", f"{_OLD_STATUS} AS status", f"{_OLD_PROFILE} AS index_profile", "n_chars AS imported_at")


def scan(spark, sf_dir: str) -> DataFrame:
    """The files that are there now: those of src10 are gone, those of src11 can't be read."""
    d = D.table(spark, sf_dir, "documents").where("source <> 'src10'")
    return d.selectExpr(f"{_PATH} AS file_path", "CASE WHEN source <> 'src11' THEN md5(text) END AS file_hash")


def kept_chunks(spark, sf_dir: str) -> DataFrame:
    """First chunks of the documents; French ones have none."""
    d = D.table(spark, sf_dir, "documents").where("lang <> 'fr'")
    return d.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), chunk_id(F.col("doc_id"), F.lit(0)).alias("chunk_id"))


_BASE = f"""manifest_ AS (SELECT doc_id AS document_id, {_OLD_PATH} AS file_path, {_OLD_HASH.format(text='text')} AS file_hash, {_OLD_STATUS} AS status, {_OLD_PROFILE} AS index_profile, n_chars AS imported_at FROM documents WHERE source <> 'src0'),
scan_ AS (SELECT {_PATH} AS file_path, CASE WHEN source <> 'src11' THEN md5(text) END AS file_hash FROM documents WHERE source <> 'src10'),
kept_ AS (SELECT doc_id AS document_id, doc_id || '#0' AS chunk_id FROM documents WHERE lang <> 'fr')"""


def _serves(existing: str, target: str) -> str:
    base = " AND ".join(f"({existing}::JSON ->> '{k}') IS NOT DISTINCT FROM ({target}::JSON ->> '{k}')" for k in sync.BASE)
    return f"CASE WHEN coalesce({existing}, '') = '' THEN ({target}::JSON ->> 'mode') IS DISTINCT FROM 'ocr' WHEN {existing} = {target} THEN true ELSE coalesce(({existing}::JSON ->> 'mode') = 'ocr' AND ({target}::JSON ->> 'mode') = 'text' AND {base}, false) END"


_REUSE = f"""reuse_ AS (SELECT file_hash, arg_min(document_id, (imported_at, document_id)) AS reuse_id FROM manifest_ WHERE status = 'imported' AND {_serves('index_profile', f"'{TARGET}'")} AND document_id IN (SELECT document_id FROM kept_) GROUP BY file_hash)"""


def hash_dedupe(spark, sf_dir):
    return sync.content_groups(D.documents(spark, sf_dir))


def reuse_candidate(spark, sf_dir):
    return sync.reusable(manifest(spark, sf_dir), kept_chunks(spark, sf_dir), F.lit(TARGET))


def import_plan(spark, sf_dir):
    return sync.import_plan(scan(spark, sf_dir), manifest(spark, sf_dir), kept_chunks(spark, sf_dir), TARGET)


def move_reconcile(spark, sf_dir):
    return sync.reconcile(scan(spark, sf_dir), manifest(spark, sf_dir), "/data")


def missing_vectors(spark, sf_dir):
    return sync.missing_vectors(kept_chunks(spark, sf_dir), D.vectors(spark, sf_dir)).select("document_id", "chunk_id")


def orphan_vectors(spark, sf_dir):
    return sync.orphan_vectors(D.vectors(spark, sf_dir), kept_chunks(spark, sf_dir)).select("vec_id", "chunk_id")


def recovery_report(spark, sf_dir):
    vectors = D.vectors(spark, sf_dir).select("document_id", chunk_id(F.col("document_id"), F.col("label") % 2).alias("chunk_id"))
    return sync.recovery(manifest(spark, sf_dir), kept_chunks(spark, sf_dir), vectors)


def clone_reused(spark, sf_dir):
    """Chunks of files whose content a published document has, under their paths as ids; each with whether its vector comes along."""
    plan = import_plan(spark, sf_dir).where("action = 'reuse'").select("reuse_id", F.col("file_path").alias("document_id"))
    out = sync.clone_chunks(kept_chunks(spark, sf_dir), D.vectors(spark, sf_dir), plan)
    return out.select("document_id", "chunk_id", F.col("embedding").isNotNull().alias("has_vector"))


def upsert_documents(spark, sf_dir):
    new = scan(spark, sf_dir).where("file_hash is not null")
    return sync.upsert(manifest(spark, sf_dir).select("file_path", "file_hash", "status"), new.withColumn("status", F.lit("imported")), "file_path")


_PROFILES = [None, TARGET, WITH_OCR, OTHER, sync.index_profile("pdf", ocr=True, chunk_size=256), "not json", sync.index_profile("pdf", ocr=True, ocr_lang="en")]


def profile_matrix(spark, sf_dir):
    rows = spark.createDataFrame([(i, a, j, b) for i, a in enumerate(_PROFILES) for j, b in enumerate(_PROFILES) if b and b.startswith("{")], "existing int, a string, target int, b string")
    return rows.select("existing", "target", sync.profile_satisfies(F.col("a"), F.col("b")).alias("serves"))


def files(spark, sf_dir: str) -> DataFrame:
    """Order lines as the files of import jobs, a job being an order."""
    return D.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS job_id", "l_orderkey * 10 + l_linenumber AS file_id", f"{_FILE_STATUS} AS status", f"CASE l_linenumber WHEN 2 THEN '{reports.RETRY_FIRST}' ELSE '' END AS phase", "'/p/' || CAST(l_partkey AS STRING) AS file_path")


_FILE_STATUS = "CASE WHEN l_returnflag = 'A' THEN 'imported' WHEN l_returnflag = 'R' THEN 'updated' WHEN l_linenumber = 1 THEN 'skipped' WHEN l_linenumber = 2 THEN 'failed' WHEN l_linenumber = 3 THEN 'processing' ELSE 'pending' END"
_FILES = f"files_ AS (SELECT l_orderkey AS job_id, l_orderkey * 10 + l_linenumber AS file_id, {_FILE_STATUS} AS status, CASE l_linenumber WHEN 2 THEN '{reports.RETRY_FIRST}' ELSE '' END AS phase, '/p/' || l_partkey AS file_path FROM lineitem)"
_JOB_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'interrupted' END"


def jobs(spark, sf_dir: str) -> DataFrame:
    """Orders as import jobs."""
    return D.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS job_id", "'/c/' || CAST(o_custkey AS STRING) AS source_path", f"{_JOB_STATUS} AS status", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS created_at")


_JOBS = f"jobs_ AS (SELECT o_orderkey AS job_id, '/c/' || o_custkey AS source_path, {_JOB_STATUS} AS status, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at FROM orders)"


def status_counts(spark, sf_dir):
    return reports.status_counts(files(spark, sf_dir))


def job_counters(spark, sf_dir):
    return reports.job_counters(files(spark, sf_dir))


def job_progress(spark, sf_dir):
    counted = reports.job_counters(files(spark, sf_dir)).withColumn("total_files", F.col("scanned") + F.col("job_id") % 3 - 1)
    return reports.with_progress(counted.join(jobs(spark, sf_dir).select("job_id", "status"), "job_id")).select("job_id", "total_files", "completed", "pending", "ratio", "can_resume")


def job_finish(spark, sf_dir):
    counted = reports.job_counters(files(spark, sf_dir)).withColumn("deleted", F.lit(0))
    return reports.finished(counted).select("job_id", "status", "report_json")


def job_stats(spark, sf_dir):
    return reports.stats(D.documents(spark, sf_dir), D.chunks(spark, sf_dir), D.vectors(spark, sf_dir))


def next_chunk_index(spark, sf_dir):
    return next_index(D.chunks(spark, sf_dir))


def doc_list(spark, sf_dir):
    rows = reports.newest(D.documents(spark, sf_dir), 20)
    return rows.select("document_id", "manufacturer", "imported_at")


def recent_events(spark, sf_dir):
    events = D.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("phase"), F.col("ts").alias("created_at"))
    return reports.recent_events(events, 8).select("event_id", "phase", "time")


def latest_job_per_path(spark, sf_dir):
    return reports.latest_resumable(jobs(spark, sf_dir))


def retry_order(spark, sf_dir):
    return reports.retry_queue(files(spark, sf_dir)).select("job_id", "file_id", "turn")


def orphan_jobs(spark, sf_dir):
    """Jobs without a customer order in progress are interrupted, and their files pending again."""
    all_jobs = jobs(spark, sf_dir)
    recovered = reports.recover_jobs(all_jobs, all_jobs.where("job_id % 2 = 0"))
    rows = reports.recover_files(files(spark, sf_dir), recovered.where("status = 'interrupted'"))
    return rows.groupBy("status").agg(F.count("*").alias("files"))


_MESSAGE = "CASE event_type WHEN 'click' THEN 'HTTP 401 ' WHEN 'error' THEN 'Connection timeout ' WHEN 'purchase' THEN 'BGE embedding failed ' WHEN 'signup' THEN 'No such file ' ELSE 'odd ' END || props"
_PHASE = "CASE WHEN value > 50 THEN '解析文件' WHEN value > 10 THEN '写入' ELSE '' END"


def error_class(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").selectExpr("event_id", f"{_MESSAGE} AS message", f"{_PHASE} AS phase")
    return rows.select("event_id", reports.error_class(F.col("message"), F.col("phase")).alias("shown"))


def status_message(spark, sf_dir):
    return files(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")).select("status", reports.status_message(F.col("status")).alias("shown"))


def stream_ingest(spark, sf_dir):
    """Documents as a stream of Parquet files, cut into chunks and appended to a table in one run. A stream isn't SQL: it equals chunk_windows."""
    root = f"{D.shared_root(spark)}/stream-{uuid.uuid4().hex}"
    docs = D.table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    cut = chunking.chunk(stream.select("doc_id", F.array(chunking.segment(F.col("text"))).alias("segments"))).select(F.col("doc_id").alias("document_id"), "chunk_index", "token_offset", "n_tokens")
    cut.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/chunks").awaitTermination()
    return spark.read.parquet(f"{root}/chunks")


QUERIES = {
    f.__name__: f
    for f in (hash_dedupe, reuse_candidate, import_plan, move_reconcile, missing_vectors, orphan_vectors, recovery_report, clone_reused, upsert_documents, profile_matrix, status_counts, job_counters, job_progress, job_finish, job_stats, next_chunk_index, doc_list, recent_events, latest_job_per_path, retry_order, orphan_jobs, error_class, status_message, stream_ingest)
}
_PLAN = f"""{_BASE}, {_REUSE}, j_ AS (SELECT s.file_path, s.file_hash, m.document_id, m.status, m.file_hash = s.file_hash AS same, m.document_id IS NOT NULL AND {_serves('m.index_profile', f"'{TARGET}'")} AS ok, r.reuse_id, m.document_id IN (SELECT document_id FROM kept_) AS has
 FROM scan_ s LEFT JOIN manifest_ m USING (file_path) LEFT JOIN reuse_ r ON r.file_hash = s.file_hash),
a_ AS (SELECT *, CASE WHEN file_hash IS NULL THEN 'fail' WHEN same AND status = 'imported' AND ok THEN 'skip' WHEN same AND status = 'indexing' AND ok AND has THEN 'resume' WHEN reuse_id IS NOT NULL THEN 'reuse' WHEN status = 'imported' THEN 'update' WHEN document_id IS NOT NULL THEN 'rebuild' ELSE 'import' END AS action FROM j_),
plan_ AS (SELECT file_path, action, CASE WHEN action = 'fail' THEN 'failed' WHEN action = 'skip' OR (action = 'reuse' AND document_id IS NULL) THEN 'skipped' WHEN document_id IS NOT NULL THEN 'updated' ELSE 'imported' END AS result, document_id, CASE WHEN action = 'reuse' THEN reuse_id END AS reuse_id FROM a_)"""
_COUNTED = f"""{_FILES}, counted_ AS (SELECT job_id, count(*) AS scanned, count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM files_ GROUP BY job_id)"""
_MATRIX = ", ".join(f"({i}, " + ("NULL" if p is None else f"'{p}'") + ")" for i, p in enumerate(_PROFILES) if p is None or p.startswith("{"))
_ERROR = " ".join(f"WHEN regexp_matches(lower(m), '{'|'.join(words)}')" + (f" OR contains(p, '{reports.PARSING}')" if head == "文档解析失败" else "") + f" THEN '{head}'" for head, words in reports.ERRORS)
ORACLE_SQL = {
    "hash_dedupe": "SELECT md5(text) AS file_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "reuse_candidate": f"WITH {_BASE}, {_REUSE} SELECT * FROM reuse_",
    "import_plan": f"WITH {_PLAN} SELECT * FROM plan_",
    "move_reconcile": f"""WITH {_BASE}, stale_ AS (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY file_path, document_id) AS turn FROM manifest_ WHERE starts_with(file_path, '/data/') AND file_path NOT IN (SELECT file_path FROM scan_)),
        free_ AS (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY file_path) AS turn FROM scan_ WHERE file_hash IS NOT NULL AND file_path NOT IN (SELECT file_path FROM manifest_))
        SELECT s.document_id, s.file_path, CASE WHEN f.file_path IS NULL THEN 'delete' ELSE 'move' END AS action, f.file_path AS new_path FROM stale_ s LEFT JOIN free_ f USING (file_hash, turn)""",
    "missing_vectors": f"WITH {_BASE} SELECT document_id, chunk_id FROM kept_ WHERE document_id NOT IN (SELECT vec_id FROM embeddings)",
    "orphan_vectors": f"WITH {_BASE} SELECT vec_id, vec_id || '#0' AS chunk_id FROM embeddings WHERE vec_id NOT IN (SELECT document_id FROM kept_)",
    "recovery_report": f"WITH {_BASE}, b_ AS (SELECT document_id, document_id IN (SELECT document_id FROM kept_) AS has FROM manifest_ WHERE status = 'indexing') SELECT count(*) FILTER (has) AS kept, count(*) FILTER (NOT has) AS deleted, (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT document_id FROM b_ WHERE has) AND label % 2 <> 0) AS vectors_cleaned FROM b_",
    "clone_reused": f"WITH {_PLAN} SELECT file_path AS document_id, file_path || '#0' AS chunk_id, reuse_id IN (SELECT vec_id FROM embeddings) AS has_vector FROM plan_ WHERE action = 'reuse' AND reuse_id IN (SELECT document_id FROM kept_)",
    "upsert_documents": f"WITH {_BASE} SELECT file_path, file_hash, status FROM manifest_ WHERE file_path NOT IN (SELECT file_path FROM scan_ WHERE file_hash IS NOT NULL) UNION ALL SELECT file_path, file_hash, 'imported' FROM scan_ WHERE file_hash IS NOT NULL",
    "profile_matrix": f"WITH p(i, x) AS (VALUES {_MATRIX}) SELECT a.i AS existing, b.i AS target, {_serves('a.x', 'b.x')} AS serves FROM p a, p b WHERE b.x IS NOT NULL UNION ALL SELECT 5, i, false FROM p WHERE x IS NOT NULL",
    "status_counts": f"WITH {_FILES} SELECT job_id, status, count(*) AS files FROM files_ GROUP BY ALL",
    "job_counters": f"WITH {_COUNTED} SELECT * FROM counted_",
    "job_progress": f"""WITH {_COUNTED}, {_JOBS}, t_ AS (SELECT c.*, j.status, scanned + c.job_id % 3 - 1 AS total_files, imported + updated + skipped + failed AS done FROM counted_ c JOIN jobs_ j USING (job_id))
        SELECT job_id, total_files, least(total_files, done) AS completed, total_files - least(total_files, done) AS pending, CASE WHEN total_files > 0 THEN round(least(total_files, done) / total_files, 6) ELSE 0.0::DOUBLE END AS ratio, status IN ('running', 'interrupted') AS can_resume FROM t_""",
    "job_finish": f"""WITH {_COUNTED} SELECT job_id, CASE WHEN failed > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status, '{{"scanned":' || scanned || ',"imported":' || imported || ',"updated":' || updated || ',"skipped":' || skipped || ',"deleted":0,"failed":' || failed || '}}' AS report_json FROM counted_""",
    "job_stats": f"WITH {D.CHUNKS} SELECT count(*) FILTER (status = 'imported') AS documents, count(*) FILTER (status = 'indexing') AS indexing, (SELECT count(*) FROM chunks_ WHERE status = 'imported') AS chunks, (SELECT count(*) FROM embeddings) AS vectors FROM documents_",
    "next_chunk_index": f"WITH {D.CHUNKS} SELECT document_id, max(chunk_index) + 1 AS next_index FROM chunks_ GROUP BY document_id",
    "doc_list": f"WITH {D.DOCUMENTS} SELECT document_id, manufacturer, imported_at FROM documents_ WHERE status = 'imported' ORDER BY imported_at DESC, document_id LIMIT 20",
    "recent_events": "SELECT event_id, event_type AS phase, strftime(ts, '%H:%M:%S') AS time FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 80",
    "latest_job_per_path": f"WITH {_JOBS} SELECT source_path, arg_max(job_id, (created_at, job_id)) AS job_id FROM jobs_ WHERE status IN ('running', 'interrupted') GROUP BY source_path",
    "retry_order": f"WITH {_FILES} SELECT job_id, file_id, row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN phase <> '' THEN 0 ELSE 1 END, file_path, file_id)::INT AS turn FROM files_ WHERE status IN ('pending', 'processing', 'failed')",
    "orphan_jobs": f"WITH {_FILES}, {_JOBS}, lost_ AS (SELECT job_id FROM jobs_ WHERE status = 'interrupted' OR (status = 'running' AND job_id % 2 = 1)), n_ AS (SELECT CASE WHEN status = 'processing' AND job_id IN (SELECT job_id FROM lost_) THEN 'pending' ELSE status END AS status FROM files_) SELECT status, count(*) AS files FROM n_ GROUP BY status",
    "error_class": f"SELECT event_id, CASE {_ERROR} ELSE coalesce(nullif(p, ''), '{reports.HANDLING}') || '{reports.FAILED}' END || '：' || m AS shown FROM (SELECT event_id, {_MESSAGE} AS m, {_PHASE} AS p FROM events)",
    "status_message": f"WITH {_FILES} SELECT DISTINCT status, CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.SUCCESS.items()) + " ELSE status END AS shown FROM files_",
}
