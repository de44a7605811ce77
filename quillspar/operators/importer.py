"""Imports of folders as batch steps over a versioned store: plan, parse, chunk, embed, publish, report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.functions.embedding import embed as hashed
from quillspar.sources import files as S

from . import metadata, progress, reports, sync
from .chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk, chunk_id, source_label
from .store import Store

NO_TEXT = "no indexable text"
DOCUMENTS = "document_id string, file_path string, filename string, file_type string, file_hash string, size_bytes bigint, modified_at timestamp, sensor_model string, manufacturer string, metadata_json string, index_profile string, status string, imported_at timestamp"
CHUNKS = "chunk_id string, document_id string, chunk_index int, content string, content_type string, page_number int, source_label string"
VECTORS = "chunk_id string, document_id string, embedding array<float>"
FILES = "job_id string, file_id string, file_path string, file_hash string, status string, phase string, message string, error string"
JOBS = "job_id string, source_path string, status string, created_at timestamp, scanned bigint, imported bigint, updated bigint, skipped bigint, deleted bigint, failed bigint"
EVENTS = "job_id string, created_at timestamp, level string, phase string, message string, file_path string"
_SCHEMAS = {"documents": DOCUMENTS, "chunks": CHUNKS, "vectors": VECTORS, "files": FILES, "jobs": JOBS, "events": EVENTS}


class Importer:
    """Imports of folders into the tables documents, chunks, vectors, files, jobs and events of a store.

    What a step makes is written before the next one reads it. New documents are published with their chunks as 'indexing' first, so that a run that breaks off
    is resumed by the next one without parsing again; they become 'imported' in the same publication that shows their vectors. A
    document that is updated keeps its old version until then, and for good if its file fails. One file's damage stays in its row.
    """

    def __init__(self, spark: SparkSession, store: Store, embed: Callable[[Column], Column] = hashed, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, ocr: bool = False, **profile):
        self.spark, self.store, self.embed, self.size, self.overlap = spark, store, embed, size, overlap
        settings = {"chunk_size": size, "chunk_overlap": overlap, **profile}
        self.profile = F.when(F.col("file_type") == "pdf", sync.index_profile("pdf", ocr, **settings)).otherwise(sync.index_profile("text", ocr, **settings))

    def read(self, table: str) -> DataFrame:
        """The current version of a table, empty if there is none yet."""
        return self.store.read(table) if self.store.exists(table) else self.spark.createDataFrame([], _SCHEMAS[table])

    def plan(self, scan: DataFrame, documents: DataFrame | None = None) -> DataFrame:
        """The action for each file of a listing; see sync.import_plan."""
        return sync.import_plan(scan, self.read("documents") if documents is None else documents, self.read("chunks"), self.profile)

    def parsed(self, root: str, wanted: DataFrame) -> DataFrame:
        """(file_path, segments, error) of the files of these paths; files without text have an error."""
        content = S.read_files(self.spark, root).withColumn("file_path", S.plain_path(F.col("path")))
        rows = S.parse(content.join(wanted.select("file_path"), "file_path", "left_semi").drop("file_path"))
        blank = ~F.exists(F.coalesce("segments", F.array().cast(dict(rows.dtypes)["segments"])), lambda s: F.coalesce(s["content"], F.lit("")).rlike(r"(?U)\S"))
        return rows.select(S.plain_path(F.col("file_path")).alias("file_path"), "segments", F.coalesce("error", F.when(blank, NO_TEXT)).alias("error"))

    def _documents(self, made: DataFrame) -> DataFrame:
        """Document rows of parsed files, still being indexed."""
        found = metadata.document_metadata(made.withColumn("created_at", F.lit(None).cast("timestamp")))
        rows = made.select("document_id", "file_path", "file_hash").join(found, "file_path")
        cleaned = metadata.clean(rows, ("file_path",))
        rows = rows.join(cleaned, "file_path").withColumn("index_profile", self.profile).withColumn("status", F.lit("indexing")).withColumn("imported_at", F.lit(None).cast("timestamp"))
        return rows.select(*self.read("documents").columns)

    def _chunks(self, made: DataFrame) -> DataFrame:
        rows = chunk(made.select("document_id", "filename", "segments"), self.size, self.overlap)
        label = source_label(F.col("filename"), F.col("page_number"), F.col("chunk_index"))
        return rows.select(chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "document_id", "chunk_index", "content", "content_type", "page_number", label.alias("source_label"))

    def run(self, root: str, job_id: str, stop: progress.Stop | None = None) -> DataFrame:
        """Import the files below ``root`` and give the job's report; see progress.report. The same call again resumes what broke off."""
        stop = stop or progress.Stop(self.spark, job_id)
        stop.begin()
        now, keep = F.current_timestamp(), self.store.staged
        job = self.spark.createDataFrame([(job_id, root)], "job_id string, source_path string").select("*", F.lit("running").alias("status"), now.alias("created_at"), *[F.lit(0).cast("bigint").alias(c) for c in ("scanned", "imported", "updated", "skipped", "deleted", "failed")])
        self.store.publish(jobs=sync.upsert(self.read("jobs"), job, "job_id"))
        try:
            files, gone = self._steps(root, job_id, stop, keep)
            status = None
        except progress.Stop.Asked:
            files, gone, status = self.read("files").where(F.col("job_id") == job_id), 0, "interrupted"
        except Exception:
            self._finish(job, self.read("files").where(F.col("job_id") == job_id), 0, "failed")
            raise
        self._finish(job, files, gone, status)
        return progress.report(files)

    def _finish(self, job: DataFrame, files: DataFrame, gone: int, status: str | None) -> None:
        counts = reports.job_counters(files)
        rows = job.select("job_id", "source_path", "created_at").join(counts, "job_id", "left").withColumn("deleted", F.lit(gone).cast("bigint"))
        rows = rows.fillna(0, ["scanned", "imported", "updated", "skipped", "failed"])
        rows = reports.finished(rows).drop("report_json")
        rows = rows.withColumn("status", F.lit(status)) if status else rows
        self.store.publish(jobs=sync.upsert(self.read("jobs"), self.store.staged(rows), "job_id"))

    def _steps(self, root: str, job_id: str, stop: progress.Stop, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
        scan = keep(S.scan(self.spark, root))
        moves = keep(sync.reconcile(scan, self.read("documents"), S.plain_root(root)))
        gone = moves.where("action = 'delete'").select("document_id")
        left = lambda table: self.read(table).join(gone, "document_id", "left_anti")
        moved = moves.where("action = 'move'").select("document_id", F.col("new_path").alias("file_path"), F.regexp_extract("new_path", "([^/]*)$", 1).alias("filename"))
        old_documents, old_chunks, old_vectors = keep(sync.update_metadata(left("documents"), moved, "document_id")), left("chunks"), left("vectors")
        plan = keep(self.plan(scan, old_documents))
        file_id = F.sha2(F.concat(F.lit(f"{job_id} "), F.col("file_path")), 256)
        files = plan.join(scan.select("file_path", "file_hash"), "file_path").select(F.lit(job_id).alias("job_id"), file_id.alias("file_id"), "file_path", "file_hash", F.lit("pending").alias("status"), F.lit("").alias("phase"), F.lit("").alias("message"), F.lit(None).cast("string").alias("error"))
        others = self.read("files").where(F.col("job_id") != job_id)
        self.store.publish(files=others.unionByName(keep(files)))
        files = self.read("files").where(F.col("job_id") == job_id)
        stop.check()

        new_id = F.coalesce("document_id", F.sha2("file_path", 256))
        fresh = plan.where("action in ('import', 'update', 'rebuild')")
        parsed = keep(self.parsed(root, fresh))
        made = parsed.where("error is null").join(fresh.select("file_path", "action", new_id.alias("document_id")), "file_path").join(scan.drop("reason"), "file_path")
        documents, chunks = keep(self._documents(made)), keep(self._chunks(made))
        stop.check()

        # New documents and their chunks are kept at once; updated ones wait for their vectors.
        begun = made.where("action <> 'update'").select("document_id")
        held = lambda df: df.join(begun, "document_id", "left_semi")
        rest = lambda df: df.join(begun, "document_id", "left_anti")
        self.store.publish(documents=rest(old_documents).unionByName(held(documents)), chunks=rest(old_chunks).unionByName(held(chunks)), vectors=rest(old_vectors))
        stop.check()

        reused = plan.where("action = 'reuse'").select("file_path", "reuse_id", new_id.alias("document_id"))
        resumed = plan.where("action = 'resume'").select("document_id")
        pairs = reused.select("reuse_id", "document_id")
        cloned = keep(sync.clone_chunks(old_chunks, old_vectors, pairs))
        broken = sync.missing_vectors(old_chunks.join(resumed, "document_id", "left_semi"), old_vectors)
        missing = chunks.select("chunk_id", "document_id", "content").unionByName(broken.select("chunk_id", "document_id", "content")).unionByName(cloned.where("embedding is null").select("chunk_id", "document_id", "content"))
        embedded = keep(missing.select("chunk_id", "document_id", self.embed(F.col("content")).alias("embedding")))
        stop.check()

        source = old_documents.select(F.col("document_id").alias("reuse_id"), "sensor_model", "manufacturer", F.col("metadata_json").alias("stored"), F.col("file_path").alias("reused_path"), F.col("index_profile").alias("profile"))
        clones = reused.join(source, "reuse_id").join(scan.drop("reason"), "file_path")
        changed = {c: F.col(c).cast("string") for c in ("filename", "file_path", "file_type", "size_bytes", "modified_at", "file_hash")} | {"reused_from_document_id": F.col("reuse_id"), "reused_from_file_path": F.col("reused_path")}
        clones = clones.withColumn("metadata_json", metadata.merge_json(F.col("stored"), changed)).withColumnRenamed("profile", "index_profile").withColumn("status", F.lit("imported")).withColumn("imported_at", F.current_timestamp())
        clones = keep(clones.select(*old_documents.columns))
        done = lambda df: df.withColumn("status", F.lit("imported")).withColumn("imported_at", F.current_timestamp())
        ready = done(documents).unionByName(done(old_documents.join(resumed, "document_id", "left_semi"))).unionByName(clones)

        replaced = ready.select("document_id")
        stays = lambda df: df.join(replaced.join(resumed, "document_id", "left_anti"), "document_id", "left_anti")
        self.store.publish(
            documents=old_documents.join(replaced, "document_id", "left_anti").unionByName(ready),
            chunks=stays(old_chunks).unionByName(chunks).unionByName(cloned.select(*old_chunks.columns)),
            vectors=stays(old_vectors).unionByName(embedded).unionByName(cloned.where("embedding is not null").select(*old_vectors.columns)),
        )
        outcomes = plan.join(parsed.select("file_path", "error"), "file_path", "left").select(file_id.alias("file_id"), F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("result")).alias("outcome"), F.coalesce("error", F.when(F.col("result") == "failed", "permission denied")).alias("failure"))
        outcomes = keep(outcomes)
        handled = keep(progress.transitions(files, outcomes))
        events = progress.events_of(handled, outcomes).withColumn("created_at", F.current_timestamp())
        self.store.publish(files=others.unionByName(handled), events=self.read("events").unionByName(events))
        return handled, gone.count()
