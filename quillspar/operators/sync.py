"""Incremental synchronisation as set-based plans: what to import, reuse, resume, move and delete."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspar.functions import paths as P

from .chunking import chunk_id

BASE = ("version", "chunk_size", "chunk_overlap", "embedding_backend", "embedding_model", "embedding_dimension")
# Index settings and their defaults.
PROFILE = {"version": 1, "chunk_size": 512, "chunk_overlap": 128, "embedding_backend": "bge", "embedding_model": "BAAI/bge-m3", "embedding_dimension": 1024}
OCR = {"ocr_lang": "ch", "ocr_min_text_chars": 80, "ocr_max_pages_per_file": 20, "ocr_render_scale": 1.5}


def index_profile(file_type: str, ocr: bool = False, **changes) -> str:
    """The settings that an index depends on, as compact JSON with sorted keys. OCR settings count for PDF alone."""
    mode = ocr and file_type == "pdf"
    out = PROFILE | {"mode": "ocr" if mode else "text"} | (OCR if mode else {})
    return json.dumps(out | {k: v for k, v in changes.items() if k in out}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _field(profile: Column, name: str) -> Column:
    return F.get_json_object(profile, f"$.{name}")


def profile_satisfies(existing: Column, target: Column) -> Column:
    """Whether an index of one profile serves the other. None serves anything but OCR; equal ones do; an OCR index serves text of the same settings."""
    missing = existing.isNull() | (existing == "")
    serves = (_field(existing, "mode") == "ocr") & (_field(target, "mode") == "text")
    for name in BASE:
        serves = serves & _field(existing, name).eqNullSafe(_field(target, name))
    return F.when(missing, ~_field(target, "mode").eqNullSafe(F.lit("ocr"))).otherwise((existing == target) | F.coalesce(serves, F.lit(False)))


def content_groups(documents: DataFrame) -> DataFrame:
    """(file_hash, copies, first_id): documents of equal content and the smallest id of each."""
    return documents.groupBy("file_hash").agg(F.count("*").alias("copies"), F.min("document_id").alias("first_id"))


def reusable(documents: DataFrame, chunks: DataFrame, target: Column) -> DataFrame:
    """(file_hash, reuse_id): the earliest published document of each content whose index serves and which has chunks."""
    ready = documents.where("status = 'imported'").where(profile_satisfies(F.col("index_profile"), target))
    ready = ready.join(chunks.select("document_id"), "document_id", "left_semi")
    return ready.groupBy("file_hash").agg(F.min_by("document_id", F.struct("imported_at", "document_id")).alias("reuse_id"))


def import_plan(scan: DataFrame, documents: DataFrame, chunks: DataFrame, target: str | Column) -> DataFrame:
    """The action for each scanned file (file_path, file_hash): (file_path, action, result, document_id, reuse_id).

    In this order: an unchanged published file is skipped; one whose indexing broke off with chunks kept is resumed; content that another
    published document has is reused; a published document of other content is updated, one in another state rebuilt; the rest are imported. Null
    hashes (unreadable files) fail, and their documents stay. ``target`` is the index profile wanted, or a column of it over file_type, which then both tables have.
    Of documents that share a path the one of smallest id is taken.
    """
    profile = F.lit(target) if isinstance(target, str) else target
    taken = ["file_hash"] if isinstance(target, str) else ["file_hash", "file_type"]
    documents = documents.groupBy("file_path").agg(F.min_by(F.struct(*[c for c in documents.columns if c != "file_path"]), "document_id").alias("d")).select("file_path", "d.*")
    existing = documents.select("file_path", F.col("document_id").alias("existing_id"), F.col("file_hash").alias("old_hash"), "status", "index_profile")
    kept = chunks.select(F.col("document_id").alias("existing_id")).distinct().withColumn("has_chunks", F.lit(True))
    rows = scan.select("file_path", *taken).join(existing, "file_path", "left").join(kept, "existing_id", "left").join(reusable(documents, chunks, profile), "file_hash", "left")
    there, same = F.col("existing_id").isNotNull(), F.coalesce(F.col("old_hash") == F.col("file_hash"), F.lit(False))
    serves = there & profile_satisfies(F.col("index_profile"), profile)
    published = F.coalesce(F.col("status") == "imported", F.lit(False))
    action = (
        F.when(F.col("file_hash").isNull(), "fail")
        .when(there & same & published & serves, "skip")
        .when(there & same & (F.col("status") == "indexing") & serves & F.col("has_chunks"), "resume")
        .when(F.col("reuse_id").isNotNull(), "reuse")
        .when(there & published, "update")
        .when(there, "rebuild")
        .otherwise("import")
    )
    result = F.when(F.col("action") == "fail", "failed").when(F.col("action") == "skip", "skipped").when((F.col("action") == "reuse") & ~there, "skipped").when(there, "updated").otherwise("imported")
    rows = rows.withColumn("action", action).withColumn("result", result)
    return rows.select("file_path", "action", "result", F.col("existing_id").alias("document_id"), F.when(F.col("action") == "reuse", F.col("reuse_id")).alias("reuse_id"))


def reconcile(scan: DataFrame, documents: DataFrame, root: str) -> DataFrame:
    """What becomes of documents below ``root`` whose path was not scanned: (document_id, file_path, action, new_path).

    Such a document has moved if its content is at a scanned path that no document has; the first by path takes the first free path of its content,
    the second the next, and so on. The others are deleted. A path that was scanned is never deleted, even if its file could not be read.
    """
    stale = documents.where(P.under_root(F.col("file_path"), root)).join(scan.select("file_path"), "file_path", "left_anti")
    free = scan.where("file_hash is not null").join(documents.select("file_path"), "file_path", "left_anti").join(stale.select("file_hash"), "file_hash", "left_semi")
    turn = F.row_number().over(Window.partitionBy("file_hash").orderBy("file_path"))
    free = free.select("file_hash", F.col("file_path").alias("new_path"), turn.alias("turn"))
    ranked = stale.select("document_id", "file_path", "file_hash", F.row_number().over(Window.partitionBy("file_hash").orderBy("file_path", "document_id")).alias("turn"))
    out = ranked.join(free, ["file_hash", "turn"], "left")
    return out.select("document_id", "file_path", F.when(F.col("new_path").isNull(), "delete").otherwise("move").alias("action"), "new_path")


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that have no vector yet."""
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def orphan_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors that have no chunk."""
    return vectors.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def stale_vectors(vectors: DataFrame, keep: DataFrame, file_path: str, document_id: str) -> DataFrame:
    """Vectors of a path or a document that are not to be kept."""
    return vectors.where((F.col("file_path") == file_path) | (F.col("document_id") == document_id)).join(keep.select("chunk_id"), "chunk_id", "left_anti")


def recovery(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row (kept, deleted, vectors_cleaned) for documents whose indexing broke off: with chunks they are kept and their orphan vectors go; others are deleted."""
    broken = documents.where("status = 'indexing'").select("document_id")
    counts = broken.join(chunks.groupBy("document_id").agg(F.count("*").alias("n")), "document_id", "left")
    kept = counts.where("n > 0").select("document_id")
    orphans = orphan_vectors(vectors.join(kept, "document_id", "left_semi"), chunks).agg(F.count("*").alias("vectors_cleaned"))
    total = counts.agg(F.count_if(F.col("n") > 0).alias("kept"), F.count_if(F.col("n").isNull()).alias("deleted"))
    return total.join(F.broadcast(orphans))  # one row each


def clone_chunks(chunks: DataFrame, vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Chunks and vectors of reused documents under their new ids; ``pairs`` holds (reuse_id, document_id)."""
    source = chunks.withColumnRenamed("document_id", "reuse_id").join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")
    out = source.join(pairs, "reuse_id").drop("reuse_id")
    return out.withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("chunk_index")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def update_metadata(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the non-null values of ``new``; other columns, vectors among them, stay."""
    changed = [c for c in new.columns if c != key]
    rows = old.join(new.select(key, *[F.col(c).alias(f"new_{c}") for c in changed]), key, "left")
    return rows.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in changed else F.col(c) for c in old.columns])
