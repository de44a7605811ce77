"""Segments into chunks. A document's segments stay in its row, so chunks are numbered without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspar.functions import text as T

CHUNK_SIZE, CHUNK_OVERLAP = 512, 128
KEPT_WHOLE = ("table", "code")


def segment(content: Column, content_type: str | Column = "text", page: Column | None = None) -> Column:
    """A parsed segment as a struct."""
    kind = F.lit(content_type) if isinstance(content_type, str) else content_type
    return F.struct(content.alias("content"), kind.alias("content_type"), (F.lit(None).cast("int") if page is None else page.cast("int")).alias("page_number"))


def chunk(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, segments: str = "segments", with_content: bool = True) -> DataFrame:
    """The rows of ``df`` with ``segments`` exploded: (chunk_index, content, content_type, page_number, token_offset, n_tokens) beside the other columns.

    Text is cut into windows of max(64, size) tokens that overlap by ``overlap``, at most half of a window. Tables and code of up to
    2 * size tokens stay whole, also if blank. Chunks are numbered from 0 within a row, in segment order. Null or empty segments give no chunks.
    Without ``with_content`` the texts are not made and content is left out.
    """
    window = max(64, size)
    lap = min(max(0, overlap), window // 2)
    others = [c for c in df.columns if c != segments]

    def cut(s: Column) -> Column:
        n = F.size(s["tokens"])
        whole = F.struct(*[s["content"].alias("content")] * with_content, s["content_type"].alias("content_type"), s["page_number"].alias("page_number"), F.lit(0).alias("token_offset"), n.alias("n_tokens"))

        def piece(w: Column) -> Column:
            return F.struct(*[T.untokenize(w["tokens"]).alias("content")] * with_content, s["content_type"].alias("content_type"), s["page_number"].alias("page_number"), w["at"].alias("token_offset"), F.size(w["tokens"]).alias("n_tokens"))

        keep = s["content_type"].isin(*KEPT_WHOLE) & (n <= 2 * size)
        windows = F.transform(T.window_starts(n, window, lap), lambda at: F.struct(at.alias("at"), F.slice(s["tokens"], at + 1, window).alias("tokens")))
        return F.when(keep, F.array(whole)).otherwise(F.transform(windows, piece))

    tokenized = F.transform(segments, lambda s: F.struct(s["content"].alias("content"), s["content_type"].alias("content_type"), s["page_number"].alias("page_number"), T.chunk_tokens(F.coalesce(s["content"], F.lit(""))).alias("tokens")))
    cuts = df.select(*others, tokenized.alias("tokenized")).select(*others, F.flatten(F.transform("tokenized", cut)).alias("pieces"))
    # An inner explode would have the optimizer put a filter on the pieces at the scan and make them twice.
    rows = cuts.select(*others, F.posexplode_outer("pieces").alias("chunk_index", "piece")).where("chunk_index is not null")
    return rows.select(*others, "chunk_index", "piece.*")


def source_label(filename: Column, page: Column, index: Column) -> Column:
    """'name p.3 #7'; the page is left out if null or 0."""
    return F.concat(filename, F.when(page != 0, F.concat(F.lit(" p."), page.cast("string"))).otherwise(F.lit("")), F.lit(" #"), index.cast("string"))


def chunk_id(document_id: Column, index: Column) -> Column:
    """A deterministic id, so that a run again gives the same rows."""
    return F.concat_ws("#", document_id.cast("string"), index.cast("string"))


def next_index(chunks: DataFrame) -> DataFrame:
    """The index that the next chunk of each document takes."""
    return chunks.groupBy("document_id").agg((F.max("chunk_index") + 1).alias("next_index"))


def first_evidence(chunks: DataFrame, n: int = 5) -> DataFrame:
    """(document_id, evidence): the first n chunks of each document by index, joined by newlines. At most n chunks of a document are gathered."""
    few = chunks.where(F.col("chunk_index") < n).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    return few.select("document_id", F.array_join(F.transform("c", lambda c: c["content"]), "\n").alias("evidence"))


def hints(evidence: DataFrame) -> DataFrame:
    """Model and manufacturer hints from evidence text."""
    return evidence.select("document_id", T.sensor_model(F.col("evidence")).alias("sensor_model"), T.manufacturer(F.col("evidence")).alias("manufacturer"))


def refresh_report(refreshed: DataFrame) -> DataFrame:
    """One row (scanned, updated) of refreshed documents."""
    return refreshed.agg(F.count("*").alias("scanned"), F.count_if("changed").alias("updated"))


def refresh(documents: DataFrame, found: DataFrame, overwrite: bool = False) -> DataFrame:
    """Documents with refreshed hints and whether a row changed. Without ``overwrite`` only blank values are filled in."""
    new = found.select("document_id", F.col("sensor_model").alias("new_model"), F.col("manufacturer").alias("new_maker"))
    rows = documents.join(new, "document_id", "left")

    def value(old: str, fresh: str) -> Column:
        blank = F.col(old).isNull() | (F.col(old) == "")
        return F.when(F.col(fresh).isNotNull() & (F.lit(overwrite) | blank), F.col(fresh)).otherwise(F.col(old))

    model, maker = value("sensor_model", "new_model"), value("manufacturer", "new_maker")
    changed = ~model.eqNullSafe(F.col("sensor_model")) | ~maker.eqNullSafe(F.col("manufacturer"))
    others = [c for c in documents.columns if c not in ("sensor_model", "manufacturer")]
    return rows.select(*others, model.alias("sensor_model"), maker.alias("manufacturer"), changed.alias("changed"))
