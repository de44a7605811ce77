"""Pages of long documents: which are read by OCR, what becomes segments, and chunks that are appended batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunking import next_index

#: Characters that a page has at least if it needs no OCR, and pages of a document that OCR reads at most (0: no bound).
LEAST_CHARS, MOST_PAGES = 80, 20


def ocr_gate(pages: DataFrame, least: int = LEAST_CHARS, most: int = MOST_PAGES, enabled: bool = True) -> DataFrame:
    """``pages`` (document_id, page_number, text) with ``ocr``: whether a page is read by OCR, poor pages being taken in order of pages up to ``most``."""
    poor = F.length(F.btrim(F.coalesce("text", F.lit("")))) < least
    used = F.count_if(poor).over(Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1))
    return pages.withColumn("ocr", poor & F.lit(enabled) & (F.lit(most <= 0) | (F.coalesce(used, F.lit(0)) < most)))


def ocr_text(found: Column) -> Column:
    """The lines that a recogniser found, each once and in their order; blank ones go."""
    return F.array_join(F.array_distinct(F.filter(F.transform(found, lambda x: F.btrim(x)), lambda x: x != "")), "\n")


def page_segments(pages: DataFrame) -> DataFrame:
    """(document_id, segments) of pages (document_id, page_number, text, tables, ocr_text): of each page in order its text, its tables, its OCR text, as far as they aren't blank."""
    part = lambda content, kind: F.struct(content.alias("content"), F.lit(kind).alias("content_type"), F.col("page_number").cast("int").alias("page_number"))
    whole = F.concat(F.array(part(F.col("text"), "text")), F.transform(F.coalesce("tables", F.array().cast("array<string>")), lambda t: part(t, "table")), F.array(part(F.col("ocr_text"), "text")))
    kept = F.filter(whole, lambda s: F.coalesce(s["content"], F.lit("")).rlike(r"(?U)\S"))
    gathered = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", kept.alias("s")))).alias("p"))
    return gathered.select("document_id", F.flatten(F.transform("p", lambda x: x["s"])).alias("segments"))


def continued(chunks: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` (document_id, batch, chunk_index, ...) renumbered to follow the document's ``chunks``: batches in order, each in its own order."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("batch", "chunk_index")) - 1
    rows = more.join(next_index(chunks), "document_id", "left").withColumn("chunk_index", (F.coalesce("next_index", F.lit(0)) + place).cast("int"))
    return rows.drop("next_index", "batch")
