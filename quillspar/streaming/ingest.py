"""New files as a stream: each run takes what has come since the last one and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspar.operators.chunking import chunk, chunk_id, source_label
from quillspar.sources import files as S


def file_stream(spark: SparkSession, root: str, per_trigger: int | None = None) -> DataFrame:
    """Files below ``root`` as they come. Changes and deletions aren't seen; operators.sync plans those."""
    reader = spark.readStream.format("binaryFile").schema(S.SCHEMA).option("recursiveFileLookup", True)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(root)


def chunked(files: DataFrame) -> DataFrame:
    """Chunk rows of importable files, batch or stream."""
    rows = chunk(S.parse(files).where("segments is not null"))
    rows = rows.withColumn("document_id", F.sha2("file_path", 256)).withColumn("filename", F.regexp_extract("file_path", "([^/]*)$", 1))
    return rows.select("document_id", chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "file_path", "file_type", "chunk_index", "content", "content_type", "page_number", source_label(F.col("filename"), F.col("page_number"), F.col("chunk_index")).alias("source"))


def ingest(spark: SparkSession, root: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append the chunks of files that are new since the last run to a Parquet table; exactly once by the checkpoint."""
    return chunked(file_stream(spark, root)).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)
