"""Scans of folders, with content hashes and exclusion rules, and decoding of text files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspar.functions import paths as P

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def listing(files: DataFrame) -> DataFrame:
    """(file_path, filename, file_type, size_bytes, modified_at, reason, file_hash) of rows as the binaryFile source has them.

    ``reason`` is why a file isn't imported (null for a file that is); the hash is the MD5 of the content.
    """
    return files.select(
        plain_path(F.col("path")).alias("file_path"),
        P.name_of(F.col("path")).alias("filename"),
        P.file_type(F.col("path")).alias("file_type"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        P.exclusion_reason(F.col("path"), F.col("length"), F.substring("content", 1, P.HEADER_BYTES)).alias("reason"),
        F.md5("content").alias("file_hash"),
    )


def plain_path(path: Column) -> Column:
    """A path without the scheme of the local file system."""
    return F.regexp_replace(path, "^file:(//)?(?=/)", "")


def plain_root(root: str) -> str:
    return re.sub("^file:(//)?(?=/)", "", root)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder (or one file) with their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The listing of the importable files below ``root``."""
    return listing(read_files(spark, root)).where("reason is null")


def supported(spark: SparkSession, root: str) -> DataFrame:
    """The importable files as they are shown: in order of their paths in lower case."""
    return scan(spark, root).orderBy(F.lower("file_path"), "file_path")


def decode(content: Column) -> Column:
    """Text of bytes: UTF-8 if valid, else GB 18030, else Latin-1. Only bytes that aren't UTF-8 go to Python."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(_legacy(F.when(~F.is_valid_utf8(content.cast("string")), content)))


@F.arrow_udf(StringType())
def _legacy(content: pa.Array) -> pa.Array:
    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        try:
            return data.decode("gb18030")
        except UnicodeDecodeError:
            return data.decode("latin-1")

    return pa.array([one(x.as_py()) for x in content], pa.string())


def parse(files: DataFrame) -> DataFrame:
    """(file_path, file_type, segments) of importable binaryFile rows: the whole text, code units, or paragraphs and tables.

    Units of code have their name and lines as JSON in ``metadata``. A file that can't be parsed has null segments and its message in ``error``; it doesn't stop the others.
    """
    from . import parsers

    rows = files.withColumn("file_type", P.file_type(F.col("path")))
    rows = rows.where(P.exclusion_reason(F.col("path"), F.col("length"), F.substring("content", 1, P.HEADER_BYTES)).isNull())
    plain = rows.where("file_type = 'text'").select("path", "file_type", F.array(F.struct(decode(F.col("content")).alias("content"), F.lit("text").alias("content_type"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("metadata"))).alias("segments"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, kind, content = (batch.column(c)[k].as_py() for c in ("path", "file_type", "content"))
                segments, error = parsers.parse(path, kind, content)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([kind]), pa.array([segments], parsers.SEGMENTS), pa.array([error], pa.string())], ["path", "file_type", "segments", "error"])

    other = rows.where("file_type <> 'text'").select("path", "file_type", "content").mapInArrow(run, "path string, file_type string, segments array<struct<content:string,content_type:string,page_number:int,metadata:string>>, error string")
    return plain.unionByName(other).withColumnRenamed("path", "file_path")
