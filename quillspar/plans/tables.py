"""The tables of a folder as the engine's documents, chunks, vectors and jobs, in Spark and in DuckDB's SQL."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.operators import chunking as C

#: Character classes of Spark's patterns as DuckDB's pattern language writes them.
SPACE = r"[\s\p{Z}\x{85}]"
CHUNK_TOKEN = r"[\x{4e00}-\x{9fff}]|[A-Za-z0-9_./%+\-]+|[^\s\p{Z}\x{85}]"
SEARCH_TOKEN = r"[\x{4e00}-\x{9fff}]|[a-z0-9_./%+\-]+"
STRIP = r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$"
STATUS = "CASE source WHEN 'src1' THEN 'indexing' WHEN 'src2' THEN 'failed' ELSE 'imported' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over as many tasks as shuffles have. A small file that rows are made many from is read in few tasks, which would do all the work."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where all runs in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return path or tempfile.mkdtemp(prefix="quillspar-")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a state that depends on their source: file_type is the language, manufacturer the source."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), "text", F.col("lang").alias("file_type"), F.col("source").alias("manufacturer"), F.expr(STATUS).alias("status"), F.md5(F.col("text").cast("binary")).alias("file_hash"), F.col("n_chars").alias("imported_at"))


DOCUMENTS = f"documents_ AS (SELECT doc_id AS document_id, text, lang AS file_type, source AS manufacturer, {STATUS} AS status, md5(text) AS file_hash, n_chars AS imported_at FROM documents)"


def chunks(spark: SparkSession, sf_dir: str, with_content: bool = True, ids: DataFrame | None = None) -> DataFrame:
    """Chunks of all documents, or of those of the few ``ids`` (one column), with their documents' columns."""
    d = documents(spark, sf_dir)
    if ids is not None:
        d = d.join(F.broadcast(ids.toDF("wanted")), F.col("document_id") == F.col("wanted"), "left_semi")
    cut = C.chunk(d.select("document_id", "file_type", "manufacturer", "status", F.array(C.segment(F.col("text"))).alias("segments")), with_content=with_content)
    label = C.source_label(F.concat(F.lit("doc"), F.col("document_id").cast("string")), F.col("page_number"), F.col("chunk_index"))
    return cut.withColumn("chunk_id", C.chunk_id(F.col("document_id"), F.col("chunk_index"))).withColumn("source", label)


def joined(tokens: str) -> str:
    """SQL of the text of a token list."""
    t = rf"regexp_matches(t, '^[\x{{4e00}}-\x{{9fff}}]') OR regexp_matches(t, '^[,.!?;:%)\]}}]')"
    p = rf"regexp_matches({tokens}[i - 1], '[\x{{4e00}}-\x{{9fff}}]$') OR regexp_matches({tokens}[i - 1], '[(\[{{/\-]$')"
    return f"array_to_string(list_transform({tokens}, lambda t, i: CASE WHEN i = 1 OR {t} OR {p} THEN t ELSE ' ' || t END), '')"


CHUNKS = f"""{DOCUMENTS},
tokens_ AS (SELECT document_id, file_type, manufacturer, status, regexp_extract_all(coalesce(text, ''), '{CHUNK_TOKEN}') AS ts FROM documents_),
windows_ AS (SELECT * EXCLUDE (ts), ts, unnest(range(0, CASE WHEN len(ts) = 0 THEN 0 WHEN len(ts) <= 512 THEN 1 ELSE ceil((len(ts) - 512) / 384.0)::INT + 1 END)) AS i FROM tokens_),
cuts_ AS (SELECT * EXCLUDE (ts), ts[i * 384 + 1 : i * 384 + 512] AS ts FROM windows_),
chunks_ AS (SELECT document_id, file_type, manufacturer, status, i::INT AS chunk_index, (i * 384)::INT AS token_offset, len(ts)::INT AS n_tokens, {joined("ts")} AS content,
            document_id || '#' || i AS chunk_id, 'doc' || document_id || ' #' || i AS source FROM cuts_)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as vectors of the first chunks of the documents of equal id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("vec_id").alias("document_id"), C.chunk_id(F.col("vec_id"), F.lit(0)).alias("chunk_id"), "embedding", "label")


VECTORS = "vectors_ AS (SELECT vec_id, vec_id AS document_id, vec_id || '#0' AS chunk_id, embedding, label FROM embeddings)"


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of id 0 as the query."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query_vector"))


def query_text(spark: SparkSession, sf_dir: str) -> str:
    """The first benchmark item as the query."""
    return table(spark, sf_dir, "benchmark").orderBy("item_id").first().text


QUERY_TEXT = "(SELECT text FROM benchmark ORDER BY item_id LIMIT 1)"
