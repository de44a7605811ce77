"""Metadata of documents and chunks: projections, clean-up, merging of stored JSON, JSON in model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspar.functions import text as T

# What a chunk's vector carries, and how many segments a document's hints come from.
CHUNK_KEYS = ("document_id", "source_label", "file_path", "file_type", "file_hash", "filename", "page_number", "sensor_model", "manufacturer", "chunk_index", "content_type")
EVIDENCE_SEGMENTS = 5
_JSON = r"(?s)(\[.*\]|\{.*\})"
_SCALARS = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double")


def document_metadata(files: DataFrame, tags: list[str] | None = None, notes: str | None = None) -> DataFrame:
    """The metadata of parsed files (file_path, filename, file_type, size_bytes, created_at, modified_at, segments): those columns but the segments, with
    tags joined by commas, notes, and the maker and model found in the first segments. A file without segments has neither."""
    evidence = F.array_join(F.transform(F.slice(F.coalesce("segments", F.array().cast(dict(files.dtypes)["segments"])), 1, EVIDENCE_SEGMENTS), lambda s: F.coalesce(s["content"], F.lit(""))), "\n")
    rows = files.select("file_path", "filename", "file_type", "size_bytes", "created_at", "modified_at", evidence.alias("evidence"))
    return rows.select("file_path", "filename", "file_type", "size_bytes", "created_at", "modified_at", F.lit(",".join(tags or [])).alias("tags"), F.lit(notes).cast("string").alias("notes"), T.manufacturer(F.col("evidence")).alias("manufacturer"), T.sensor_model(F.col("evidence")).alias("sensor_model"))


def chunk_metadata(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, CHUNK_KEYS): what goes beside each chunk's vector."""
    mine = documents.select("document_id", "file_path", "file_type", "file_hash", "filename", "sensor_model", "manufacturer")
    rows = chunks.select("chunk_id", "document_id", "source_label", "page_number", "chunk_index", "content_type").join(mine, "document_id")
    return rows.select("chunk_id", *CHUNK_KEYS)


def clean(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its columns other than ``keep`` as one JSON column metadata_json: nulls go, scalars stay, other values become strings. Text is kept as it is, not escaped."""
    kinds = dict(df.dtypes)
    values = [F.col(c) if kinds[c] in _SCALARS else F.col(c).cast("string").alias(c) for c in df.columns if c not in keep]
    return df.select(*keep, F.to_json(F.struct(*values)).alias("metadata_json"))


def merge_json(stored: Column, changes: dict[str, Column]) -> Column:
    """A stored JSON object with the changed keys put at its end, nulls included; what isn't an object counts as empty. Other values stay as they are written."""
    kept = F.map_filter(F.from_json(F.when(F.ltrim(stored).startswith("{"), stored), "map<string,variant>"), lambda k, v: ~k.isin(*changes))
    kept = F.coalesce(kept, F.create_map().cast("map<string,variant>"))
    old = F.transform(F.map_entries(kept), lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null"))))
    old = F.transform(old, lambda x: F.regexp_replace(x, r'^\[("(?:[^"\\]|\\.)*")\]:', "$1:"))
    new = F.array(*[F.concat(F.lit(f'"{k}":'), F.coalesce(F.regexp_replace(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", "$1"), F.lit("null"))) for k, v in changes.items()])
    return F.concat(F.lit("{"), F.array_join(F.concat(old, new), ","), F.lit("}"))


def json_in(reply: Column) -> Column:
    """The first JSON array or object in a model's reply, from its opening to the last closing mark; null if there is none."""
    return F.nullif(F.regexp_extract(reply, _JSON, 1), F.lit(""))


def parameter_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """(other columns, name, normalized_name, value, page_number): the parameters that replies list; a reply that lists none gives no rows."""
    item = "array<struct<name:string,normalized_name:string,value:string,page_number:string>>"
    others = [c for c in replies.columns if c != reply]
    rows = replies.select(*others, F.explode_outer(F.from_json(json_in(F.col(reply)), item)).alias("p")).where("p is not null")
    return rows.select(*others, "p.name", "p.normalized_name", "p.value", page_number(F.col("p.page_number")).alias("page_number"))


def page_number(x: Column) -> Column:
    """A page as a whole number, null where it is blank or none."""
    return F.btrim(x.cast("string")).try_cast("int")
