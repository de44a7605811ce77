"""Parameters of technical documents: extraction, comparison and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspar.functions import text as T
from quillspar.functions import values as V

MISSING, NO_SOURCE = "未找到", "未在已入库文档中找到依据"
HEADING, SOURCE = "参数", "来源: "
_ORDER = ("chunk_index", "kind", "line")
#: Kinds of parameters.
TABLE, PAIR = 0, 1


def extract(chunks: DataFrame, kinds: tuple[int, ...] = (TABLE, PAIR)) -> DataFrame:
    """Parameters of (document_id, chunk_index, content, page_number) rows, every occurrence.

    Rows of Markdown tables (of two lines or more, rules left out) give their first two cells; 'label: value' lines give a pair. A chunk's table rows
    come before its pairs. Labels of no known field and blank values give nothing. Only parameters of the given ``kinds`` are looked for.
    """
    where = ("document_id", "chunk_index", "page_number")
    rows = chunks.select(*where, F.transform(T.lines(F.col("content")), T.strip).alias("lines"))
    rows = rows.withColumn("table", F.size(F.filter("lines", lambda x: x.startswith("|"))) >= 2)
    rows = rows.select(*where, "table", F.posexplode_outer("lines").alias("line", "source_text"))
    # columns of their own, so that no line is cut up twice
    text, where = F.col("source_text"), (*where, "line", "source_text")
    cells = F.split(F.regexp_replace(text, r"^\|+|\|+$", ""), r"\|", 3)  # the first two, and the rest
    rows = rows.select(*where, F.when(F.col("table") & text.startswith("|") & ~text.contains("---"), cells).alias("cells"), V.colon(text).alias("colon"))
    rows = rows.select(*where, "cells", F.substring(text, F.lit(1), F.col("colon") - 1).alias("head"), F.substring(text, F.col("colon") + 1, F.length(text)).alias("rest"))
    rows = rows.select(*where, *[T.strip(F.get("cells", F.lit(k))).alias(f"cell{k}") for k in (0, 1)], V.pair(text, F.col("head"), F.col("rest")).alias("pair"))
    named = {TABLE: (F.col("cell0"), F.col("cell1"), V.TABLE_CONFIDENCE), PAIR: (F.col("pair")["name"], F.col("pair")["found"], V.PAIR_CONFIDENCE)}
    some = [F.when((name != "") & (found != ""), F.struct(F.lit(k).alias("kind"), name.alias("name"), found.alias("found"), F.lit(sure).alias("confidence"))) for k, (name, found, sure) in named.items() if k in kinds]
    both = rows.select(*where, F.explode(F.array(*some)).alias("p")).where("p is not null").select(*where, "p.*")
    both = both.withColumn("low", V.folded(F.col("name")))
    # a generator, through which the filter doesn't go, so that fields are looked up once
    both = both.select("*", F.explode_outer(F.array(V.field_in(F.col("low")))).alias("normalized_name")).where("normalized_name is not null")
    return both.select("document_id", *_ORDER, "name", "normalized_name", V.value_of(F.col("found")).alias("value"), V.unit_of(F.col("found")).alias("unit"), "source_text", "page_number", "confidence")


def candidates(found: DataFrame, limit: int = 80) -> DataFrame:
    """The first candidates of each document, in the order they were found: those that a language model is asked about."""
    turn = F.row_number().over(Window.partitionBy("document_id").orderBy(*_ORDER))
    return found.withColumn("turn", turn).where(F.col("turn") <= limit).drop("turn")


def replaced(stored: DataFrame, found: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored parameters with those of ``documents`` (document_id) replaced by the ones found anew, none of them staying where none are found."""
    return stored.join(documents.select("document_id"), "document_id", "left_anti").unionByName(found.join(documents.select("document_id"), "document_id", "left_semi"), allowMissingColumns=True)


def dedupe(found: DataFrame) -> DataFrame:
    """The first of equal parameters of a document: same field, same value in any case, same page."""
    rest = [c for c in found.columns if c not in ("document_id", "normalized_name", "page_number")]
    first = found.groupBy("document_id", "normalized_name", F.lower("value").alias("low"), "page_number").agg(F.min_by(F.struct(*rest), F.struct(*_ORDER)).alias("first"))
    return first.select("document_id", "normalized_name", "page_number", "first.*")


def first_value(found: DataFrame, field: str) -> DataFrame:
    """(document_id, value) of the first parameter of a field."""
    return found.where(F.col("normalized_name") == field).groupBy("document_id").agg(F.min_by("value", F.struct(*_ORDER)).alias("value"))


def with_model(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Parameters with their document's model, which is its own or else the first one extracted. It is looked for among a document's rows, so that nothing is extracted twice."""
    own, hit = documents.select("document_id", "filename", F.col("sensor_model").alias("own")), F.col("normalized_name") == "model"
    first = F.min_by(F.when(hit, F.col("value")), F.when(hit, F.struct(*_ORDER))).over(Window.partitionBy("document_id"))
    return found.withColumn("extracted", first).join(own, "document_id").withColumn("sensor_model", F.coalesce("own", "extracted")).drop("own", "extracted")


def backfill(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with a blank model or manufacturer filled in from their first parameters."""
    out = documents
    for column, field in (("sensor_model", "model"), ("manufacturer", "manufacturer")):
        new = first_value(found, field).withColumnRenamed("value", "new")
        out = out.join(new, "document_id", "left").withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), F.col("new"))).drop("new")
    return out


def confirm(found: DataFrame, replies: DataFrame) -> DataFrame:
    """Parameters that a language model confirmed: replies (name, value, page_number, normalized_name) whose first three are among the candidates rename
    the field and raise the confidence, at most to 1. Candidates without a reply go; if no reply matches, all stay as they are."""
    keys = [found[c].eqNullSafe(replies[c]) for c in ("name", "value", "page_number")]
    hit = found.join(replies, keys, "inner").select(*[found[c] for c in found.columns if c not in ("normalized_name", "confidence")], F.coalesce(replies["normalized_name"], found["normalized_name"]).alias("normalized_name"), F.least(F.lit(1.0), F.round(found["confidence"] + V.CONFIRMED, 6)).alias("confidence"))
    none = hit.limit(1).agg((F.count("*") == 0).alias("none"))
    return hit.unionByName(found.join(F.broadcast(none)).where("none").drop("none"))


def cell_value(value: Column, unit: Column) -> Column:
    return F.when(unit.isNotNull() & (F.instr(value, unit) == 0), F.concat(value, F.lit(" "), unit)).otherwise(value)


def cell_source(filename: Column, page: Column, text: Column) -> Column:
    return F.concat(filename, F.when(page != 0, F.concat(F.lit(" p."), page.cast("string"))).otherwise(F.lit("")), F.lit(" / "), F.substring(text, 1, 80))


def compare(found: DataFrame, models: list[str]) -> DataFrame:
    """(normalized_name, model, value, source): each model's first value of each field that any of them has; missing ones say so.

    ``found`` comes from with_model. Two to five models are compared. The first is the one of smallest (document_id, chunk, kind, line).
    """
    models = [m.strip() for m in models if m.strip()]
    if not 2 <= len(models) <= 5:
        raise ValueError("two to five models are compared")
    rows = found.where(F.col("sensor_model").isin(*models))
    cell = F.struct(cell_value(F.col("value"), F.col("unit")).alias("value"), cell_source(F.col("filename"), F.col("page_number"), F.col("source_text")).alias("source"))
    cells = rows.groupBy("normalized_name", F.col("sensor_model").alias("model")).agg(F.min_by(cell, F.struct("document_id", *_ORDER)).alias("cell"))
    fields = cells.groupBy("normalized_name").agg(F.map_from_entries(F.collect_list(F.struct("model", "cell"))).alias("cells"))  # at most five
    every = fields.select("normalized_name", "cells", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    got = F.element_at("cells", F.col("model"))
    return every.select("normalized_name", "model", F.coalesce(got["value"], F.lit(MISSING)).alias("value"), F.coalesce(got["source"], F.lit(NO_SOURCE)).alias("source"))


def pivot(cells: DataFrame, models: list[str]) -> DataFrame:
    """A row per field, a column per model."""
    return cells.groupBy("normalized_name").pivot("model", models).agg(F.first("value"))


def _lines(cells: DataFrame, models: list[str], cell: Column, head: list[str], row) -> DataFrame:
    made = cells.groupBy("normalized_name").pivot("model", models).agg(F.first(cell))
    body = made.select((F.row_number().over(Window.orderBy("normalized_name")) + len(head)).alias("line_no"), row([F.col("normalized_name"), *[F.col(f"`{m}`") for m in models]]).alias("line"))  # a row for each of 16 fields
    spark = cells.sparkSession
    return spark.createDataFrame([(k + 1, x) for k, x in enumerate(head)], "line_no int, line string").unionAll(body)


def _quoted(x: Column) -> Column:
    return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def csv_lines(cells: DataFrame, models: list[str]) -> DataFrame:
    """(line_no, line) of the comparison as CSV, value and source in each cell."""
    cell = F.concat(F.col("value"), F.lit(f" | {SOURCE}"), F.col("source"))
    return _lines(cells, models, cell, [",".join([HEADING, *models])], lambda c: F.concat_ws(",", *[_quoted(x) for x in c]))


def markdown_lines(cells: DataFrame, models: list[str]) -> DataFrame:
    """(line_no, line) of the comparison as a Markdown table."""
    cell = F.concat(F.col("value"), F.lit("<br><small>"), F.col("source"), F.lit("</small>"))
    head = ["| " + " | ".join(x) + " |" for x in ([HEADING, *models], ["---"] * (len(models) + 1))]
    return _lines(cells, models, cell, head, lambda c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |")))
