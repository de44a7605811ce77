"""Queries over datasheets, labels and files: hints, parameters, comparison, file types."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.functions import paths as P
from quillspar.functions import text as T
from quillspar.functions import values as V
from quillspar.operators import chunking, parameters
from quillspar.sources import parsers

from . import tables as D

MODELS = ["PX-11", "PX-12", "PX-13"]
_SIZE = "CAST(p_size AS STRING)"
#: Datasheets of every part, as lines and as a table. DuckDB knows chr, Spark both; || joins in both.
_LINES = f"'Model: PX-' || CAST(p_partkey AS STRING) || chr(10) || 'Brand: ' || p_brand || chr(10) || 'Type: ' || p_type || chr(10) || '  Dimensions : ' || {_SIZE} || ' mm' || chr(10) || '测距范围：-' || {_SIZE} || '~+85 ℃' || chr(10) || 'no value here' || chr(10) || 'Price: ' || {_SIZE}"
_TABLE = f"'| Parameter | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| IP Rating | IP67 |' || chr(10) || '| Model | PX-' || CAST(p_partkey AS STRING) || ' | x |' || chr(10) || '| Weight | ' || {_SIZE} || ' - 90 g |' || chr(10) || '| 精度 | ±' || {_SIZE} || ' cm, typ. |' || chr(10) || '|  | empty |'"
_SHEETS = (("kv-", 0, _LINES), ("kv-", 1, _LINES), ("tb-", 0, _TABLE))


def sheets(spark, sf_dir: str) -> DataFrame:
    """(document_id, filename, chunk_index, content, page_number): the lines twice, and the table."""
    part = D.spread(D.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size"))
    each = part.select("*", F.explode(F.array(*[F.lit(k) for k in range(len(_SHEETS))])).alias("sheet"))
    pick = lambda k: "CASE sheet " + " ".join(f"WHEN {n} THEN {s[k]}" for n, s in enumerate(_SHEETS)) + " END"
    head = "CASE sheet " + " ".join(f"WHEN {n} THEN '{s[0]}'" for n, s in enumerate(_SHEETS)) + " END"
    rows = each.selectExpr(f"{head} || CAST(p_partkey AS STRING) AS document_id", f"{pick(1)} AS chunk_index", f"{pick(2)} AS content", "p_size % 3 AS page_number")
    return rows.withColumn("filename", F.concat("document_id", F.lit(".txt")))


_SHEETS_SQL = "sheets_ AS (" + " UNION ALL ".join(f"SELECT '{a}' || p_partkey AS document_id, {k} AS chunk_index, {text} AS content, (p_size % 3)::INT AS page_number FROM part" for a, k, text in _SHEETS) + ")"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '{D.STRIP}', '', 'g')"


def _field(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(low, '{'|'.join(sorted({a.lower() for a in labels}))}') THEN '{field}'" for field, labels in V.FIELDS.items())
    return f"(SELECT CASE {cases} END FROM (SELECT lower(regexp_replace({_strip(x)}, '{D.SPACE}+', ' ', 'g')) AS low))"


_VALUE = rf"^([<>≤≥~±+\-]?{D.SPACE}*[\p{{Nd}}.]+(?:{D.SPACE}*[-~]{D.SPACE}*[\p{{Nd}}.]+)?)({D.SPACE}*[^\p{{Nd}}\s\p{{Z}}\x{{85}}]+.*)?$"
_PAIR = f"^([^:：]{{2,60}}){D.SPACE}*[:：]{D.SPACE}*(.{{1,180}})$"


def _value(x: str) -> str:
    return f"CASE WHEN regexp_matches({_strip(x)}, '{_VALUE}') THEN {_strip(f'''regexp_extract({_strip(x)}, '{_VALUE}', 1)''')} ELSE {_strip(x)} END"


def _unit(x: str) -> str:
    return f"CASE WHEN regexp_matches({_strip(x)}, '{_VALUE}') THEN nullif({_strip(f'''regexp_extract({_strip(x)}, '{_VALUE}', 2)''')}, '') END"


_FOUND = f"""{_SHEETS_SQL},
lines_ AS (SELECT document_id, chunk_index, page_number, list_transform(string_split(content, chr(10)), lambda x: {_strip("x")}) AS ls FROM sheets_),
line_ AS (SELECT document_id, chunk_index, page_number, len(list_filter(ls, lambda x: starts_with(x, '|'))) >= 2 AS tab, unnest(range(0, len(ls)))::INT AS line, unnest(ls) AS source_text FROM lines_),
cell_ AS (SELECT *, string_split(regexp_replace(source_text, '^\\|+|\\|+$', '', 'g'), '|') AS cells FROM line_),
cand_ AS (SELECT document_id, chunk_index, page_number, line, source_text, 0 AS kind, {_strip("cells[1]")} AS name, {_strip("cells[2]")} AS found, 0.85::DOUBLE AS confidence FROM cell_ WHERE tab AND starts_with(source_text, '|') AND NOT contains(source_text, '---') AND len(cells) >= 2
UNION ALL SELECT document_id, chunk_index, page_number, line, source_text, 1, {_strip(f"regexp_extract(source_text, '{_PAIR}', 1)")}, trim(regexp_extract(source_text, '{_PAIR}', 2), ' ;,，。'), 0.8 FROM line_ WHERE length(source_text) BETWEEN 4 AND 300 AND regexp_matches(source_text, '{_PAIR}')),
named_ AS (SELECT *, {_field("name")} AS normalized_name FROM cand_ WHERE name <> '' AND found <> ''),
found_ AS (SELECT document_id, chunk_index, kind, line, name, normalized_name, {_value("found")} AS value, {_unit("found")} AS unit, source_text, page_number, confidence FROM named_ WHERE normalized_name IS NOT NULL)"""
_DEDUPED = f"""{_FOUND}, deduped_ AS (SELECT * FROM found_ QUALIFY row_number() OVER (PARTITION BY document_id, normalized_name, lower(value), page_number ORDER BY chunk_index, kind, line) = 1)"""
_MODELS_SQL = ", ".join(f"('{m}')" for m in MODELS)
_CELLS = f"""{_DEDUPED}, model_ AS (SELECT document_id, arg_min(value, (chunk_index, kind, line)) AS sensor_model FROM deduped_ WHERE normalized_name = 'model' GROUP BY document_id),
have_ AS (SELECT d.*, m.sensor_model FROM deduped_ d JOIN model_ m USING (document_id) WHERE m.sensor_model IN (SELECT * FROM (VALUES {_MODELS_SQL}))),
best_ AS (SELECT *, CASE WHEN unit IS NOT NULL AND NOT contains(value, unit) THEN value || ' ' || unit ELSE value END AS shown, document_id || '.txt' || CASE WHEN page_number <> 0 THEN ' p.' || page_number ELSE '' END || ' / ' || substr(source_text, 1, 80) AS origin
          FROM have_ QUALIFY row_number() OVER (PARTITION BY normalized_name, sensor_model ORDER BY document_id, chunk_index, kind, line) = 1),
cells_ AS (SELECT f.normalized_name, m.model, coalesce(b.shown, '{parameters.MISSING}') AS value, coalesce(b.origin, '{parameters.NO_SOURCE}') AS source
           FROM (SELECT DISTINCT normalized_name FROM best_) f CROSS JOIN (VALUES {_MODELS_SQL}) m(model) LEFT JOIN best_ b ON b.normalized_name = f.normalized_name AND b.sensor_model = m.model)"""


def kv_params(spark, sf_dir):
    rows = parameters.extract(sheets(spark, sf_dir), (parameters.PAIR,))
    return rows.select("document_id", "chunk_index", "line", "name", "normalized_name", "value", "unit", "source_text", "page_number", "confidence")


def table_params(spark, sf_dir):
    rows = parameters.extract(sheets(spark, sf_dir), (parameters.TABLE,))
    return rows.select("document_id", "chunk_index", "line", "name", "normalized_name", "value", "unit", "source_text", "page_number", "confidence")


def param_dedupe(spark, sf_dir):
    rows = parameters.dedupe(parameters.extract(sheets(spark, sf_dir)))
    return rows.select("document_id", "normalized_name", "value", "unit", "page_number", "chunk_index", "kind", "line")


def _compared(spark, sf_dir):
    rows = sheets(spark, sf_dir)
    found = parameters.dedupe(parameters.extract(rows))
    docs = rows.select("document_id", "filename", F.lit(None).cast("string").alias("sensor_model")).distinct()
    return parameters.compare(parameters.with_model(found, docs), MODELS)


def compare_missing(spark, sf_dir):
    return _compared(spark, sf_dir)


def compare_pivot(spark, sf_dir):
    return parameters.pivot(_compared(spark, sf_dir), MODELS)


def compare_csv(spark, sf_dir):
    return parameters.csv_lines(_compared(spark, sf_dir), MODELS)


def compare_md(spark, sf_dir):
    return parameters.markdown_lines(_compared(spark, sf_dir), MODELS)


def model_hint(spark, sf_dir):
    return sheets(spark, sf_dir).select("document_id", "chunk_index", T.sensor_model(F.col("content")).alias("sensor_model"))


def manufacturer_hint(spark, sf_dir):
    return sheets(spark, sf_dir).select("document_id", "chunk_index", T.manufacturer(F.col("content")).alias("manufacturer"))


def first5_evidence(spark, sf_dir):
    rows = chunking.first_evidence(sheets(spark, sf_dir))
    return rows.join(chunking.hints(rows), "document_id").select("document_id", F.md5(F.col("evidence").cast("binary")).alias("evidence_md5"), "sensor_model", "manufacturer")


def refresh_hints(spark, sf_dir):
    """Fill-only refresh of documents that have a model already or none."""
    rows = sheets(spark, sf_dir)
    docs = rows.select("document_id", F.when(F.col("document_id").startswith("tb"), "ISO9001").alias("sensor_model"), F.lit("").alias("manufacturer")).distinct()
    return chunking.refresh(docs, chunking.hints(chunking.first_evidence(rows)))


_NOT_PREFIX = ", ".join(f"'{x}'" for x in T.NOT_MODEL_PREFIXES)
_LABEL = rf"(?i)(?:型号|产品型号|Model|Part{D.SPACE}*Number|P/N){D.SPACE}*[:：]{D.SPACE}*([A-Za-z0-9_\-./]+)"
_MAKER = rf"(?i)(?:制造商|厂商|品牌|Manufacturer|Brand){D.SPACE}*[:：]{D.SPACE}*([A-Za-z0-9\x{{4e00}}-\x{{9fff}} ._\-&()]+)"


def _model_sql(x: str) -> str:
    fits = f"NOT regexp_extract(lower(c), '^[a-z]+') IN ({_NOT_PREFIX}) AND NOT regexp_matches(lower(c), '{T.NOT_MODELS}') AND length(c) >= 4"
    first = rf"list_filter(list_transform(regexp_extract_all({x}, '\b([A-Z]{{1,6}}[-_]?\d{{2,6}}[A-Z0-9\-_.]*)\b', 1), lambda c: trim(c, ' ;,，。')), lambda c: {fits})[1]"
    return f"CASE WHEN regexp_matches({x}, '{_LABEL}') THEN trim(regexp_extract({x}, '{_LABEL}', 1), ' ;,，。') ELSE {first} END"


def _maker_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{_MAKER}') THEN trim(regexp_extract({x}, '{_MAKER}', 1), ' ;,，。') END"


_EVIDENCE = f"{_SHEETS_SQL}, evidence_ AS (SELECT document_id, string_agg(content, chr(10) ORDER BY chunk_index) AS evidence FROM sheets_ WHERE chunk_index < 5 GROUP BY document_id)"
SAMPLES = ["100 m", "±2 cm", "-40~+85 ℃", "5 - 9 V DC", "  12", "3.3V", "IP67", "≤ 0.5 %", "", "about 7 m", "7 m²", "1000", "10~20", "+5", "1.2.3 x", "９ m"]
LABELS = [a for labels in V.FIELDS.values() for a in labels] + ["Operating temperature range", "接口类型", "Comment", "  SAMPLING   rate ", "", "Weighting"]


def value_unit(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in SAMPLES], "sample string")
    return rows.select("sample", V.value_of(F.col("sample")).alias("value"), V.unit_of(F.col("sample")).alias("unit"))


def name_normalise(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in LABELS], "label string").select("label", V.field_of(F.col("label")).alias("field"))


SUFFIXES = [".PDF", ".docx", ".txt", ".md", ".py", ".csv", ".sqlite3", ".mp3", ".MKV", ".pcapng", ".tar.gz", "", ".ts", ".matlab", "/.chroma/x.json", "/data/chroma/y.json", ".yaml"]
_SUFFIX_LIST = ", ".join(f"'{x}'" for x in SUFFIXES)


def page_files(spark, sf_dir) -> DataFrame:
    """Pages as files whose suffix depends on the id, with a size."""
    pages = D.table(spark, sf_dir, "pages")
    suffix = F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), (F.col("page_id") % len(SUFFIXES)).cast("int") + 1)
    path = F.concat(F.lit("/site/"), F.regexp_extract("url", r"^https?://([^/]+)", 1), F.lit("/p"), F.col("page_id").cast("string"), suffix)
    return pages.select("page_id", path.alias("path"), (F.length("html") * 400).cast("long").alias("size"))


_FILES = f"files_ AS (SELECT page_id, '/site/' || regexp_extract(url, '^https?://([^/]+)', 1) || '/p' || page_id || ([{_SUFFIX_LIST}])[page_id % {len(SUFFIXES)} + 1] AS path, length(html) * 400 AS size FROM pages), named_ AS (SELECT *, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)) AS suffix FROM files_)"


def _in(*suffixes: list[str]) -> str:
    return "suffix IN (" + ", ".join(f"'{x}'" for s in suffixes for x in s) + ")"


_TYPE = f"CASE WHEN {_in(P.PDF)} THEN 'pdf' WHEN {_in(P.WORD)} THEN 'docx' WHEN {_in(P.TEXT)} THEN 'text' WHEN {_in(P.CODE)} THEN 'code' ELSE 'unsupported' END"


def file_type(spark, sf_dir):
    return page_files(spark, sf_dir).select("page_id", "path", P.file_type(F.col("path")).alias("file_type"))


def exclusion_reason(spark, sf_dir):
    return page_files(spark, sf_dir).select("page_id", P.exclusion_reason(F.col("path"), F.col("size"), F.lit(None).cast("binary")).alias("reason"))


def path_under_root(spark, sf_dir):
    return page_files(spark, sf_dir).select("page_id", P.under_root(F.col("path"), "/site/").alias("below_site"), P.under_root(F.col("path"), "/sit").alias("below_sit"))


def table_markdown(spark, sf_dir):
    """Conversations as tables of role and text."""
    rows = D.table(spark, sf_dir, "conversations").select("conv_id", F.array(F.array(F.col("role"), F.col("text"), F.lit(None).cast("string")), F.array(F.lit(" "), F.lit(None).cast("string")), F.array(F.col("turn").cast("string"))).alias("t"), "turn")
    return rows.select("conv_id", "turn", T.table_to_markdown(F.col("t")).alias("made"))


def py_symbols(spark, sf_dir):
    """Top-level units of a Python source made of each part."""
    src = D.table(spark, sf_dir, "part").selectExpr("p_partkey", "'import os' || chr(10) || 'def part_' || CAST(p_partkey AS STRING) || '(x):' || chr(10) || '    return x' || chr(10) || chr(10) || 'class Made:' || chr(10) || '    size = ' || CAST(p_size AS STRING) AS source")

    def run(batches):
        for batch in batches:
            out = [(k.as_py(), u["symbol"], u["start_line"], u["end_line"], u["content"]) for k, s in zip(batch.column(0), batch.column(1), strict=True) for u in parsers.python_units(s.as_py())]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["p_partkey", "symbol", "start_line", "end_line", "content"])

    return src.mapInArrow(run, "p_partkey bigint, symbol string, start_line int, end_line int, content string")


QUERIES = {f.__name__: f for f in (kv_params, table_params, param_dedupe, compare_missing, compare_pivot, compare_csv, compare_md, model_hint, manufacturer_hint, first5_evidence, refresh_hints, value_unit, name_normalise, file_type, exclusion_reason, path_under_root, table_markdown, py_symbols)}
_PARAM = "SELECT document_id, chunk_index, line, name, normalized_name, value, unit, source_text, page_number, confidence FROM found_ WHERE kind = "
_ROWS = ", ".join(f"max(CASE WHEN model = '{m}' THEN {{cell}} END) AS \"{m}\"" for m in MODELS)
_CSV = "CASE WHEN regexp_matches({x}, '[\",\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"
_MODEL_LIST = [f'"{m}"' for m in MODELS]


def _values(rows: list[str]) -> str:
    return ", ".join("('" + x.replace("'", "''") + "')" for x in rows)


ORACLE_SQL = {
    "kv_params": f"WITH {_FOUND} {_PARAM} 1",
    "table_params": f"WITH {_FOUND} {_PARAM} 0",
    "param_dedupe": f"WITH {_DEDUPED} SELECT document_id, normalized_name, value, unit, page_number, chunk_index, kind, line FROM deduped_",
    "compare_missing": f"WITH {_CELLS} SELECT * FROM cells_",
    "compare_pivot": f"WITH {_CELLS} SELECT normalized_name, {_ROWS.format(cell='value')} FROM cells_ GROUP BY normalized_name",
    "compare_csv": f"WITH {_CELLS}, p_ AS (SELECT normalized_name, {_ROWS.format(cell=f'''value || ' | {parameters.SOURCE}' || source''')} FROM cells_ GROUP BY normalized_name) SELECT 1 AS line_no, '{','.join([parameters.HEADING, *MODELS])}' AS line UNION ALL SELECT (row_number() OVER (ORDER BY normalized_name) + 1)::INT, " + " || ',' || ".join(_CSV.format(x=x) for x in ["normalized_name", *_MODEL_LIST]) + " FROM p_",
    "compare_md": f"WITH {_CELLS}, p_ AS (SELECT normalized_name, {_ROWS.format(cell='''value || '<br><small>' || source || '</small>' ''')} FROM cells_ GROUP BY normalized_name) SELECT 1 AS line_no, '| {' | '.join([parameters.HEADING, *MODELS])} |' AS line UNION ALL SELECT 2, '| --- | --- | --- | --- |' UNION ALL SELECT (row_number() OVER (ORDER BY normalized_name) + 2)::INT, '| ' || " + " || ' | ' || ".join(["normalized_name", *_MODEL_LIST]) + " || ' |' FROM p_",
    "model_hint": f"WITH {_SHEETS_SQL} SELECT document_id, chunk_index, {_model_sql('content')} AS sensor_model FROM sheets_",
    "manufacturer_hint": f"WITH {_SHEETS_SQL} SELECT document_id, chunk_index, {_maker_sql('content')} AS manufacturer FROM sheets_",
    "first5_evidence": f"WITH {_EVIDENCE} SELECT document_id, md5(evidence) AS evidence_md5, {_model_sql('evidence')} AS sensor_model, {_maker_sql('evidence')} AS manufacturer FROM evidence_",
    "refresh_hints": f"WITH {_EVIDENCE}, h_ AS (SELECT document_id, {_model_sql('evidence')} AS m, {_maker_sql('evidence')} AS k FROM evidence_) SELECT document_id, CASE WHEN document_id LIKE 'tb%' THEN 'ISO9001' ELSE m END AS sensor_model, coalesce(k, '') AS manufacturer, (document_id NOT LIKE 'tb%' AND m IS NOT NULL) OR coalesce(k, '') <> '' AS changed FROM h_",
    "value_unit": f"SELECT sample, {_value('sample')} AS value, {_unit('sample')} AS unit FROM (VALUES {_values(SAMPLES)}) s(sample)",
    "name_normalise": f"SELECT label, {_field('label')} AS field FROM (VALUES {_values(LABELS)}) l(label)",
    "file_type": f"WITH {_FILES} SELECT page_id, path, {_TYPE} AS file_type FROM named_",
    "exclusion_reason": f"WITH {_FILES} SELECT page_id, CASE WHEN {_in(P.CAPTURE)} THEN '{P.REASONS['capture']}' WHEN {_in(P.AUDIO, P.VIDEO)} THEN '{P.REASONS['media']}' WHEN {_in(P.DATABASE)} OR regexp_matches(lower(path), '{P.DATABASE_FOLDERS}') THEN '{P.REASONS['database']}' WHEN {_in(P.CSV)} THEN '{P.REASONS['csv']}' WHEN {_TYPE} = 'unsupported' THEN '{P.REASONS['type']}' WHEN suffix = '.txt' AND size > {P.MAX_TXT_BYTES} THEN '{P.REASONS['size']}' END AS reason FROM named_",
    "path_under_root": f"WITH {_FILES} SELECT page_id, starts_with(path, '/site/') AS below_site, starts_with(path, '/sit/') AS below_sit FROM named_",
    "table_markdown": f"SELECT conv_id, turn, '| ' || role || ' | ' || {_strip('''replace(text, chr(10), ' ')''')} || ' |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || turn || ' |  |  |' AS made FROM conversations",
    "py_symbols": "SELECT p_partkey, 'part_' || p_partkey AS symbol, 2 AS start_line, 3 AS end_line, 'def part_' || p_partkey || '(x):' || chr(10) || '    return x' AS content FROM part UNION ALL SELECT p_partkey, 'Made', 5, 6, 'class Made:' || chr(10) || '    size = ' || p_size FROM part",
}
