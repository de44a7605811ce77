"""Retrieval queries: vectors, chunks, keywords, hybrid search and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspar.functions import text as T
from quillspar.functions.embedding import embed
from quillspar.operators import answers, chunking, search

from . import tables as D

SCORE = "round(least(1, greatest(0, (1 + list_cosine_similarity(v.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))) / 2)), 6)"
RANKED = "row_number() OVER (ORDER BY score DESC, {key})::INT AS rank"


def vec_topk(spark, sf_dir):
    rows = search.semantic(D.vectors(spark, sf_dir), D.query_vector(spark, sf_dir), key="vec_id")
    return rows.select("vec_id", "score", T.percent(F.col("score")).alias("percent"), "rank")


def vec_topk_filtered(spark, sf_dir):
    rows = search.metadata_filter(D.vectors(spark, sf_dir), {"label": 3, "unknown": 1, "file_type": ""}, ("label",))
    return search.semantic(rows, D.query_vector(spark, sf_dir), key="vec_id").select("vec_id", "score", "rank")


def vec_visible_only(spark, sf_dir):
    rows = search.visible(D.vectors(spark, sf_dir), D.documents(spark, sf_dir))
    return search.semantic(rows, D.query_vector(spark, sf_dir)).select("chunk_id", "score", "rank")


def vec_normalized(spark, sf_dir):
    v = D.vectors(spark, sf_dir).select("vec_id", search.normalize(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(search.dot(F.col("v"), F.col("v")), 4).alias("squared"), F.round(F.get("v", F.lit(0)).cast("double"), 4).alias("first"))


def _vec_sql(where: str, key: str, extra: str = "") -> str:
    return f"""WITH {D.DOCUMENTS}, {D.VECTORS}, s AS (SELECT v.{key}, {SCORE} AS score FROM vectors_ v {where})
    SELECT {key}, score, {extra}{RANKED.format(key=key)} FROM s ORDER BY score DESC, {key} LIMIT 8"""


def tokenize_counts(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(T.chunk_tokens(F.col("text"))).alias("n_tokens"), F.size(T.search_tokens(F.col("text"))).alias("n_terms"))


def chunk_windows(spark, sf_dir):
    return D.chunks(spark, sf_dir, with_content=False).select("document_id", "chunk_index", "token_offset", "n_tokens")


def chunk_text(spark, sf_dir):
    return D.chunks(spark, sf_dir).select("chunk_id", "content", "source")


def preserve_or_split(spark, sf_dir):
    pages = D.table(spark, sf_dir, "pages").select("page_id", F.array(chunking.segment(F.col("html"), "code"), chunking.segment(F.col("url"))).alias("segments"))
    return chunking.chunk(pages).select("page_id", "chunk_index", "content_type", "token_offset", "n_tokens", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def bm25_stats(spark, sf_dir):
    tokens = D.chunks(spark, sf_dir).select(T.search_tokens(F.col("content")).alias("tokens"))
    return search.corpus_facts(tokens, []).select("n", F.round("avgdl", 6).alias("avgdl"), "terms", F.round("mean", 6).alias("mean_weight"))


def bm25_topk(spark, sf_dir):
    return search.keyword_scores(D.chunks(spark, sf_dir), D.query_text(spark, sf_dir))


def bm25_filtered(spark, sf_dir):
    corpus = search.metadata_filter(D.chunks(spark, sf_dir), {"file_type": "en", "manufacturer": "src3"})
    return search.keyword_scores(corpus, D.query_text(spark, sf_dir))


def _bm25_sql(where: str) -> str:
    """CTEs up to kw_ (chunk_id, score)."""
    return f"""tok_ AS (SELECT chunk_id, regexp_extract_all(lower(content), '{D.SEARCH_TOKEN}') AS ts FROM chunks_ {where}),
    st_ AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok_),
    df_ AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(ts)) AS term FROM tok_) GROUP BY term),
    raw_ AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df_, st_),
    idf_ AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw_) ELSE raw END AS idf FROM raw_),
    q_ AS (SELECT term, count(*) AS qc FROM (SELECT unnest(regexp_extract_all(lower({D.QUERY_TEXT}), '{D.SEARCH_TOKEN}')) AS term) GROUP BY term),
    tf_ AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM tok_) GROUP BY ALL),
    sc_ AS (SELECT chunk_id, round(sum(qc * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS s FROM tf_ JOIN q_ USING (term) JOIN idf_ USING (term), st_ GROUP BY chunk_id),
    kw_ AS (SELECT chunk_id, round(s / (SELECT max(s) FROM sc_), 6) AS score FROM sc_ WHERE (SELECT max(s) FROM sc_) > 0 AND round(s / (SELECT max(s) FROM sc_), 6) > 0)"""


def _top_sql(source: str, k: int = 8) -> str:
    return f"SELECT chunk_id, score, {RANKED.format(key='chunk_id')} FROM {source} ORDER BY score DESC, chunk_id LIMIT {k}"


def hybrid_topk(spark, sf_dir):
    """The flagship: the eight best chunks of vector and keyword search over published documents."""
    docs, found = D.documents(spark, sf_dir), D.chunks(spark, sf_dir).where("status = 'imported'")
    return search.hybrid(search.visible(D.vectors(spark, sf_dir), docs), D.query_vector(spark, sf_dir), found, D.query_text(spark, sf_dir))


VISIBLE = "WHERE v.document_id IN (SELECT document_id FROM documents_ WHERE status = 'imported')"
_HYBRID = f"""{D.CHUNKS}, {D.VECTORS}, {_bm25_sql("WHERE status = 'imported'")},
sem_ AS (SELECT chunk_id, {SCORE} AS score FROM vectors_ v {VISIBLE} ORDER BY score DESC, chunk_id LIMIT 24),
key_ AS (SELECT chunk_id, score FROM kw_ ORDER BY score DESC, chunk_id LIMIT 24),
fused_ AS (SELECT chunk_id, round(sum(s), 6) AS score FROM (SELECT chunk_id, score * 0.65 AS s FROM sem_ UNION ALL SELECT chunk_id, score * 0.35 FROM key_) GROUP BY chunk_id),
top_ AS ({_top_sql("fused_")})"""


def _results(spark, sf_dir):
    """The hits with their chunks. Only their documents are cut into chunks again."""
    rows = hybrid_topk(spark, sf_dir).withColumn("hit_document", F.substring_index("chunk_id", "#", 1).cast("bigint"))
    return D.chunks(spark, sf_dir, ids=rows.select("hit_document")).join(F.broadcast(rows.drop("hit_document")), "chunk_id")  # at most eight rows


def context_block(spark, sf_dir):
    return answers.context(_results(spark, sf_dir))


def null_answer(spark, sf_dir):
    question = D.query_text(spark, sf_dir)
    rows = answers.context(_results(spark, sf_dir))
    return rows.select(answers.fallback_answer(answers.user_message(F.lit(question), F.col("context"))).alias("answer"))


def history_json(spark, sf_dir):
    return answers.sources_json(_results(spark, sf_dir))


_CONTEXT = f"""WITH {_HYBRID}, c_ AS (SELECT string_agg('[S' || rank || '] ' || source || chr(10) || 'chunk_id=' || chunk_id || chr(10) || substr(content, 1, 1800), chr(10) || chr(10) ORDER BY rank) AS context
FROM top_ JOIN chunks_ USING (chunk_id))"""
_HEAD = (answers.WITHOUT_MODEL[0] + "crs" + answers.WITHOUT_MODEL[1]).replace("\n", "' || chr(10) || '")


def highlight(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.highlight(T.preview(F.col("text")), "the un a ention").cast("binary")).alias("shown_md5"))


def preview(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text"), 80).alias("shown"))


def blake_embed(spark, sf_dir):
    """Hashed vectors of all documents. SQL has no such hash: tested against its definition."""
    rows = D.table(spark, sf_dir, "documents").select("doc_id", embed(F.col("text"), 64).alias("v"))
    return rows.select("doc_id", F.size("v").alias("dimension"), F.round(search.dot(F.col("v"), F.col("v")), 4).alias("squared"))


QUERIES = {f.__name__: f for f in (vec_topk, vec_topk_filtered, vec_visible_only, vec_normalized, tokenize_counts, chunk_windows, chunk_text, preserve_or_split, bm25_stats, bm25_topk, bm25_filtered, hybrid_topk, context_block, null_answer, history_json, highlight, preview, blake_embed)}
_PIECES = f"""WITH s AS (SELECT page_id, 0 AS k, 'code' AS content_type, html AS content FROM pages UNION ALL SELECT page_id, 1, 'text', url FROM pages),
t AS (SELECT page_id, k, content_type, content, regexp_extract_all(content, '{D.CHUNK_TOKEN}') AS ts FROM s),
w AS (SELECT *, unnest(range(0, CASE WHEN content_type = 'code' AND len(ts) <= 1024 THEN 1 WHEN len(ts) = 0 THEN 0 WHEN len(ts) <= 512 THEN 1 ELSE ceil((len(ts) - 512) / 384.0)::INT + 1 END)) AS i FROM t),
c AS (SELECT page_id, k, i, content_type, content_type = 'code' AND len(ts) <= 1024 AS whole, content, CASE WHEN content_type = 'code' AND len(ts) <= 1024 THEN ts ELSE ts[i * 384 + 1 : i * 384 + 512] END AS ts FROM w)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k, i) - 1)::INT AS chunk_index, content_type, (i * 384)::INT AS token_offset, len(ts)::INT AS n_tokens, md5(CASE WHEN whole THEN content ELSE {D.joined("ts")} END) AS content_md5 FROM c"""
ORACLE_SQL = {
    "vec_topk": _vec_sql("", "vec_id", "floor(100 * score)::INT AS percent, "),
    "vec_topk_filtered": _vec_sql("WHERE label = 3", "vec_id"),
    "vec_visible_only": _vec_sql(VISIBLE, "chunk_id"),
    "vec_normalized": "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: (x / n) * (x / n))), 4) AS squared, round(embedding[1]::DOUBLE / n, 4) AS first FROM (SELECT *, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)",
    "tokenize_counts": f"SELECT doc_id, len(regexp_extract_all(text, '{D.CHUNK_TOKEN}'))::INT AS n_tokens, len(regexp_extract_all(lower(text), '{D.SEARCH_TOKEN}'))::INT AS n_terms FROM documents",
    "chunk_windows": f"WITH {D.CHUNKS} SELECT document_id, chunk_index, token_offset, n_tokens FROM chunks_",
    "chunk_text": f"WITH {D.CHUNKS} SELECT chunk_id, content, source FROM chunks_",
    "preserve_or_split": _PIECES,
    "bm25_stats": f"WITH {D.CHUNKS}, {_bm25_sql('')} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM raw_) AS terms, (SELECT round(avg(raw), 6) FROM raw_) AS mean_weight FROM st_",
    "bm25_topk": f"WITH {D.CHUNKS}, {_bm25_sql('')} {_top_sql('kw_')}",
    "bm25_filtered": f"""WITH {D.CHUNKS}, {_bm25_sql("WHERE file_type = 'en' AND manufacturer = 'src3'")} {_top_sql('kw_')}""",
    "hybrid_topk": f"WITH {_HYBRID} SELECT * FROM top_",
    "context_block": f"{_CONTEXT} SELECT context FROM c_",
    "null_answer": f"{_CONTEXT} SELECT '{_HEAD}' || substr('{answers.QUESTION}' || {D.QUERY_TEXT} || chr(10) || chr(10) || '{answers.PASSAGES}' || chr(10) || context, 1, 1200) AS answer FROM c_",
    "history_json": f"""WITH {_HYBRID} SELECT '[' || string_agg('{{"chunk_id":"' || chunk_id || '","document_id":' || document_id || ',"source":"' || source || '","page_number":null,"score":' || score || '}}', ',' ORDER BY rank) || ']' AS sources_json FROM top_ JOIN chunks_ USING (chunk_id)""",
    "highlight": """SELECT doc_id, md5(regexp_replace(CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || '...' ELSE text END, '(?i)(the|un|ention)', '<span class="highlight">\\1</span>', 'g')) AS shown_md5 FROM documents""",
    "preview": "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS shown FROM documents",
}
