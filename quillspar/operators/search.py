"""Vector, keyword and hybrid retrieval over chunk tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspar.functions import text as T

TOP_K = 8
SEMANTIC_WEIGHT, KEYWORD_WEIGHT = 0.65, 0.35
K1, B, EPSILON = 1.5, 0.75, 0.25
FILTERS = ("file_type", "manufacturer", "sensor_model")


def metadata_filter(df: DataFrame, filters: dict | None, allowed: tuple[str, ...] = FILTERS) -> DataFrame:
    """Equality on the allowed keys, all of which must hold; empty values and other keys are left out."""
    wanted = [F.col(k) == v for k, v in (filters or {}).items() if k in allowed and v]
    return df.where(reduce(lambda a, b: a & b, wanted)) if wanted else df


def visible(df: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of published documents. It comes before any top k, so k results are found whenever there are k."""
    return df.join(documents.where("status = 'imported'").select("document_id"), "document_id", "left_semi")


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, 0 for a zero vector; null where lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0)))


def similarity_score(cos: Column) -> Column:
    """(1 + cosine) / 2, kept within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cos + 1) / 2))


def normalize(v: Column) -> Column:
    """A vector of length one; a zero vector stays, NaN becomes 0."""
    clean = F.transform(_doubles(v), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    norm = F.sqrt(F.aggregate(clean, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(clean, lambda x: (x / F.when(norm > 0, norm).otherwise(F.lit(1.0))).cast("float"))


def lookup(vectors: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The vectors of the given keys; keys without one give no row."""
    return vectors.join(ids.select(key).distinct(), key, "left_semi")


def top(df: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The k best rows by score with their rank from 1; ties go to the smaller key. Partial top k in each task, then k rows in one."""
    return df.orderBy(F.desc("score"), key).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def semantic(vectors: DataFrame, query: DataFrame, k: int = TOP_K, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k vectors nearest to the one-row ``query`` (column query_vector): all columns but the vector, with score and rank. Exact.

    Ties, going by the score at six digits, go to the smaller key. The query's row is a broadcast; vectors are scanned once.
    """
    scored = vectors.join(F.broadcast(query.limit(1).select("query_vector")))
    scored = scored.withColumn("score", F.round(similarity_score(cosine(F.col(vector), F.col("query_vector"))), 6)).drop(vector, "query_vector")
    return top(scored.where("score is not null"), k, key)


def term_counts(tokenized: DataFrame) -> DataFrame:
    """(term, df): in how many rows each term is; and for each number of tokens that rows have, its digits after a line end and those rows.

    One pass: terms, which have no line ends, are made distinct in their rows and summed in part before the shuffle. Rows without terms count.
    """
    every = F.concat(F.array(F.concat(F.lit("\n"), F.size("tokens").cast("string"))), F.array_distinct("tokens"))
    return tokenized.select(F.explode_outer(every).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def raw_weight(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def corpus_facts(tokenized: DataFrame, asked: list[str]) -> DataFrame:
    """One row (n, avgdl, terms, mean, raws): rows, mean length, terms, their mean raw weight, and a map of the asked terms' raw weights.

    A term's raw weight depends on n, so terms are first counted by their df; as many rows as there are values of df in a corpus meet in one task.
    """
    return facts_of(term_counts(tokenized), asked)


def facts_of(counts: DataFrame, asked: list[str]) -> DataFrame:
    """corpus_facts from term_counts."""
    wanted, size = F.when(F.col("term").isin(*asked), F.col("term")), F.substring("term", 2, 10).try_cast("bigint")
    whole = F.col("term").startswith("\n")
    by_df = counts.groupBy(whole.alias("whole"), "df").agg(F.count("*").alias("times"), F.sum(F.when(whole, size * F.col("df"))).alias("size"), F.collect_list(wanted).alias("found"))
    one = by_df.agg(F.sum(F.when(F.col("whole"), F.col("df") * F.col("times"))).alias("n"), F.sum("size").alias("size"), F.collect_list(F.when(~F.col("whole"), F.struct("df", "times", "found"))).alias("rest"))
    n = F.col("n")
    weights = one.select(n.alias("n"), (F.col("size") / n).alias("avgdl"), F.transform("rest", lambda r: F.struct(raw_weight(n, r["df"]).alias("raw"), r["times"].alias("times"), r["found"].alias("found"))).alias("rest"))
    total = F.aggregate("rest", F.lit(0.0), lambda s, r: s + r["raw"] * r["times"])
    terms = F.aggregate("rest", F.lit(0).cast("long"), lambda s, r: s + r["times"])
    raws = F.map_from_entries(F.flatten(F.transform("rest", lambda r: F.transform(r["found"], lambda t: F.struct(t.alias("term"), r["raw"].alias("raw"))))))
    return weights.select("n", "avgdl", terms.alias("terms"), F.when(terms > 0, total / terms).alias("mean"), raws.alias("raws"))


def score_of(asked: list[str], tokens: Column, of: dict[str, tuple[Column, Column]]) -> Column:
    """The score, to six digits, of a row of so many tokens; ``of`` has how often the row has each of the query's terms, and the terms' weights."""
    length = K1 * (1 - B + B * tokens / F.col("avgdl"))
    score = F.lit(0.0)
    for term in dict.fromkeys(asked):
        tf, weight = of[term]
        score = score + F.coalesce(asked.count(term) * weight * tf * (K1 + 1) / (tf + length), F.lit(0.0))
    return F.round(score, 6)


def bm25(corpus: DataFrame, query: str, content: str = "content") -> DataFrame:
    """All rows of ``corpus`` with their BM25 score, to six digits.

    Frequencies are those of ``corpus`` as it is, so filters change them. A term in over half of the rows has a negative weight, which a
    quarter of the mean weight of all terms replaces. Query terms count as often as they occur. An empty query gives no rows.

    Two passes over the rows: one counts terms, of which the frequencies alone are shuffled; one scores rows where they are read, against the few
    weights of the query's terms.
    """
    asked = re.findall("[一-鿿]|[a-z0-9_./%+\\-]+", query.lower())
    if not asked:
        return corpus.withColumn("score", F.lit(0.0)).limit(0)
    tokenized = corpus.withColumn("tokens", T.search_tokens(F.coalesce(F.col(content), F.lit(""))))
    terms = sorted(set(asked))
    facts = corpus_facts(tokenized, terms)
    hits = F.filter("tokens", lambda t: t.isin(*terms))
    rows = tokenized.select(*corpus.columns, F.size("tokens").alias("bm25_length"), hits.alias("bm25_hits"))
    rows = rows.join(F.broadcast(facts))  # one row, whose map holds the query's terms alone
    raw = {t: F.element_at("raws", F.lit(t)) for t in terms}
    of = {t: (F.size("bm25_hits") - F.size(F.array_remove("bm25_hits", t)), F.when(raw[t] < 0, EPSILON * F.col("mean")).otherwise(raw[t])) for t in terms}
    return rows.select(*corpus.columns, score_of(asked, F.col("bm25_length"), of).alias("score"))


def keyword(corpus: DataFrame, query: str, k: int = TOP_K, key: str = "chunk_id", content: str = "content") -> DataFrame:
    """The k best rows by bm25, scores divided by the best one's; rows not over 0 are left out."""
    best = top(bm25(corpus, query, content), k, key)
    share = F.col("score") / F.max("score").over(Window.partitionBy())  # of k rows
    return best.where("score > 0").withColumn("score", F.round(share, 6)).where("score > 0")


def keyword_scores(corpus: DataFrame, query: str, k: int = TOP_K, key: str = "chunk_id", content: str = "content") -> DataFrame:
    """(key, score, rank): what ``keyword`` finds, by one pass over the rows instead of two.

    A row is counted with its terms as one more term, which holds its key, its number of tokens and how often it has each of the query's terms. So rows are
    cut into terms once, and what is shuffled and read twice is a short row for each that has one of the query's terms, beside the terms' frequencies.
    """
    asked = re.findall("[一-鿿]|[a-z0-9_./%+\\-]+", query.lower())
    if not asked:
        return corpus.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    terms, kind = sorted(set(asked)), dict(corpus.dtypes)[key]
    tokenized = corpus.select(F.col(key).cast("string").alias("key"), T.search_tokens(F.coalesce(F.col(content), F.lit(""))).alias("tokens"))
    tokenized = tokenized.select("key", "tokens", F.filter("tokens", lambda t: t.isin(*terms)).alias("hits"))
    words = F.array(*[F.lit(t) for t in terms])
    tfs = F.array_join(F.transform(words, lambda t: (F.size("hits") - F.size(F.array_remove("hits", t))).cast("string")), " ")
    own = F.when(F.size("hits") > 0, F.array(F.concat(F.lit("\r"), F.size("tokens").cast("string"), F.lit(" "), tfs, F.lit(" "), "key"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(F.concat(F.lit("\n"), F.size("tokens").cast("string"))), F.array_distinct("tokens"), own)
    # Which they are is told by a sum's result, so that both sides read the one shuffle: what the term itself tells would be asked before it.
    counts = tokenized.select(F.explode(every).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.max(F.col("term").startswith("\r")).alias("is_row"))
    facts = facts_of(counts.where("not is_row").select("term", "df"), terms)
    raw = F.transform(words, lambda t: F.element_at("raws", t))
    facts = facts.select("avgdl", F.transform(raw, lambda r: F.when(r < 0, EPSILON * F.col("mean")).otherwise(r)).alias("weights"))
    rows = counts.where("is_row").select(F.split(F.substring("term", 2, 1 << 30), " ", len(terms) + 2).alias("r"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("df"))).alias("again"))  # rows may be alike
    rows = rows.select(F.get("r", F.lit(len(terms) + 1)).cast(kind).alias(key), F.get("r", F.lit(0)).cast("int").alias("length"), F.slice("r", 2, len(terms)).cast("array<int>").alias("tfs"))
    rows = rows.join(F.broadcast(facts))  # one row
    of = {t: (F.get("tfs", F.lit(n)), F.get("weights", F.lit(n))) for n, t in enumerate(terms)}
    scored = rows.select(key, score_of(asked, F.col("length"), of).alias("score"))
    best = top(scored, k, key)
    share = F.col("score") / F.max("score").over(Window.partitionBy())  # of k rows
    return best.where("score > 0").withColumn("score", F.round(share, 6)).where("score > 0")


def fuse(semantic_rows: DataFrame, keyword_rows: DataFrame, k: int = TOP_K, key: str = "chunk_id", weights: tuple[float, float] = (SEMANTIC_WEIGHT, KEYWORD_WEIGHT)) -> DataFrame:
    """(key, score, rank): the weighted mean of both scores, a missing one counting 0. A union and a sum instead of a full outer join."""
    total = sum(weights) or 1.0
    parts = [rows.select(key, (F.col("score") * w / total).alias("score")) for rows, w in zip((semantic_rows, keyword_rows), weights, strict=True)]
    return top(parts[0].unionAll(parts[1]).groupBy(key).agg(F.round(F.sum("score"), 6).alias("score")), k, key)


def hybrid(vectors: DataFrame, query_vector: DataFrame, corpus: DataFrame, query: str, k: int = TOP_K, weights: tuple[float, float] = (SEMANTIC_WEIGHT, KEYWORD_WEIGHT)) -> DataFrame:
    """The k best chunks of both searches, each of which gives 3k."""
    return fuse(semantic(vectors, query_vector, 3 * k), keyword_scores(corpus, query, 3 * k), k, weights=weights)


def search(vectors: DataFrame, query_vector: DataFrame, corpus: DataFrame, query: str, mode: str = "hybrid", top_k: int | None = None, filters: dict | None = None) -> DataFrame:
    """(chunk_id, score, rank) for a query. Modes other than semantic and keyword are hybrid; a blank query finds nothing; no or zero top_k is 8."""
    k, mode, query = top_k or TOP_K, mode.lower(), query.strip()
    vectors, corpus = metadata_filter(vectors, filters), metadata_filter(corpus, filters)
    if not query:
        return corpus.select("chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    if mode == "semantic":
        return semantic(vectors, query_vector, k).select("chunk_id", "score", "rank")
    if mode == "keyword":
        return keyword_scores(corpus, query, k)
    return hybrid(vectors, query_vector, corpus, query, k)
