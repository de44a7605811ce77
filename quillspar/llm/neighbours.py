"""Approximate nearest neighbours: inverted lists scanned with adaptively many dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, only

#: Vectors that centroids and the rotation's dimension are taken from, at most (those of smallest id hash). Every vector is indexed.
SAMPLE = 20_000
#: Share of the nearest neighbours within the sample that the lists a query looks into must hold, going by ASKED vectors of it.
RECALL, ASKED = 0.97, 500
#: Vectors of a list, and queries, that one task scans at a time.
SHARD, QUERIES = 8192, 4096
_EPSILON = 2.1
_BLOCK = 16
_DENSE = 0.2


def usable(values: np.ndarray) -> np.ndarray:
    return np.isfinite(values).all(axis=1) & (np.abs(values).max(axis=1, initial=0.0) > 0)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two equally long arrays of original vectors, in double precision. Rows are brought near one by powers of two first, which changes no digit."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))[1]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for a dimension."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means; empty ones restart at a vector that lies far from its own."""
    rng = np.random.default_rng(5)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(turns):
        score = x @ centres.T
        best = score.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, x)
        length = np.sqrt((sums * sums).sum(axis=1))
        lone = length < 1e-9
        if lone.any():
            sums[lone] = x[np.argsort(score.max(axis=1))[: lone.sum()]]
            length[lone] = 1.0
        centres = sums / length[:, None]
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, recall: float = RECALL) -> int:
    """How many of its nearest lists a query must look into to find that share of its k nearest vectors, measured on unit vectors: some of them asked against all."""
    asked = x[:: max(1, len(x) // ASKED)]
    home = (x @ centres.T).argmax(axis=1)
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = []
    for at in range(0, len(asked), 64):
        near = np.argpartition(-(asked[at : at + 64] @ x.T), min(k + 1, len(x)) - 1, axis=1)[:, : k + 1]  # one of them is the vector itself
        needed.append(np.take_along_axis(turn[at : at + 64], home[near], axis=1).ravel())
    return int(np.quantile(np.concatenate(needed), recall, method="higher")) + 1


def scan(queries: np.ndarray, qid: np.ndarray, base: np.ndarray, bid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, base row) of each query's k nearest among unit, rotated vectors, equal ids apart; ties go to smaller ids.

    Squared distances grow by blocks of columns. After d of D rotated columns, the partial distance times D/d estimates the whole; a candidate
    whose estimate exceeds the query's bound by (1 + epsilon/sqrt(d))**2 is abandoned: with a random rotation that rejects a
    nearer one with a small, fixed probability. The bound is the k-th distance among the first candidates, computed in full. As long as over
    a fifth of the candidates are left, a block is taken for all of them by a matrix product, which costs less than picking them out.
    """
    dim = base.shape[1]
    order = np.argsort(bid, kind="stable")
    base, bid = base[order], bid[order]
    rows_q, rows_b = [], []
    for at in range(0, len(queries), 64):
        q, ids = queries[at : at + 64], qid[at : at + 64]
        first = min(len(base), max(512, 8 * k))
        exact = 2 - 2 * q @ base[:first].T
        exact[ids[:, None] == bid[None, :first]] = np.inf
        bound = np.partition(exact, min(k, first) - 1, axis=1)[:, min(k, first) - 1]
        alive_q = alive_b = have = None
        part = np.zeros((len(q), len(base)))
        for done in range(0, dim, _BLOCK):
            end = min(dim, done + _BLOCK)
            slack = bound * ((1 + _EPSILON / math.sqrt(end)) ** 2 if end < dim else 1 + 1e-9) * (end / dim) + 1e-12
            if alive_q is None:
                x, y = q[:, done:end], base[:, done:end]
                part += (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
                keep = part <= slack[:, None]
                if end == dim or keep.mean() < _DENSE:
                    alive_q, alive_b = np.nonzero(keep)
                    have = part[alive_q, alive_b]
            else:
                gap = q[alive_q, done:end] - base[alive_b, done:end]
                have = have + (gap * gap).sum(axis=1)
                keep = have <= slack[alive_q]
                alive_q, alive_b, have = alive_q[keep], alive_b[keep], have[keep]
        other = ids[alive_q] != bid[alive_b]
        alive_q, alive_b, have = alive_q[other], alive_b[other], have[other]
        rank = np.lexsort((alive_b, np.round(have, 12), alive_q))
        alive_q, alive_b = alive_q[rank], alive_b[rank]
        place = np.arange(len(alive_q)) - np.searchsorted(alive_q, alive_q)
        top = place < k
        rows_q.append(alive_q[top] + at)
        rows_b.append(order[alive_b[top]])
    return np.concatenate(rows_q) if rows_q else np.zeros(0, int), np.concatenate(rows_b) if rows_b else np.zeros(0, int)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of ``queries`` the k rows of ``df`` of largest cosine that are found, itself apart.

    Vectors that are null or zero, hold a null or a value that is not finite, or differ from the table's most common length take no part,
    nor do null ids. With fewer candidates than k all are given. Ties go to the smaller id. Repeated ids count as rows of their own, never as
    neighbours of one another; a query that occurs twice is answered twice. An empty table gives no rows; other columns are not read.

    Lists come from k-means over a bounded sample (SAMPLE); every vector is indexed, in list shards of about SHARD vectors, so a
    vector that a third of the rows share fills many shards and no task. A query goes to the shards of its nearest lists, of which as many are looked into as
    find a share ``recall`` of the neighbours within the sample (see probes_for); queries of a list are dealt over shards of about QUERIES too, each of which meets every shard of vectors.
    Small tables are one list, searched wholly.
    """
    clean = lambda d: only(d, id=id_col, v=vector_col).where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    base = clean(df)
    sizes = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    spark = df.sparkSession
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, total = sizes[0]["dim"], sizes[0]["count"]
    base = base.where(F.size("v") == dim)
    sample = base.select("v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE).toPandas()["v"]
    turn = rotation(dim)
    sample = _unit(np.array(sample.tolist(), dtype=np.float64)) @ turn
    centres = kmeans(sample, max(1, round(math.sqrt(min(total, 1 << 24)) / 2)))
    probes = min(len(centres), probes_for(sample, centres, k, recall))
    model = spark.sparkContext.broadcast((turn, centres))  # at most 2048 centroids

    def lists(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _unit(_matrix(batch.column("v"), dim)) @ model.value[0] if batch.num_rows else np.zeros((0, dim))
                near = np.argsort(-(x @ model.value[1].T), axis=1, kind="stable")[:, :count]
                rows = np.repeat(np.arange(batch.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), *(batch.column(c).take(pa.array(rows)) for c in ("id", "v", "row"))], ["list", "id", "v", "row"])

        return run

    kept = "list int, id bigint, v array<double>, row bigint"
    doubles = F.col("v").cast("array<double>")
    listed = cut(base.withColumn("v", doubles).withColumn("row", F.lit(0).cast("bigint")).mapInArrow(lists(1), kept)).drop("row")
    shards = {r["list"]: math.ceil(r["count"] / SHARD) for r in listed.groupBy("list").count().collect()}  # at most a row per centroid
    of = F.element_at(F.create_map(*[F.lit(x) for pair in shards.items() for x in pair]), F.col("list"))
    held = listed.withColumn("shard", F.pmod(F.xxhash64("id", "v"), of).cast("int"))
    asked = clean(queries).where(F.size("v") == dim).withColumn("v", doubles).withColumn("row", F.monotonically_increasing_id())
    asked = cut(asked.mapInArrow(lists(probes), kept)).where(F.col("list").isin(*shards))  # cut, as numbers of rows must stay the same
    turns = {r["list"]: math.ceil(r["count"] / QUERIES) for r in asked.groupBy("list").count().collect()}  # at most a row per centroid
    if not turns:
        return spark.createDataFrame([], schema)
    turns_of = F.element_at(F.create_map(*[F.lit(x) for pair in turns.items() for x in pair]), F.col("list"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), of - 1))).withColumn("turn", F.pmod(F.xxhash64("row"), turns_of).cast("int"))
    held = held.withColumn("turn", F.explode(F.sequence(F.lit(0), F.coalesce(turns_of, F.lit(0)) - 1))).where("turn >= 0")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"row": [], "query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            q, b = _matrix(left.column("v"), dim), _matrix(right.column("v"), dim)
            qid, bid = left.column("id").to_numpy(), right.column("id").to_numpy()
            i, j = scan(_unit(q) @ model.value[0], qid, _unit(b) @ model.value[0], bid, k)
            out = {"row": left.column("row").to_numpy()[i], "query_id": qid[i], "vec_id": bid[j], "score": cosines(q[i], b[j])}
        return pa.table({n: pa.array(c, pa.float64() if n == "score" else pa.int64()) for n, c in out.items()})

    group = ("list", "shard", "turn")
    found = asked.groupBy(*group).cogroup(held.groupBy(*group)).applyInArrow(search, "row bigint, query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)
