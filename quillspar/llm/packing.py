"""Packing token sequences into windows of bounded length by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import give_free, only
from .tokens import END, VOCABULARY, crc32, encoder, pieces

WINDOW = 1024
#: Remainders are cut at multiples of this, so that a window takes several pieces and the differencing can even them out.
PIECE = 256
#: Documents whose remainders are packed together, and ids that they have together, one document more or less.
GROUP, GROUP_IDS = 512, 1 << 22


def differencing(weights: np.ndarray, k: int) -> np.ndarray:
    """The bin (0..k-1) of each weight, sums being near equal.

    Each weight starts as a partition of k bins. The two partitions of the largest imbalance (largest less smallest sum) are
    merged, the fullest bins of one with the emptiest of the other, and what all bins have in common is taken off.
    """
    n = len(weights)
    heap = []
    for i, w in enumerate(weights.tolist()):
        sums, nodes = np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64)
        sums[-1], nodes[-1] = w, i
        heap.append((-w, i, sums, nodes))
    heapq.heapify(heap)
    left: list[int] = []
    right: list[int] = []
    serial = n
    while len(heap) > 1:
        _, _, s1, n1 = heapq.heappop(heap)
        _, _, s2, n2 = heapq.heappop(heap)
        sums, a, b = s1 + s2[::-1], n1, n2[::-1]
        nodes = np.where(a >= 0, a, b)
        both = np.flatnonzero((a >= 0) & (b >= 0))
        nodes[both] = np.arange(n + len(left), n + len(left) + len(both))
        left += a[both].tolist()
        right += b[both].tolist()
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        sums -= sums[0]
        heapq.heappush(heap, (-int(sums[-1]), serial, sums, nodes))
        serial += 1
    out = np.zeros(n, dtype=np.int64)
    todo = [(int(x), j) for j, x in enumerate(heap[0][3]) if x >= 0] if heap else []
    while todo:
        x, j = todo.pop()
        if x < n:
            out[x] = j
        else:
            todo += [(left[x - n], j), (right[x - n], j)]
    return out


def pack_group(lengths: np.ndarray, window: int = WINDOW, piece: int = PIECE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (row, start, length, sequence, offset) of the rows of a group; sequences are numbered from 0.

    Whole windows are cut off a row first. What remains of the rows is cut at multiples of ``piece`` and partitioned into
    as many windows as its sum needs at least; the number rises by one as long as a window would exceed its capacity.
    """
    out, rest, at = [], [], 0
    for row, n in enumerate(lengths.tolist()):
        start = 0
        while n - start >= window:
            out.append((row, start, window, at, 0))
            at += 1
            start += window
        while start < n:
            rest.append((row, start, min(piece, n - start)))
            start += rest[-1][2]
    if rest:
        weights = np.array([r[2] for r in rest], dtype=np.int64)
        k = -(-int(weights.sum()) // window)
        while True:
            bins = differencing(weights, k)
            if np.bincount(bins, weights=weights, minlength=k).max() <= window:
                break
            k += 1
        filled = [0] * k
        for (row, start, n), j in zip(rest, bins.tolist(), strict=True):
            out.append((row, start, n, at + j, filled[j]))
            filled[j] += n
    return out


_PIECES = "id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: str = VOCABULARY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Encode every row's text (null: empty) with an end id and lay the ids into sequences of at most ``window``.

    One row per piece: (id, start in its document, length, ids_crc32, doc_tokens, sequence_id, offset in the sequence), and the piece's
    ids if ``with_ids``. Rows are encoded and packed where they are read, GROUP at a time (fewer if long), without a shuffle: memory is bounded by a group
    (what is free after it goes back to the machine), and a task that runs again packs the same rows anew. Every id lies in one piece; offsets have no gaps.
    Null or repeated row ids do no harm, an empty table gives no pieces, and only the two named columns are read.
    """
    docs = only(df, id=id_col, text=text_col)
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end)
        sequence = TaskContext.get().partitionId() << 40
        ids: list = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            found = pack_group(np.array([len(p) for p in parts], dtype=np.int64), window)
            rows, starts, lengths, sequences, offsets = (np.array(c, dtype=np.int64) for c in zip(*found, strict=True))
            tokens = [parts[r][s : s + n] for r, s, n in zip(rows.tolist(), starts.tolist(), lengths.tolist(), strict=True)]
            totals = np.array([len(p) for p in parts], dtype=np.int64)
            columns = [pa.array(ids, kinds).take(pa.array(rows)), pa.array(starts), pa.array(lengths), pa.array([crc32(t) for t in tokens], pa.int64()), pa.array(totals[rows]), pa.array(sequence + sequences), pa.array(offsets)]
            sequence += int(sequences.max()) + 1
            if with_ids:
                columns.append(pa.array([t.tolist() for t in tokens], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

        kinds = None
        for batch in batches:
            kinds = batch.column("id").type
            keys = batch.column("id").to_pylist()
            for first, texts in pieces(batch.column("text")):
                lengths, tokens = enc.encode(texts)
                for k, part in enumerate(np.split(tokens, np.cumsum(lengths)[:-1])):
                    ids.append(keys[first + k])
                    parts.append(part)
                    held += len(part)
                    if len(parts) == GROUP or held >= GROUP_IDS:
                        yield flush()
                        ids.clear()
                        parts.clear()
                        held = 0
                        give_free()
        if parts:
            yield flush()

    return docs.mapInArrow(run, _PIECES.format(kind) + ", ids array<int>" * with_ids)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
