"""Removal of word sequences that an earlier document has, by suffix trees in groups of common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import hash_texts, hash_windows, id_blocks, order, owners, pack, slices, text_blocks, unpack
from .common import only, release, trimmed

WINDOW = 13
#: Suffixes of a prefix group, about as many as a task holds.
GROUP = 1 << 20
#: Blocks are half of other operators', as some twenty numbers are held for each word.
_SHARE = 2
#: Depth of the upper nodes of a group's tree, in words.
UPPER = 4


class Suffixes:
    """All suffixes of ``n`` words or more of some texts, cut at depth n: their words' hashes, digests, rows and places."""

    def __init__(self, texts: pa.Table | pa.RecordBatch, n: int):
        none = lambda kind: [np.zeros(0, dtype=kind)]
        symbols, third, upper, whole, rows, self.parts = none(np.uint16), none(np.uint64), none(np.uint16), none(np.uint64), none(np.int64), []
        for first, chunk in slices(texts, "text"):
            hashes, offsets = hash_texts(chunk)
            doc = np.repeat(np.arange(len(chunk)), np.diff(offsets))
            last = len(hashes) - n + 1
            inside = np.flatnonzero(doc[:last] == doc[n - 1 :]) if last > 0 else np.zeros(0, dtype=np.int64)
            symbols.append(((hashes[inside] >> np.uint64(56) << np.uint64(8)) | hashes[inside + min(1, n - 1)] >> np.uint64(56)).astype(np.uint16))
            third.append(hashes[inside + min(2, n - 1)])
            upper.append((hash_windows(hashes, min(UPPER, n))[inside] >> np.uint64(48)).astype(np.uint16))
            whole.append(hash_windows(hashes, n)[inside])
            rows.append(doc[inside] + first)
            self.parts.append((first, chunk, offsets, inside))
        self.symbols, self.third, self.upper, self.whole, self.rows = (np.concatenate(x) for x in (symbols, third, upper, whole, rows))


class Prefixes:
    """Prefixes of varying length that split all suffixes into groups of about GROUP.

    A prefix is one, two or three symbols, a symbol being the high bits of a word's hash: the first word's alone where no more suffixes have it than a group holds, else the
    first two, else some bits of the third besides. Small prefixes that follow one another share a group.
    """

    def __init__(self, counts: np.ndarray, most: int):
        table = counts.reshape(256, 256)
        self.base, self.bits = np.zeros(65536, dtype=np.int64), np.zeros(65536, dtype=np.uint64)
        group = held = 0
        for a in range(256):
            whole = int(table[a].sum())
            for low, high in [(0, 256)] if whole <= most else [(b, b + 1) for b in range(256)]:
                size = int(table[a, low:high].sum())
                if held and held + size > most:
                    group, held = group + 1, 0
                self.base[256 * a + low : 256 * a + high] = group
                held += size
                if size > most:  # one prefix of two symbols
                    bits = (-(-size // most) - 1).bit_length()
                    self.bits[256 * a + low] = bits
                    group, held = group + (1 << bits), 0
        self.groups = group + 1

    def of(self, x: Suffixes) -> np.ndarray:
        bits = self.bits[x.symbols]
        return self.base[x.symbols] + np.where(bits > 0, x.third >> (np.uint64(64) - np.maximum(bits, np.uint64(1))), np.uint64(0)).astype(np.int64)


def _ordered(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The stable order of keys of 64 high and 16 low bits."""
    at = order(high)
    found, rest = high[at], low[at]
    same = found[1:] == found[:-1]
    for k in np.unique(found[1:][same & (rest[1:] != rest[:-1])]).tolist():  # equal high bits alone are rare
        a, b = (int(np.searchsorted(found, np.uint64(k), side)) for side in ("left", "right"))
        at[a:b] = at[a:b][np.argsort(low[at[a:b]], kind="stable")]
    return at


class Leaves:
    """The distinct suffixes of a block in the order of their trees: by group, upper node and digest.

    ``high`` and ``low`` are their keys of 80 bits: 16 of the digest of the first UPPER words, which is the upper node, and 64 of that of all.
    ``inverse`` says for each suffix which it has; ``edges`` are the first leaves of the groups.
    """

    def __init__(self, x: Suffixes, prefixes: Prefixes):
        group = prefixes.of(x)
        high, low = (x.upper.astype(np.uint64) << np.uint64(48)) | (x.whole >> np.uint64(16)), (x.whole & np.uint64(0xFFFF)).astype(np.uint16)
        at = _ordered(high, low)
        at = at[np.argsort(group[at], kind="stable")]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (high[at][1:] != high[at][:-1]) | (low[at][1:] != low[at][:-1]) | (group[at][1:] != group[at][:-1])
        self.inverse = np.empty(len(at), dtype=np.int64)
        self.inverse[at] = np.cumsum(new) - 1
        first = at[new]
        self.high, self.low = high[first], low[first]
        self.edges = np.searchsorted(group[first], np.arange(prefixes.groups + 1))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: (id, n_words, n_removed, kept, spans).

    A word goes if it lies in a window of ``window`` consecutive words that also starts in a row of smaller id, windows
    being judged on the input. ``kept`` joins the other words by one space; ``spans`` are the maximal removed runs as
    (start, length) in words.

    Suffixes are cut at a depth of ``window`` words and split into groups by prefixes of varying length, counted first over all rows (see Prefixes), so that a group's tree fits a task. Documents lie
    in blocks that rise with the id, and a block sends each group its distinct suffixes as leaves (see Leaves). A group's leaves in order are its tree: those of one upper node share their
    first UPPER words, and equal ones lie under one node of full depth. A deep internal node is such a node with leaves of several blocks; its places are sent to all these blocks but the first.
    Nodes within a block are found when the block is read again, and neighbouring windows make the maximal repeats. A passage that every document has costs a leaf per block.
    Suffixes count as equal by digests of 80 bits (64 where their first words are the same): among 10**10 of them a wrong pair is expected once in some 20000 runs.

    Nulls and empty texts have no words: counts 0, kept ''. A null id counts as larger than all ids (rows of null id don't
    affect one another); rows of equal id don't remove each other's words. Ids are integers. Only the two named columns are read.
    """
    kind = dict(df.dtypes)[id_col]
    return _removed(only(df, id=id_col, text=text_col), "id", "text", window, None, f"id {kind}, n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,length:bigint>>")


def strip_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, length_col: str | None = None) -> DataFrame:
    """The rows of ``df``, all columns kept, with repeated windows removed from the text as by remove_repeats.

    A text that loses words becomes its other words joined by one space ('' if none are left), and ``length_col`` its characters; other texts stay as
    they are. Columns go by place, so clashing names do no harm. Null ids, repeated rows and empty tables are as in remove_repeats.
    """
    names = df.columns
    plain = [f"c{k}" for k in range(len(names))]
    length = plain[names.index(length_col)] if length_col else None
    docs = df.toDF(*plain)
    out = _removed(docs, plain[names.index(id_col)], plain[names.index(text_col)], window, (plain, length), docs.schema)
    return out.toDF(*names)


def _removed(docs: DataFrame, id_col: str, text_col: str, window: int, whole: tuple[list[str], str | None] | None, schema) -> DataFrame:
    """remove_repeats, or strip_repeats if ``whole`` names the columns to return and the one for the length."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = text_blocks(slim, "text", _SHARE)
    block, wide = id_blocks(slim, "id", "text", n)
    prefixes = count_prefixes(slim, window)
    slim = slim.withColumn("block", block)
    full = slim if whole is None else docs.withColumnRenamed(text_col, "text").withColumn("id", F.col(id_col)).withColumn("block", block)

    def send(table: pa.Table) -> pa.Table:
        release()
        leaves = Leaves(Suffixes(table.select(["text"]), window), prefixes)
        used = np.flatnonzero(np.diff(leaves.edges)).tolist()
        block = table.column("block")[0].as_py()
        spans = [(leaves.edges[g], leaves.edges[g + 1]) for g in used]
        return pa.table({"part": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int32()), "high": pa.array([pack(leaves.high[a:b]) for a, b in spans], pa.binary()), "low": pa.array([leaves.low[a:b].tobytes() for a, b in spans], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        release()
        table = table.sort_by("block")
        blocks, part = table.column("block").to_numpy(), table.column("part")[0].as_py()
        lists = [unpack(b.as_py()) for b in table.column("high")]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        high, low = np.concatenate(lists), np.concatenate([np.frombuffer(b.as_py(), dtype=np.uint16) for b in table.column("low")])
        del lists
        at = _ordered(high, low)  # leaves of one node stay in order of their blocks
        high, low = high[at], low[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        rank = np.repeat(owners(blocks, wide), sizes)[at]
        again = at[rank != rank[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]]
        found = np.sort(again)
        starts = np.cumsum(sizes) - sizes
        cuts = np.searchsorted(found, np.append(starts, len(at)))
        some = np.flatnonzero(np.diff(cuts))
        places = [pack((found[cuts[k] : cuts[k + 1]] - starts[k]).astype(np.uint64)) for k in some.tolist()]
        return pa.table({"block": pa.array(blocks[some], pa.int32()), "part": pa.array([part] * len(some), pa.int32()), "places": pa.array(places, pa.binary())})

    def apply(table: pa.Table, earlier: pa.Table) -> pa.Table:
        release()
        out = {"id": [], "n_words": [], "n_removed": [], "kept": [], "spans": []}
        if table.num_rows:
            table = table.sort_by("id")
            found = Suffixes(table.select(["text"]), window)
            leaves = Leaves(found, prefixes)
            before = np.zeros(len(leaves.high), dtype=bool)
            for part, places in zip(earlier.column("part").to_pylist(), earlier.column("places"), strict=True):
                before[leaves.edges[part] + unpack(places.as_py()).astype(np.int64)] = True
            inverse, parts = leaves.inverse, found.parts
            ids = table.column("id")
            new = np.ones(table.num_rows, dtype=np.int64)
            if table.num_rows > 1 and ids[0].is_valid:
                values = ids.combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
                new[1:] = (values[1:] != values[:-1]) & ids.is_valid().to_numpy()[1:]
            elif table.num_rows > 1:
                new[1:] = 0
            rank = np.cumsum(new)[found.rows]
            least = np.full(len(before), np.iinfo(np.int64).max)
            np.minimum.at(least, inverse, rank)
            gone = before[inverse] | (rank > least[inverse])
            at = 0
            for first, chunk, offsets, inside in parts:
                hit = inside[gone[at : at + len(inside)]]
                at += len(inside)
                edge = np.zeros(offsets[-1] + 1, dtype=np.int64)
                edge[hit] += 1
                np.subtract.at(edge, hit + window, 1)
                covered = np.cumsum(edge[:-1]) > 0
                total = np.concatenate(([0], np.cumsum(covered)))
                for k, text in enumerate(chunk):
                    low, high = int(offsets[k]), int(offsets[k + 1])
                    removed, words, spans = int(total[high] - total[low]), (text or b"").split(), []
                    if removed:
                        mask = covered[low:high]
                        turns = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                        spans = [{"start": a, "length": b - a} for a, b in turns.reshape(-1, 2).tolist()]
                        words = [words[i] for i in np.flatnonzero(~mask).tolist()]
                    out["id"].append(ids[first + k])
                    out["n_words"].append(high - low)
                    out["n_removed"].append(removed)
                    out["kept"].append(b" ".join(words))
                    out["spans"].append(spans)
        if whole is not None:
            return replaced(table, out)
        out["id"] = pa.array([x.as_py() for x in out["id"]], table.schema.field("id").type)
        out["n_words"], out["n_removed"] = (pa.array(out[c], pa.int64()) for c in ("n_words", "n_removed"))
        out["kept"] = pa.array(out["kept"], pa.binary()).cast(pa.string())
        out["spans"] = pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
        return pa.table(out)

    def replaced(table: pa.Table, out: dict[str, list]) -> pa.Table:
        columns, length = whole
        shorter = pa.array([n > 0 for n in out["n_removed"]], pa.bool_())
        texts = pc.if_else(shorter, pa.chunked_array([pa.array(out["kept"], pa.binary()).cast(pa.string())]), table.column("text").cast(pa.string()))
        table = table.set_column(table.schema.get_field_index("text"), text_col, texts)
        if length is not None:
            at = table.schema.get_field_index(length)
            kind = table.schema.field(length).type
            table = table.set_column(at, length, pc.if_else(shorter, pc.utf8_length(texts).cast(kind), table.column(length)))
        return table.select(columns)

    sent = slim.groupBy("block").applyInArrow(trimmed(send), "part int, block int, high binary, low binary")
    answers = sent.groupBy("part").applyInArrow(trimmed(answer), "block int, part int, places binary")
    return full.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(trimmed(apply), schema)


def count_prefixes(docs: DataFrame, window: int, most: int = GROUP) -> Prefixes:
    """The prefixes of the suffixes of all rows (text), from their numbers by two symbols: 65536 numbers at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts = np.zeros(65536, dtype=np.int64)
        for batch in batches:
            for at, texts in slices(batch, "text"):
                counts += np.bincount(Suffixes(batch.slice(at, len(texts)), window).symbols, minlength=65536)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], ["code", "n"])

    counts = np.zeros(65536, dtype=np.int64)
    for r in docs.select("text").mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[r.code] = r.n
    return Prefixes(counts, most)


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs, "doc_id", "text", WINDOW)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
