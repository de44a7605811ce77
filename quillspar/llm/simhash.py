"""SimHash fingerprints and near-duplicate groups found through pivot distance tables."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import distinct, hash_texts, hash_windows, mix, slices
from .common import cut, only, partitions, popcount, release, small, utf8, word_blocks
from .components import components

SEED = 42
PIVOTS = 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLANES = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a UTF-8 text: A-Z lowered, words joined to shingles, a bit set where over half of
    the shingles' XXH64 values (seed 42, repeats counted) have it. No words (or null): 0. Fewer words than a shingle:
    the whole sequence is the one shingle. Long texts are taken block by block."""
    counts, total, held = np.zeros(2048, dtype=np.int64), 0, []
    for words in word_blocks((text or b"").lower()):
        words = held + words
        if len(words) >= shingle:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
            hashes = np.fromiter((xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in spans), dtype=np.uint64)
            counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLANES).ravel(), minlength=2048)
            total += len(hashes)
            held = words[len(words) - shingle + 1 :] if shingle > 1 else []
        else:
            held = words
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED) if held else 0
    ones = counts.reshape(8, 256) @ _BITS * 2 > total
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Rows (id, fp) with the signed 64-bit fingerprint of each row's whole text. Nulls count as empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in utf8(batch.column("text"))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = dict(df.dtypes)[id_col]
    return only(df, id=id_col, text=text_col).mapInArrow(run, f"id {kind}, fp bigint")


def block_masks(max_bits: int, agree: int = 3) -> list[int]:
    """Masks of every choice of ``agree`` out of max_bits + agree blocks of the 64 bits.

    Two fingerprints that differ in at most ``max_bits`` bits differ in at most that many blocks, so they agree on
    at least ``agree`` whole blocks: some mask leaves both equal. The search is exact.
    """
    n = max_bits + agree
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, agree)]


def pivot_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: the same for every table, from a hash of their number."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(n)], dtype=np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def local_links(key: np.ndarray, near: np.ndarray, fps: np.ndarray, pivots: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal key that connect exactly those linked by distances up to ``max_bits``; rows are sorted by key and then by ``near``, the distance to pivot 0.

    A pair whose distances to some pivot differ by more than max_bits can't be that near (triangle inequality). The
    sort by the first pivot bounds the pairs looked at; the table of the other pivots discards most of what is left,
    and survivors are verified on all 64 bits. Pairs are turned into stars before they are many more than rows.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    i, step, table, held = np.arange(len(fps)), 1, None, 0
    while True:
        i = i[i + step < len(fps)]
        j = i + step
        alive = (key[i] == key[j]) & (near[j].astype(np.int16) - near[i] <= max_bits)
        i, j = i[alive], j[alive]
        if not len(i):
            break
        if table is None:
            table = popcount(fps[:, None] ^ pivots[None, 1:]).astype(np.int8)
        kept = np.abs(table[i] - table[j]).max(axis=1) <= max_bits
        a, b = i[kept], j[kept]
        close = popcount(fps[a] ^ fps[b]) <= max_bits
        out.append((a[close], b[close]))
        held += len(out[-1][0])
        if held > len(fps) + (1 << 18):
            out = [_stars_of(len(fps), out)]
            held = len(out[0][0])
        step += 1
    return (np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])) if out else (i, i)


def _stars_of(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The same components by at most one link for each of n rows: (row, smallest row of its component)."""
    root = stars(n, *(np.concatenate(x) for x in zip(*links, strict=True)))
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For links between rows 0..n-1, the smallest row of each row's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def links(fps: DataFrame, max_bits: int = 4, column: str = "fp") -> DataFrame:
    """Links (a, b) that connect, through chains, exactly the fingerprints linked by distances up to ``max_bits``.

    ``fps`` holds each fingerprint once. Candidates agree on a set of whole blocks (see block_masks); within such a
    group the pivot tables decide which pairs are verified. A group gives a star for each of its components, not all its pairs,
    so the output is linear in the input. A task holds some numbers for each fingerprint of the group it is at (17 bytes are its pivot table).
    """
    masks, pivots = block_masks(max_bits), pivot_fingerprints()
    rows = fps.select(F.col(column).alias("fp")).where("fp is not null")
    keys = F.array(*[F.struct(F.lit(k).cast("short").alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for k, m in enumerate(masks)])
    rows = rows.select("fp", F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(pivots[0]))))).cast("short").alias("near"), F.explode(keys).alias("k"))
    rows = rows.select("k.kind", "k.part", "near", "fp").repartition(partitions(fps.sparkSession), "kind", "part").sortWithinPartitions("kind", "part", "near")

    def find(kind, part, near, fp):
        new = np.ones(len(fp), dtype=bool)
        new[1:] = (kind[1:] != kind[:-1]) | (part[1:] != part[:-1])
        group = np.cumsum(new)
        crowd = np.zeros(len(fp), dtype=bool)
        crowd[1:] = ~new[1:]
        crowd[:-1] |= ~new[1:]
        group, near, fp = group[crowd], near[crowd], fp[crowd].view(np.uint64)
        a, b = local_links(group, near, fp, pivots, max_bits)
        root = stars(len(fp), a, b)
        moved = root != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[root[moved]].view(np.int64)), pa.array(fp[moved].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "part", "near", "fp"))
            held.append(now)
            rows += batch.num_rows
            kind, part = now[0], now[1]
            if rows < 100_000 or (kind[0] == kind[-1] and part[0] == part[-1]):
                continue
            at = int(np.flatnonzero((kind != kind[-1]) | (part != part[-1]))[-1]) + 1
            done = [*held[:-1], tuple(x[:at] for x in now)]
            yield find(*(np.concatenate(x) for x in zip(*done, strict=True)))
            held, rows = [tuple(x[at:] for x in now)], batch.num_rows - at
        if held:
            yield find(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per input row: (id, fp, component), the component being the smallest id reachable through links.

    Null or wordless texts have fingerprint zero and are linked like any other. A null id keeps its row and takes its
    component from the others (null if it has none). Equal texts share a fingerprint, which is searched once. Empty tables
    give empty results; only the two named columns are read.
    """
    docs = cut(fingerprints(df, id_col, text_col, shingle))
    first = docs.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(first, max_bits))
    named = first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(least, "root").select("fp", "component")
    return docs.join(named, "fp", "left").select("id", "fp", "component")


#: Bits of a long fingerprint, and the bands of minimum hashes (BANDS of ROWS each) that make two of them candidates.
BITS, BANDS, ROWS = 2048, 14, 5
#: Bits estimate similarities badly for sets of fewer shingles than SHORT, and else to well within SLACK; they are a loose filter only.
SHORT, SLACK = 64, 0.15
#: Documents and shingles of a part of a loose group; pairs of parts are verified together.
PART_ROWS, PART_SHINGLES = 2048, 1 << 20
_SALTS = np.array([xxhash.xxh64_intdigest(f"word {i}".encode(), SEED) for i in range(BITS // 64)], dtype=np.uint64)
_MINS = np.array([xxhash.xxh64_intdigest(f"minimum {i}".encode(), SEED) | 1 for i in range(BANDS * ROWS)], dtype=np.uint64)


def long_fingerprint(shingles: np.ndarray) -> tuple[bytes, list[int]]:
    """The BITS-bit fingerprint of a set of shingle hashes, and its band keys.

    Each shingle votes on each bit; the smallest one breaks ties. Two sets differ in a share of the bits that is the angle between them
    over pi. A band key digests ROWS minimum hashes, so two sets of similarity s share a given key with probability s**ROWS.
    """
    if not len(shingles):
        return bytes(BITS // 8), [0]
    votes, least = np.zeros(BITS, dtype=np.int64), np.full(len(_MINS), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 255):  # as many ones as a byte counts
        some = shingles[at : at + 255]
        drawn = np.unpackbits(mix(some[:, None] ^ _SALTS).view(np.uint8), axis=1)
        votes += drawn.sum(axis=0, dtype=np.uint8)
        least = np.minimum(least, (some[:, None] * _MINS).min(axis=0))
    first = np.unpackbits(mix(shingles.min() ^ _SALTS).view(np.uint8))
    ones = 4 * votes + 2 * first > 2 * len(shingles) + 1
    bands = least.reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys ^ mix(bands[:, k]))
    return np.packbits(ones).tobytes(), keys.view(np.int64).tolist()


def similarity(bits: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of sets of n and m shingles whose long fingerprints differ in so many bits."""
    common = np.cos(np.pi * bits / BITS).clip(0) * np.sqrt(n.astype(float) * m)
    return common / np.maximum(n + m - common, 1e-9)


def _shingle_sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets of shingle hashes in order) of consecutive rows. A text of fewer words than a shingle is one shingle."""
    for first, texts in slices(batch, "text", 1 << 20):
        hashes, offsets = hash_texts([t and t.lower() for t in texts])
        yield first, [distinct(hash_windows(hashes[low:high], max(1, min(shingle, high - low)))) for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def long_fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (id, h, digest, fp, n, keys): xxhash64 of the text, digest of the set of shingles, long fingerprint, number of distinct shingles and band keys of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for first, sets in _shingle_sets(batch, shingle):
                fps, keys = zip(*[long_fingerprint(own) for own in sets], strict=True)
                columns = [pa.array([_digest(own) for own in sets], pa.binary()), pa.array(fps, pa.binary()), pa.array([len(own) for own in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, len(sets)) for c in ("id", "h")] + columns, ["id", "h", "digest", "fp", "n", "keys"])

    rows = only(df, id=id_col, text=text_col).withColumn("h", F.xxhash64("text"))
    return rows.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, h bigint, digest binary, fp binary, n int, keys array<bigint>")


def band_links(key: np.ndarray, fps: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by band key, links (row, first row of its group) among rows of equal key that may be ``least`` or more alike.

    Sizes rule pairs out for certain. Bits rule out those whose estimate falls short by more than SLACK, unless a set is SHORT.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    loose = least - SLACK
    most = int(BITS * math.acos(2 * loose / (1 + loose)) / math.pi) + 1  # sets of unlike sizes must be nearer than equal ones
    i, step, held = np.arange(len(key)), 1, 0
    while True:
        i = i[i + step < len(key)]
        i = i[key[i] == key[i + step]]
        if not len(i):
            break
        for at in range(0, len(i), 8192):
            a = i[at : at + 8192]
            b = a + step
            fit = np.minimum(sizes[a], sizes[b]) >= least * np.maximum(sizes[a], sizes[b]) - 1e-9
            a, b = a[fit], b[fit]
            apart = popcount(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int64)
            near = apart <= most
            near[near] = similarity(apart[near], sizes[a[near]], sizes[b[near]]) >= loose
            near |= np.minimum(sizes[a], sizes[b]) < SHORT
            out.append((a[near], b[near]))
            held += len(out[-1][0])
            if held > len(key) + (1 << 18):  # stars say the same in a link for each row
                out = [_stars_of(len(key), out)]
                held = len(out[0][0])
        step += 1
    return _stars_of(len(key), out) if out else (i, i)


def set_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (row, row) that connect, through chains, exactly the sets linked by a Jaccard similarity of ``least`` or more.

    Rows are reached from one another; each is compared once with the rows not yet reached whose sizes allow it, so tight groups take linear time.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order], dtype=np.int64)
    found, element = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    left, own, out = np.arange(len(sets)), np.zeros(len(found), dtype=np.int64), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            k = queue.pop()
            low, high = np.searchsorted(sizes[left], [least * sizes[k] - 1e-9, sizes[k] / least + 1e-9])
            some = left[low:high]
            if not len(some):
                continue
            mine = element[edges[k] : edges[k + 1]]
            own[mine] = 1
            if len(some) == some[-1] - some[0] + 1:
                places = element[edges[some[0]] : edges[some[-1] + 1]]
            else:
                places = np.concatenate([element[edges[x] : edges[x + 1]] for x in some.tolist()])
            begins = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            common = np.add.reduceat(own[places], begins) if len(places) else np.zeros(len(some), dtype=np.int64)
            own[mine] = 0
            near = common * (1 + least) >= least * (sizes[some] + sizes[k]) - 1e-9
            out += [(int(order[x]), int(order[k])) for x in some[near].tolist()]
            queue += some[near].tolist()
            left = np.concatenate((left[:low], some[~near], left[high:]))
    return out


def _by_groups(batches: Iterator[pa.RecordBatch], columns: list[str], enough: int, find) -> Iterator[pa.RecordBatch]:
    """``find`` over record batches of whole groups, of at least ``enough`` rows where there are as many; rows are sorted by the integer columns that tell groups apart."""
    release()
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in columns]
        if held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != k[0] for c, k in zip(columns, keys, strict=True)) and sum(r.num_rows for r in held) >= enough:
            yield find(held)
            held = []
        held.append(batch)
        change = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
        if sum(r.num_rows for r in held) < enough or not len(change):
            continue
        at = int(change[-1]) + 1
        yield find([*held[:-1], batch.slice(0, at)])
        held = [batch.slice(at)]
    if held:
        yield find(held)


def _verified(df: DataFrame, groups: DataFrame, shingle: int, least: float) -> DataFrame:
    """Rows (node, root) of the nodes that have another of their loose group (id, digest, node, n, root) as root, by links verified on their whole sets of shingles.

    The texts of ``df`` (id, text) are cut into shingles again, once for each node. A group of many rows or shingles is split into parts by a hash, and
    each pair of parts is a task's work, so that what a task holds is bounded; only such groups need their links joined across tasks.
    """
    parts = F.ceil(F.greatest(F.count("*") / PART_ROWS, F.sum("n") / PART_SHINGLES)).cast("int")
    sizes = groups.groupBy("root").agg(parts.alias("parts"), F.count("*").alias("rows")).where("rows > 1")
    members = groups.join(sizes.hint("merge"), "root").select(F.col("id").alias("i"), F.col("digest").alias("wanted"), "node", "root", "parts")
    texts = df.join(members.hint("merge"), F.col("id") == F.col("i")).select("text", "wanted", "node", "root", "parts")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for first, found in _shingle_sets(batch, shingle):
                part = batch.slice(first, len(found))
                right = [_digest(own) == w for own, w in zip(found, part.column("wanted").to_pylist(), strict=True)]  # rows of one id may have several texts
                part = part.append_column("shingles", pa.array([own.tobytes() for own in found], pa.binary())).filter(pa.array(right, pa.bool_()))
                yield part.select(["root", "node", "parts", "shingles"])

    def find(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        key = np.column_stack([table.column(c).to_numpy() for c in ("root", "x", "y")])
        nodes, found = table.column("node").to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
        edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        root = np.arange(len(nodes))
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(nodes)], strict=True):
            a, b = np.array(set_links(found[low:high], least), dtype=np.int64).reshape(-1, 2).T
            root[low:high] = low + stars(high - low, a, b)
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]]), table.column("parts").take(pa.array(moved)).combine_chunks()], ["node", "root", "parts"])

    rows = texts.mapInArrow(sets, "root bigint, node bigint, parts int, shingles binary")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.select("root", "node", "shingles", "own", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("parts", "root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "shingles")
    rows = rows.repartition(partitions(df.sparkSession), "root", "x", "y").sortWithinPartitions("root", "x", "y")
    found = cut(rows.mapInArrow(lambda batches: _by_groups(batches, ["root", "x", "y"], 500, find), "node bigint, root bigint, parts int").where("node <> root"))
    whole, shared = found.where("parts = 1").select("node", "root").distinct(), found.where("parts > 1")
    return whole if shared.isEmpty() else whole.unionAll(components(shared, "node", "root"))


def _rooted(df: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> DataFrame:
    """Rows (id, h, digest, first, root): rows of one root are near copies, by near_copies; ``first`` is the smallest id of the digest."""
    release()  # what earlier stages left in the driver
    docs = cut(long_fingerprints(df, id_col, text_col, shingle))
    first = cut(docs.groupBy("digest").agg(F.min("id").alias("first"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("keys").alias("keys")).withColumn("node", F.xxhash64("digest")))
    rows = first.where("first is not null").select(F.explode("keys").alias("key"), "node", "n", "fp")
    rows = rows.repartition(partitions(df.sparkSession), "key").sortWithinPartitions("key")

    def find(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        key, nodes, sizes = (np.concatenate([r.column(c).to_numpy(zero_copy_only=False) for r in rows]) for c in ("key", "node", "n"))
        crowd = np.zeros(len(key), dtype=bool)
        crowd[1:] = key[1:] == key[:-1]
        crowd[:-1] |= crowd[1:]
        at = np.flatnonzero(crowd)
        fps = pa.Table.from_batches(rows).column("fp").take(pa.array(at)).to_pylist()
        fps = np.frombuffer(b"".join(fps), dtype=np.uint64).reshape(len(at), BITS // 64)
        a, b = band_links(key[at], fps, sizes[at], least)
        return pa.RecordBatch.from_arrays([pa.array(nodes[at[a]]), pa.array(nodes[at[b]])], ["a", "b"])

    loose = components(rows.mapInArrow(lambda batches: _by_groups(batches, ["key"], 50_000, find), "a bigint, b bigint"))
    groups = cut(first.join(loose.hint("merge"), "node").select(F.col("first").alias("id"), "digest", "node", "n", "root"))
    roots = _verified(only(df, id=id_col, text=text_col), groups, shingle, least).withColumnRenamed("node", "of")
    named = cut(first.join(roots, F.col("node") == F.col("of"), "left").select("digest", "first", F.coalesce("root", "node").alias("root")))
    return docs.select("id", "h", "digest").join(named, "digest", "left")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row per input row: (id, component), rows being linked if their sets of word shingles have a similarity of ``least`` or more.

    64 bits don't tell a similarity of 0.8 from one of 0.7 (fingerprints then differ in 8 to 12 of them, give or take 4), and at that
    distance pivots discard nothing. So fingerprints have 2048 bits here, and are a loose filter only: candidates agree on a band of minimum
    hashes, which at 0.8 is missed once in 200 times, those far apart by their bits are discarded, and what is left makes loose groups.
    Within a loose group all pairs are verified by the exact similarity of their 64-bit shingle hashes. Texts of equal sets are taken once,
    by a digest of the set; groups give stars, not pairs.

    Texts of fewer words than a shingle are one shingle; wordless and null texts are alike. A null id keeps its row and takes its component
    from the others (null if none has an id). Empty tables give empty results; only the two named columns are read.
    """
    rows = cut(_rooted(df, id_col, text_col, shingle, least))
    least_ids = rows.groupBy("root").agg(F.min("first").alias("component"))
    return rows.join(least_ids, "root", "left").select("id", "component")


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) without near copies of another row, all columns kept.

    Of each group the row of smallest id stays (of smallest text hash, where texts of one id are near copies); a row of null id comes after all others, and such
    rows alone are copies of one another only if their sets of shingles are equal. Of rows of one id and one text the one of smallest hash of all its columns stays. Rows of
    one id whose texts differ are judged each by its text. An empty table stays empty.
    """
    found = cut(_rooted(docs, "doc_id", "text", shingle, least).groupBy("id", "h").agg(F.count("*").alias("n"), F.min("root").alias("root")))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "h")
    best = found.groupBy("root").agg(F.min(order).alias("best"))
    judged = found.join(best, "root").select(F.col("id").alias("i"), F.col("h").alias("g"), "n", (order != F.col("best")).alias("gone"))
    judged = cut(judged.select("i", "g", "n", F.coalesce("gone", F.lit(True)).alias("gone")))
    same = lambda side: docs["doc_id"].eqNullSafe(side["i"]) & (F.xxhash64(docs["text"]) == side["g"])
    gone = small(judged.where("gone").select("i", "g"))
    kept = docs.join(gone, same(gone), "left_anti")
    again = small(judged.where("not gone and n > 1").select("i", "g"))
    if again.isEmpty():
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    twice = kept.join(again, same(again), "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(whole, F.xxhash64(whole)).alias("row")).select("row.*")
    return kept.join(again, same(again), "left_anti").unionAll(twice)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs, "doc_id", "text", shingle=4, max_bits=4)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
