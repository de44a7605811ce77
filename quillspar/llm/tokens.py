"""Encoding with a public tokenizer, a binary file format for token ids, and packing."""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from .blocks import grouped, id_blocks, mix, text_blocks
from .common import hold, new_path, only, remove, tidy

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = 0
#: Finds a character whose class may differ between pattern engines, or a special token's string; such texts go to the library whole.
_ODD = r"[^\t\n\r\x20-\x7e\x{a1}-\x{ac}\x{ae}-\x{24f}]|<\|"
_KNOWN = 400_000
_SLOTS = 1 << 20
_SPACE, _WHITE, _LETTER, _DIGIT, _OTHER, _EDGE = range(6)


def _byte_classes() -> np.ndarray:
    """The class of each byte of a text without _ODD characters; bytes of longer characters count as letters (see _classes)."""
    out = np.full(256, _OTHER, dtype=np.uint8)
    out[0x80:] = _LETTER
    for c, kind in ((string.ascii_letters, _LETTER), (string.digits, _DIGIT), ("\t\n\r", _WHITE), (" ", _SPACE), ("\0", _EDGE)):
        out[list(c.encode())] = kind
    return out


_CLASS = _byte_classes()
#: Of the characters U+00A1 to U+00BF and of the two signs among the letters up to U+024F: their classes by second byte.
_SIGNS = {0xC2: {b: _LETTER if b in (0xAA, 0xB5, 0xBA) else _DIGIT if b in (0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE) else _OTHER for b in range(0x80, 0xC0)}, 0xC3: {0x97: _OTHER, 0xB7: _OTHER}}


def _classes(data: np.ndarray) -> np.ndarray:
    out = _CLASS[data]
    for lead, kinds in _SIGNS.items():
        at = np.flatnonzero(data == lead)
        if not len(at):
            continue
        table = np.full(256, _LETTER, dtype=np.uint8)
        table[list(kinds)] = list(kinds.values())
        out[at] = out[at + 1] = table[data[at + 1]]
    return out


def cut_pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of the pieces that the vocabulary's pattern cuts texts into, which end with a zero byte each.

    A piece is a run of letters, of digits or of other signs, with one space before it if there is one; 's 't 'm 'd 're 've 'll are pieces of
    their own where an apostrophe begins a piece; of white space, the last character before such a run stands alone (or is the run's space), and what is before it is one piece.
    """
    kind = _classes(data)
    white = kind <= _WHITE
    group = np.where(white, np.uint8(_WHITE), kind)
    start = np.ones(len(data), dtype=bool)
    np.not_equal(group[1:], group[:-1], out=start[1:])
    after = np.flatnonzero(white[:-1] & ~white[1:] & (kind[1:] != _EDGE)) + 1
    start[after - 1] = True
    start[after[data[after - 1] == 0x20]] = False
    marks = np.flatnonzero((data == 0x27) & start)
    marks = marks[kind[marks + 1] == _LETTER]
    if len(marks):
        one, two = data[marks + 1], data[np.minimum(marks + 2, len(data) - 1)]
        short = np.isin(one, list(b"stmd"))
        long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        start[marks[short | long] + 1] = False
        for hit, n in ((short, 2), (long, 3)):
            rest = marks[hit] + n
            start[rest[kind[rest] == _LETTER]] = True
    edge = kind == _EDGE
    events = np.flatnonzero(start | edge)
    own = ~edge[events]
    ends = np.append(events[1:], len(data))
    return events[own], ends[own]


def _piece_keys(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of byte ranges, by words of eight bytes; ``data`` has eight bytes more than the ranges."""
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    size = ends - starts
    low = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
    keys = mix(words[starts] & low[np.minimum(size, 8)]) + size.astype(np.uint64)
    left, at = np.flatnonzero(size > 8), 8
    while len(left) and at < 64:
        keys[left] = mix(keys[left] * np.uint64(0x9E3779B97F4A7C15) ^ (words[starts[left] + at] & low[np.minimum(size[left] - at, 8)]))
        at += 8
        left = left[size[left] > at]
    for k in left.tolist():
        keys[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]])
    return keys


def _byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write for the bytes: printable ones themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


#: For pieces set apart by zero bytes.
_LETTERS = _byte_letters() | {0: "\n"}


class Encoder:
    """Ids of a byte-level vocabulary, by the tokenizers library.

    The vocabulary's pattern cuts a text into pieces, each of which is encoded for itself. Here texts are cut by array operations, and only pieces that
    are new go to the library, which then has no pattern to match; the ids of pieces seen before are kept by a 64-bit key: about _KNOWN of them,
    then the half met most often stays. Texts with characters beyond the Latin blocks, where character classes might differ between regular
    expression engines, with control characters or with a special token's string go to the library whole.
    """

    def __init__(self, path: str = VOCABULARY, end: int = END):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bare = Tokenizer.from_file(path)
        self.bare.pre_tokenizer = CharDelimiterSplit("\n")
        self.end = end
        strings = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(strings.values()) + 1
        self.bytes_of = np.zeros(self.size, dtype=np.int64)
        for token, i in strings.items():
            self.bytes_of[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.pool, self.starts, self.lengths, self.met, self.keys = (np.zeros(0, dtype=k) for k in (np.uint16, np.int64, np.int64, np.int64, np.uint64))
        self.place = np.zeros(2 * _SLOTS, dtype=np.int32)  # slot + 1 of a key at one of its two places, if there is room
        self.rising = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))  # all keys in order, and their slots

    def _thin(self) -> None:
        """Keep the pieces met most often, half of _KNOWN at most and none met but once."""
        best = np.argsort(-self.met, kind="stable")[: _KNOWN // 2]
        best = np.sort(best[self.met[best] > 1])
        ids, keys, lengths, met = self._gather(best), self.keys[best], self.lengths[best], self.met[best] // 2
        self.clear()
        self._learn(keys, ids, lengths)
        self.met = met

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint16)

    def _learn(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.keys)
        self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.met = np.concatenate((self.met, np.zeros(len(keys), dtype=np.int64)))
        self.pool = np.concatenate((self.pool, ids))
        self.keys = np.concatenate((self.keys, keys))
        at = np.argsort(self.keys, kind="stable")
        self.rising = self.keys[at], at
        left = np.arange(len(keys))
        for place in self._places(keys):
            free = left[self.place[place[left]] == 0]
            self.place[place[free]] = free + first + 1
            left = left[self.place[place[left]] != left + first + 1]

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (keys & np.uint64(_SLOTS - 1)).astype(np.int64), (keys >> np.uint64(40) & np.uint64(_SLOTS - 1)).astype(np.int64) + _SLOTS

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys, -1 where a key is new."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        first, second = self._places(keys)
        slots = self.place[first].astype(np.int64) - 1
        left = np.flatnonzero((slots < 0) | (self.keys[slots] != keys))
        slots[left] = self.place[second[left]].astype(np.int64) - 1
        left = left[(slots[left] < 0) | (self.keys[slots[left]] != keys[left])]
        known, at = self.rising
        found = np.minimum(np.searchsorted(known, keys[left]), len(known) - 1)
        slots[left] = np.where(known[found] == keys[left], at[found], -1)
        return slots

    def _encode_pieces(self, keys: np.ndarray, found: list[bytes]) -> None:
        """Learn pieces, encoded some hundred at a time as one text and cut by byte counts."""
        slabs = []
        for k in range(0, len(found), 256):
            text = b"\0".join(found[k : k + 256])
            if text.isascii():
                slabs.append(text.decode().replace("\n", _LETTERS[10]).replace("\0", "\n").replace(" ", _LETTERS[32]).replace("\t", _LETTERS[9]).replace("\r", _LETTERS[13]))
            else:
                slabs.append(text.decode("latin-1").translate(_LETTERS))
        ids = np.concatenate([np.array(e.ids, dtype=np.uint16) for e in self.bare.encode_batch_fast(slabs, add_special_tokens=False)])
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes)) + 1
        self._learn(keys, ids, np.diff(ends, prepend=0))

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        lengths = self.lengths[slots]
        ends = np.cumsum(lengths)
        return self.pool[np.repeat(self.starts[slots] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def _by_pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the number of its ids, and all ids."""
        data = b"\0".join(texts) + bytes(9)
        starts, ends = cut_pieces(np.frombuffer(data, dtype=np.uint8, count=len(data) - 8))
        keys = _piece_keys(data, starts, ends)
        if len(self.keys) > _KNOWN:
            self._thin()
        slots = self._find(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            fresh, first, inverse = grouped(keys[new])
            at = new[first]
            found = [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            order = np.argsort([not x.isascii() for x in found], kind="stable")  # slabs of ASCII alone are made faster
            slot = np.empty(len(order), dtype=np.int64)
            slot[order] = np.arange(len(self.keys), len(self.keys) + len(order))
            slots[new] = slot[inverse]
            self._encode_pieces(fresh[order], [found[k] for k in order.tolist()])
        self.met += np.bincount(slots, minlength=len(self.met))
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        edges = np.concatenate(([0], np.cumsum(self.lengths[slots])))
        cuts = edges[np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))]
        return np.diff(cuts), self._gather(slots)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text (null: empty) the number of its ids with the end id, and all ids one after the other."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _ODD)
        lengths = np.zeros(len(texts), dtype=np.int64)
        plain = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        ids = np.zeros(0, dtype=np.uint16)
        if len(plain):
            lengths[plain], ids = self._by_pieces(texts.filter(pc.invert(odd)).cast(pa.binary()).to_pylist())
        whole = {k: self._whole(texts[k].as_py()) for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        for k, x in whole.items():
            lengths[k] = len(x)
        lengths += 1
        ends = np.cumsum(lengths)
        out = np.full(int(ends[-1]) if len(ends) else 0, self.end, dtype=np.uint16)
        inside = np.ones(len(out), dtype=bool)
        inside[ends - 1] = False
        for k, x in whole.items():
            out[ends[k] - lengths[k] : ends[k] - 1] = x
            inside[ends[k] - lengths[k] : ends[k]] = False
        out[inside] = ids
        return lengths, out


def pieces(column: pa.ChunkedArray | pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) in runs of about ``limit`` bytes."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.cumsum(pc.binary_length(whole).fill_null(0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(whole):
        base = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield first, whole.slice(first, last - first)
        first = last


def encoder(path: str = VOCABULARY, end: int = END) -> Encoder:
    """One encoder per worker process, kept between tasks; see hold."""
    return hold(("encoder", path, end), lambda: Encoder(path, end))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# The file format ---------------------------------------------------------------------------------------------

MAGIC = b"QSVB1\0"
#: Parts whose running sums of ids a task makes.
PARTS_OF = 4096
_WIDTH = np.array([1, 2, 3, 4], dtype=np.int64)
#: For each control byte: the byte offsets and widths of its four values, and its total.
_CTRL_WIDTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.int64)


def pack_ids(ranks: np.ndarray) -> bytes:
    """Byte-aligned variable-length coding: two control bits a value (its bytes less one) apart from the data bytes."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return MAGIC + len(ranks).to_bytes(8, "little") + control.tobytes() + data.tobytes()


def unpack_ids(blob: bytes) -> np.ndarray:
    """The values again: widths come from a table by control byte, bytes are gathered by position."""
    if blob[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token segment")
    at = len(MAGIC) + 8
    n = int.from_bytes(blob[len(MAGIC) : at], "little")
    control = np.frombuffer(blob, dtype=np.uint8, count=-(-n // 4), offset=at)
    data = np.concatenate((np.frombuffer(blob, dtype=np.uint8, offset=at + len(control)), np.zeros(4, dtype=np.uint8)))
    widths = _CTRL_WIDTHS[control].ravel()[:n]
    ends = np.cumsum(widths)
    starts = ends - widths
    out = data[starts].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(widths > k)
        if not len(more):
            break
        out[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unsqueeze(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=kind)


_STAGED = "block int, rows int, ids binary, nulls binary, lengths binary, tokens binary"


def stage_tokens(docs: DataFrame, path: str, out: str) -> None:
    """Encode (id, text, block) once; write runs of rows of one block, their ids squeezed, to ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kept: dict[int, list] = {}
        size = 0

        def flush():
            got = [(b, len(x), _squeeze(np.array([i or 0 for i, _ in x], dtype="<i8")), _squeeze(np.array([i is None for i, _ in x])), _squeeze(np.array([len(t) for _, t in x], dtype="<i8")), _squeeze(np.concatenate([t for _, t in x]))) for b, x in kept.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["block", "rows", "ids", "nulls", "lengths", "tokens"])

        for batch in batches:
            ids, blocks = batch.column("id").to_pylist(), batch.column("block").to_pylist()
            for first, texts in pieces(batch.column("text")):
                lengths, tokens = enc.encode(texts)
                for k, part in enumerate(np.split(tokens, np.cumsum(lengths)[:-1])):
                    kept.setdefault(blocks[first + k], []).append((ids[first + k], part))
                size += len(tokens)
                if size > 1 << 23:
                    yield flush()
                    kept.clear()
                    size = 0
        if kept:
            yield flush()

    docs.mapInArrow(run, _STAGED).write.option("compression", "uncompressed").parquet(out)


def rank_table(staged: DataFrame, size: int) -> np.ndarray:
    """Ids in order of falling frequency over all documents (ties: smaller id first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for blob in batch.column("tokens"):
                counts += np.bincount(_unsqueeze(blob.as_py(), "<u2"), minlength=size)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["token", "n"])

    counted = staged.select("tokens").mapInArrow(run, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, dtype=np.int64)
    for r in counted.collect():  # at most a row per id of the vocabulary
        counts[r.token] = r.n
    return np.lexsort((np.arange(size), -counts))


def write_token_files(df: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> None:
    """Encode all rows and write them to the folder ``out``: ``<out>/segments`` holds the ids, ``<out>/vocabulary`` the rank table.

    A segment is a row (part, segment, ahead, rows, n, ids, nulls, lengths, payload): the ids of ``rows`` documents in ascending id order,
    ``n`` in all, each document's ending with id 0, as frequency ranks in the format of pack_ids; ``ahead`` counts the ids of
    earlier segments of its part. Segments in order of (part, segment) are the whole table in order. Ids are integers. Null texts are empty; null
    ids (marked in ``nulls``) come last; rows of one id come in any order; only the two named columns are read. The container is Parquet, so any store that Spark reaches will do.
    """
    spark = df.sparkSession
    docs = only(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    docs = docs.withColumn("block", id_blocks(docs, "id", "text", text_blocks(docs, "text"))[0])
    stage_tokens(docs, path, f"{out}/staged")
    staged = spark.read.schema(_STAGED).parquet(f"{out}/staged")
    order = rank_table(staged, encoder(path).size)
    spark.createDataFrame([(order.astype("<u4").tobytes(),)], "tokens binary").write.parquet(f"{out}/vocabulary")
    rank = np.empty(len(order), dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank)

    def build(table: pa.Table) -> pa.Table:
        ids = np.concatenate([_unsqueeze(b.as_py(), "<i8") for b in table.column("ids")])
        lengths = np.concatenate([_unsqueeze(b.as_py(), "<i8") for b in table.column("lengths")])
        tokens = np.concatenate([_unsqueeze(b.as_py(), "<u2") for b in table.column("tokens")])
        starts = np.cumsum(lengths) - lengths
        nulls = np.concatenate([_unsqueeze(b.as_py(), "?") for b in table.column("nulls")])
        rows, first, size, ahead = [], 0, 0, 0
        order = np.lexsort((ids, nulls))
        for k, row in enumerate(order.tolist()):
            size += int(lengths[row])
            if size >= 1 << 20 or k + 1 == len(order):
                part = order[first : k + 1]
                payload = np.concatenate([tokens[starts[i] : starts[i] + lengths[i]] for i in part.tolist()])
                rows.append((table.column("block")[0].as_py(), len(rows), ahead, len(part), size, _squeeze(ids[part]), _squeeze(nulls[part]), _squeeze(lengths[part]), pack_ids(ranks.value[payload])))
                first, size, ahead = k + 1, 0, ahead + size
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "segment", "ahead", "rows", "n", "ids", "nulls", "lengths", "payload"])

    built = staged.groupBy("block").applyInArrow(build, _SEGMENT)
    built.write.option("compression", "zstd").parquet(f"{out}/segments")
    remove(spark, f"{out}/staged")
    tidy(spark)


_SEGMENT = "part int, segment int, ahead bigint, rows int, n bigint, ids binary, nulls binary, lengths binary, payload binary"


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, in no order: (id, start, n_tokens, ids_crc32), decoded from what write_token_files wrote; ``with_ids`` adds the ids.

    ``start`` counts the ids of all documents before it. Only a total for each PARTS_OF parts passes the driver; within them, sums run in a task.
    """
    segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments")
    head = spark.read.schema("tokens binary").parquet(f"{path}/vocabulary").first()
    ids_of = spark.sparkContext.broadcast(np.frombuffer(head.tokens, dtype="<u4"))
    place = new_path(spark, "starts")
    group = F.floor(F.col("part") / PARTS_OF)
    segments.groupBy("part").agg(F.sum("n").alias("n")).write.parquet(f"{place}/totals")
    totals = spark.read.schema("part int, n bigint").parquet(f"{place}/totals")
    sums = {r.g: r.n for r in totals.groupBy(group.alias("g")).agg(F.sum("n").alias("n")).collect()}
    before, at = {}, 0
    for g in sorted(sums):
        before[g] = at
        at += sums[g]
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), group) if before else F.lit(0)
    totals.select("part", (ahead + base).cast("bigint").alias("first")).write.parquet(f"{place}/firsts")
    segments = segments.join(spark.read.schema("part int, first bigint").parquet(f"{place}/firsts"), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tokens = ids_of.value[unpack_ids(batch.column("payload")[k].as_py())]
                ids, lengths = (_unsqueeze(batch.column(c)[k].as_py(), "<i8") for c in ("ids", "lengths"))
                nulls = _unsqueeze(batch.column("nulls")[k].as_py(), "?")
                starts = batch.column("first")[k].as_py() + batch.column("ahead")[k].as_py() + np.cumsum(lengths) - lengths
                parts = np.split(tokens, np.cumsum(lengths)[:-1])
                columns = [pa.array(ids, pa.int64(), mask=nulls), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array([crc32(x) for x in parts], pa.int64())]
                names = ["id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return segments.select("first", "ahead", "ids", "nulls", "lengths", "payload").mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), out)
    return read_token_files(spark, out).withColumnRenamed("id", "doc_id")
