"""Blocks of whole documents, and vectorised word hashes over them."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 12 << 20
CELLS = 512
_CHUNK = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(20130)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(n, dtype=np.uint64)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    kept = _POWERS.get((base, inverse))
    if kept is None or len(kept) < n:
        kept = _POWERS[base, inverse] = _powers(pow(base, -1, 1 << 64) if inverse else base, max(n, _CHUNK))
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _chunk_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = _SPACE[data]
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * powers(_BASE, len(data), True)[starts] + (ends - starts).astype(np.uint64))


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and 64-bit hashes of the words of a text, taken in chunks that end between words."""
    whole, at, starts, hashes = np.frombuffer(data, dtype=np.uint8), 0, [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    while at < len(whole):
        end = min(at + _CHUNK, len(whole))
        while end < len(whole) and not _SPACE[whole[end]]:
            end += 1
        s, h = _chunk_hashes(whole[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def hash_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts one after the other, and the word offsets of the texts (one more than texts)."""
    lengths = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
    starts, hashes = hash_words(b"\n".join(t or b"" for t in texts))
    return hashes, np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))


def hash_windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit digests of each n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(_STEP, len(hashes)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(_STEP, len(hashes), True)[: len(hashes) - n + 1])


def slices(table: pa.Table | pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts as bytes) of consecutive rows of about ``limit`` bytes together."""
    texts: list[bytes | None] = []
    first = size = 0
    for k, t in enumerate(table.column(column).cast(pa.binary())):
        text = t.as_py()
        texts.append(text)
        size += len(text or b"")
        if size >= limit:
            yield first, texts
            texts, size, first = [], 0, k + 1
    if texts:
        yield first, texts


def text_blocks(df: DataFrame, text: str, parts: int = 1) -> int:
    """How many blocks keep each near a BLOCK_BYTES of text over ``parts``."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, math.ceil(size * parts / BLOCK_BYTES))


def _numbers(values: list, kind: str = "bigint") -> Column:
    """An array of numbers as one literal, however many there are: a literal for each would swell the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _place(value: Column, bounds: Column, n: int) -> Column:
    """How many of the ``n`` rising bounds a value isn't under, by halving."""
    steps = [F.lit(1 << k) for k in reversed(range(n.bit_length()))]
    return F.aggregate(F.array(*steps), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= value, at + step).otherwise(at)) if n else F.lit(0)


def id_blocks(df: DataFrame, column: str, text: str, n: int) -> tuple[Column, list[tuple[int, int]]]:
    """A block number that rises with an integer id, null ids last, and the (first block, blocks) of ids that lie in several.

    Up to CELLS quantiles of the ids are found on the driver; beyond as many blocks, each cell is divided evenly. Rows of an id that fills more than a
    cell, and rows of null id, are dealt over several blocks by a hash of their texts. What the number is found by is of one size for any number of cells: a branch for
    each would take the driver hundreds of MB to plan and compile.
    """
    cells = min(n, CELLS)
    if n <= 1:
        return F.lit(0), []
    found, rows, named = df.agg(F.percentile_approx(column, [i / cells for i in range(cells + 1)], 20 * cells), F.count("*"), F.count(column)).first()
    times = Counter(found or [])
    parts = math.ceil(n / cells)
    value, turn = F.col(column), F.xxhash64(text)
    bounds, wide = [], {}  # rising lower bounds; place among the ranges -> blocks of an id of its own
    for edge in sorted(times):
        if edge not in bounds[-1:]:
            bounds.append(edge)
        if times[edge] > 2:
            wide[len(bounds)] = (times[edge] - 1) * parts
            if edge + 1 < 1 << 63:
                bounds.append(edge + 1)
    sizes = [wide.get(k, parts if 0 < k < len(bounds) else 1) for k in range(len(bounds) + 1)]
    firsts = [sum(sizes[:k]) for k in range(len(sizes))]
    nulls = max(1, math.ceil((rows - named) / max(1, rows) * n))

    inner = [k for k in range(len(sizes)) if sizes[k] > 1 and k not in wide]  # ranges that are divided
    lows, widths = [0] * len(sizes), [0.0] * len(sizes)
    for k in inner:
        lows[k], widths[k] = bounds[k - 1], float(bounds[k] - bounds[k - 1])
    tables = {"first": _numbers(firsts), "size": _numbers(sizes), "low": _numbers(lows), "width": _numbers(widths, "double")}
    found_in = F.transform(F.array(_place(value, _numbers(bounds), len(bounds))), lambda k: F.struct(*[F.get(x, k).alias(name) for name, x in tables.items()]))
    within = lambda r: F.floor((value.cast("double") - r["low"].cast("double")) * F.lit(float(parts)) / r["width"])
    turned = lambda r: F.when(r["size"] == 1, F.lit(0)).when(r["width"] == 0, F.pmod(turn, r["size"])).otherwise(F.least(r["size"] - 1, within(r)))
    block = F.get(F.transform(found_in, lambda r: r["first"] + turned(r)), F.lit(0)).cast("int")  # a lambda's variable, so that the place is looked up once

    last = sum(sizes)
    block = F.when(value.isNull(), (F.lit(last) + F.pmod(turn, F.lit(nulls))).cast("int")).otherwise(block)
    return block, [(firsts[k], size) for k, size in wide.items()] + [(last, nulls)]


def owners(blocks: np.ndarray, wide: list[tuple[int, int]]) -> np.ndarray:
    """The blocks' numbers, those of the several blocks of one id being made that of the first."""
    out = blocks.copy()
    for first, size in wide:
        out[(blocks >= first) & (blocks < first + size)] = first
    return out


def order(keys: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit keys: a plain sort of their high bits with the place in the low ones, many times as fast as argsort."""
    low = np.uint64(max(1, len(keys)).bit_length())
    at = np.sort((keys >> low << low) | np.arange(len(keys), dtype=np.uint64))
    at = (at & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    found = keys[at]
    for k in np.flatnonzero(found[1:] < found[:-1]).tolist():  # different keys of the same high bits are rare
        a, b = (int(x) for x in np.searchsorted(found >> low, [found[k] >> low, (found[k] >> low) + np.uint64(1)]))
        at[a:b] = at[a:b][np.argsort(keys[at[a:b]], kind="stable")]
    return at


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order."""
    keys = np.sort(keys)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the first place of each, and for each place which it has."""
    at = order(keys)
    found = keys[at]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = found[1:] != found[:-1]
    inverse = np.empty(len(keys), dtype=np.int64)
    inverse[at] = np.cumsum(new) - 1
    return found[new], at[new], inverse


def pack(sorted_keys: np.ndarray) -> bytes:
    """Rising 64-bit keys as byte planes of their differences; the high planes are nearly all zero and compress away."""
    return np.diff(sorted_keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    """The prefix group of a key: rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
