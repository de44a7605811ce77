"""A hierarchical Pitman-Yor bigram model: seating by Gibbs, predictive probabilities averaged over seatings."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import distinct, group_of, grouped, hash_texts, mix, pack, text_blocks, unpack
from .common import new_path, release, remove, stored
from .language import held_out

#: Chains, and sweeps of each; the seatings of the last sweep are averaged.
SAMPLES, SWEEPS = 3, 3
#: Dishes of up to SMALL customers are drawn from a table of Stirling numbers, others from one of their ratios; its rows go up to LARGE. See seat.
SMALL, LARGE = 12, 1 << 11
THETA, THETA_ROOT = 2.0, 20.0
END, START = np.uint64(0x1E0D5EED00000001), np.uint64(0x57A7700000000001)
#: Blocks are a third of other operators', as more arrays are held for each; there are a fourth as many groups of words as of bigrams.
_SHARE, _WORDS = 3, 4


def _planes(values: list[np.ndarray]) -> bytes:
    """Rows of non-negative integers as byte planes, as many for each row as its largest needs, squeezed."""
    out = [len(values[0]).to_bytes(4, "little")]
    for row in values:
        width = max(1, (int(row.max(initial=0)).bit_length() + 7) // 8)
        out += [bytes([width]), np.ascontiguousarray(row, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _from_planes(blob: bytes) -> np.ndarray:
    blob = zstandard.ZstdDecompressor().decompress(blob)
    n, at, rows = int.from_bytes(blob[:4], "little"), 4, []
    while at < len(blob):
        width = blob[at]
        row = np.zeros((n, 8), dtype=np.uint8)
        row[:, :width] = np.frombuffer(blob, dtype=np.uint8, count=width * n, offset=at + 1).reshape(width, n).T
        rows.append(row.view("<i8").ravel())
        at += 1 + width * n
    return np.array(rows)


def uniform(keys: np.ndarray, *place: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the keys and the place in the computation alone, so any task draws them alike."""
    salt = 0
    for p in place:
        salt = (salt * 0x9E3779B97F4A7C15 + p + 1) & ((1 << 64) - 1)
    return (mix(mix(keys ^ np.uint64(salt)) + np.uint64(salt)) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-54


def arrangements(discount: float) -> np.ndarray:
    """S[c, t]: the weight of all seatings of c customers at t tables, up to SMALL customers (generalised Stirling numbers)."""
    s = np.zeros((SMALL + 1, SMALL + 1))
    s[0, 0] = 1
    for c in range(SMALL):
        s[c + 1, 0] = c * s[c, 0]
        s[c + 1, 1:] = s[c, :-1] + (c - discount * np.arange(1, SMALL + 1)) * s[c, 1:]
    return s


@lru_cache(8)
def _ratios(discount: float, width: int) -> np.ndarray:
    """In row c, up to LARGE, log(S(c, t) / S(c, 1) * discount**(t - 1) * (t - 1)!) for t = 1..width; it rises to 0 with c."""
    q, out = np.zeros(width, dtype=np.longdouble), np.full((LARGE + 1, width), -np.inf)
    q[0], out[1, 0] = 1, 0
    rate = discount * np.arange(1, width).astype(np.longdouble)
    for c in range(1, LARGE):
        top = min(c + 1, width)  # no more tables than customers
        q[1:top] += rate[: top - 1] / (c - discount) * (q[: top - 1] - q[1:top])
        with np.errstate(divide="ignore"):
            out[c + 1, :top] = np.log(q[:top])
    return out


def _reach(width: int) -> float:
    """A weight / discount up to which more than ``width`` tables have a chance under 2**-56: less than the rounding of the sums, so rows cut there draw the same.

    Tables less one are a Poisson number of this mean, weighted by what falls with it, so Chernoff's bound of that number's tail is one of theirs.
    """
    low, high = 0.0, float(width)
    for _ in range(60):
        x = (low + high) / 2
        low, high = (x, high) if x > 0 and width - x + width * math.log(x / width) < -56 * math.log(2) else (low, x)
    return low


#: Widths of the rows that dishes of more than SMALL customers are drawn from, four an octave, how far each reaches, and the cells worked on at a time.
_WIDTHS = [f << k for k in range(9) for f in (4, 5, 6, 7)] + [LARGE]
_REACH = [_reach(w) for w in _WIDTHS[:-1]]
_CELLS = 1 << 16


def _seat_many(keys: np.ndarray, c: np.ndarray, weight: np.ndarray, discount: float, sample: int) -> np.ndarray:
    """Tables of dishes of more than SMALL customers; see seat."""
    x, extra = np.maximum(weight, 1e-300) / discount, np.zeros(len(c), dtype=np.int64)
    far = np.flatnonzero(c > LARGE)
    if len(far):
        gamma = lambda v: np.array([math.lgamma(y) for y in v.tolist()])
        share = np.exp(gamma(c[far] - 2 * discount) - gamma(c[far] - discount) + math.lgamma(LARGE - discount) - math.lgamma(LARGE - 2 * discount))
        extra[far] = _poisson(x[far] * (1 - share), uniform(keys[far], sample, 100, 0))
        x[far] *= share
    c = np.minimum(c, LARGE)
    found = np.empty(len(c), dtype=np.int64)
    u = uniform(keys, sample, 0, 0)
    size = np.minimum(np.searchsorted(_REACH, x), np.searchsorted(_WIDTHS, c)).astype(np.uint8)
    by_size = np.argsort(size, kind="stable")
    ends = np.cumsum(np.bincount(size, minlength=len(_WIDTHS))).tolist()
    for width, first, end in zip(_WIDTHS, [0, *ends[:-1]], ends, strict=True):
        if first == end:
            continue
        of, t = by_size[first:end], np.arange(width)
        ratios, ways = _ratios(discount, min(LARGE, 64 * 4 ** max(0, math.ceil(math.log(width / 64, 4))))), np.array([math.lgamma(y + 1) for y in t.tolist()])
        step = max(1, _CELLS // width)
        for at in range(0, len(of), step):
            some = of[at : at + step]
            p = ratios[c[some], :width]
            p -= ways
            p += t * np.log(x[some])[:, None]
            p -= p.max(axis=1, keepdims=True)
            np.cumsum(np.exp(p, out=p), axis=1, out=p)
            found[some] = 1 + (p[:, :-1] < (u[some] * p[:, -1])[:, None]).sum(axis=1)
    return found + extra


def seat(keys: np.ndarray, counts: np.ndarray, weight: np.ndarray, discount: float, sample: int) -> np.ndarray:
    """Tables of each dish (a word in a restaurant) with ``counts`` customers; ``weight`` is that of a new table serving it.

    A blocked Gibbs step: all customers of a dish sit down anew at once, given the others. A table of n attracts with n - discount, a new one
    with ``weight``, so t tables have the probability S(c, t) weight**t over its sum. One customer has one table. S(c, t) is a
    table of generalised Stirling numbers up to SMALL customers; beyond, S(c, t) / S(c, 1) is held in logarithms, scaled to lie near 1. With the scaled
    ratio t - 1 is a Poisson number of mean weight / discount, weighted by the chance that a chain that loses one of n with probability
    n discount / (c - discount) at c customers has lost all when one customer is left. From LARGE customers up
    the losses of one chain are taken as independent of each other, which puts the tables added there at a Poisson number; the variance is then off by less
    than a share of tables * discount**2 / LARGE.
    """
    return Dishes(keys, counts).seat(weight, discount, sample)


class Dishes:
    """Dishes and their customers, sorted by these once for all chains; see seat."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.tables = np.minimum(counts, 1)
        sizes = np.minimum(counts, SMALL + 1).astype(np.uint8)  # sorted in one pass
        by_size = np.argsort(sizes, kind="stable")
        edges = np.searchsorted(sizes[by_size], np.arange(2, SMALL + 2, dtype=np.uint8)).tolist()
        self.small = [(size, at, keys[at]) for size, at in zip(range(2, SMALL + 1), np.split(by_size, edges)[1:-1], strict=True) if len(at)]
        self.big = by_size[edges[-1] :]
        self.big_keys, self.big_counts = keys[self.big], counts[self.big]

    def seat(self, weight: np.ndarray, discount: float, sample: int) -> np.ndarray:
        tables, ways = self.tables.copy(), arrangements(discount)
        for size, at, keys in self.small:
            a = weight[at]
            total, power, sums = np.zeros(len(at)), np.ones(len(at)), []
            for t in range(1, size + 1):
                power = power * a
                total = total + ways[size, t] * power
                sums.append(total)
            drawn = uniform(keys, sample, 0, 0) * total
            tables[at] = 1 + sum((x < drawn).view(np.uint8) for x in sums[:-1])
        if len(self.big):
            tables[self.big] = np.minimum(_seat_many(self.big_keys, self.big_counts, weight[self.big], discount, sample), self.big_counts)
        return tables


def _poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson numbers by inversion (normal approximation for means over 50)."""
    out, p = np.zeros(len(mean), dtype=np.int64), np.exp(-np.minimum(mean, 50))
    total, k = p.copy(), 0
    left = (u > total) & (mean <= 50)
    while left.any() and k < 200:
        k += 1
        p = p * mean / k
        total += p
        out[left] = k
        left &= u > total
    far = mean > 50
    if far.any():
        normal = NormalDist()
        z = np.array([normal.inv_cdf(x) for x in np.clip(u[far], 1e-12, 1 - 1e-12).tolist()])
        out[far] = np.maximum(0, np.round(mean[far] + z * np.sqrt(mean[far]))).astype(np.int64)
    return out


def pair_keys(before: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xA0761D6478BD642F) + mix(keys))


def places(size: int, *of: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rising numbers under ``size`` that are in any of the arrays, and for each array the places of its own among them."""
    have = np.zeros(size, dtype=bool)
    for some in of:
        have[some] = True
    place = np.cumsum(have) - 1
    return (np.flatnonzero(have), *(place[some] for some in of))


def gamma(keys: np.ndarray, shape: np.ndarray, *place: int) -> np.ndarray:
    """Gamma numbers of unit scale by rejection (Marsaglia and Tsang); as uniform, they depend on the keys and the place alone."""
    shape = np.broadcast_to(np.asarray(shape, dtype=np.float64), keys.shape)
    low = shape < 1
    d = shape + low - 1 / 3
    out, left, turn = np.zeros(len(keys)), np.arange(len(keys)), 0
    while len(left):
        u, v, w = (uniform(keys[left], *place, turn, k) for k in range(3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        cube = np.maximum(1 + x / np.sqrt(9 * d[left]), 0) ** 3
        with np.errstate(divide="ignore"):
            good = (cube > 0) & (np.log(w) < 0.5 * x * x + d[left] * (1 - cube + np.log(cube)))
        out[left[good]] = (d[left] * cube)[good]
        left, turn = left[~good], turn + 1
    out[low] *= uniform(keys[low], *place, 0, 3) ** (1 / shape[low])
    return out


def _read_tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the tokens, keys of their bigrams, and the texts' numbers of tokens and first places."""
    release()
    texts = table.column("text").cast(pa.binary()).to_pylist()
    parts, lengths = [], []
    lower = [t.lower() if t else b"" for t in texts]  # bytes.lower() changes A-Z alone
    size = first = 0
    for k, t in enumerate(lower):
        size += len(t)
        if size > 4 << 20 or k + 1 == len(lower):
            hashes, offsets = hash_texts(lower[first : k + 1])
            parts.append(hashes)
            lengths.append(np.diff(offsets))
            size, first = 0, k + 1
    words = np.concatenate(lengths) if lengths else np.zeros(0, dtype=np.int64)
    sizes = words + 1
    starts = np.cumsum(sizes) - sizes
    keys = np.full(int(sizes.sum()), END)
    inner = np.ones(len(keys), dtype=bool)
    inner[starts + words] = False
    keys[inner] = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[starts] = START
    return keys, pair_keys(before, keys), sizes, starts


def _times(rising: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each of the rising keys is among ``keys``."""
    keys = np.sort(keys)
    return np.searchsorted(keys, rising, "right") - np.searchsorted(keys, rising)


def counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words and bigrams of a block with their training counts. START counts as a word once for each training document."""
    keys, pairs, sizes, starts = _read_tokens(table)
    own = ~table.column("held_out").to_numpy()
    trained = np.repeat(own, sizes)
    words = distinct(np.concatenate((keys, [START])))
    count = _times(words, keys[trained])
    count[np.searchsorted(words, START)] += int(own.sum())
    every = distinct(pairs)
    return words, count, every, _times(every, pairs[trained])


class Tokens:
    """The words and bigrams of a block: distinct keys and, for each token, which it has."""

    def __init__(self, table: pa.Table):
        keys, pairs, self.sizes, self.starts = _read_tokens(table)
        self.words, _, self.word = grouped(np.concatenate((keys, [START])))
        self.context = np.empty_like(self.word[:-1])
        start, self.word = self.word[-1], self.word[:-1]
        self.context[1:] = self.word[:-1]
        self.context[self.starts] = start
        self.pairs, at, self.pair = grouped(pairs)
        self.pair_word, self.pair_context = self.word[at], self.context[at]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    names, types = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.table([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


#: Rows of the exchanges. ``kind`` tells words, bigrams and what a block or a group keeps apart; ``totals`` are a group's sums.
WORDS, PAIRS, OPEN, KEPT, BEFORE, TOTALS = range(6)
_ROW = "kind int, part int, block int, keys binary, counts binary, totals array<double>"


def _send(block: int, kind: int, keys: np.ndarray, values: list[np.ndarray], parts: int) -> list[tuple]:
    edges = np.searchsorted(group_of(keys, parts), np.arange(parts + 1)).tolist()
    return [(kind, g, block, pack(keys[a:b]), _planes([v[a:b] for v in values]), None) for g, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


class Sent:
    """What blocks sent to a key group: the distinct keys, the sums of each, and the way back to every block's own order."""

    def __init__(self, table: pa.Table):
        self.blocks = table.column("block").to_pylist()
        self.part = table.column("part")[0].as_py()
        self.keys = [unpack(b.as_py()) for b in table.column("keys")]
        self.values = np.hstack([_from_planes(b.as_py()) for b in table.column("counts")])
        self.every, _, self.inverse = grouped(np.concatenate(self.keys))

    def sums(self) -> np.ndarray:
        return np.array([np.bincount(self.inverse, v, len(self.every)) for v in self.values]).round().astype(np.int64)

    def replies(self, kind: int, rows: list[np.ndarray], wanted: np.ndarray | None = None, totals: list[float] | None = None) -> list[tuple]:
        """A row for each block with the rows' values of its keys, or of those of its keys that are wanted (a mask over what was sent)."""
        out, at = [], 0
        for block, k in zip(self.blocks, self.keys, strict=True):
            own = self.inverse[at : at + len(k)]
            if wanted is not None:
                own = own[wanted[at : at + len(k)]]
            at += len(k)
            if len(own):
                out.append((kind, self.part, block, None, _planes([r[own] for r in rows]), None))
        return out + ([(TOTALS, self.part, -1, None, None, totals)] if totals is not None else [])


def _received(table: pa.Table, kind: int) -> np.ndarray:
    part = table.filter(pc.equal(table.column("kind"), kind)).sort_by("part")
    got = [_from_planes(b.as_py()) for b in part.column("counts")]
    return np.hstack(got) if got else np.zeros((1, 0), dtype=np.int64)


def _count_answer(table: pa.Table) -> pa.Table:
    """Global counts of words (WORDS) or of bigrams (PAIRS: twice the count, and one more for the block that is first to have it)."""
    release()
    sent, kind = Sent(table), table.column("kind")[0].as_py()
    total = sent.sums()[0]
    real = sent.every != START if kind == WORDS else np.ones(len(total), dtype=bool)
    totals = [0.0] * 8
    totals[4 * kind : 4 * kind + 4] = [float(total[real].sum()), *(float(x[real].sum()) for x in (total > 0, total == 1, total == 2))]
    if kind == WORDS:
        return _table(sent.replies(kind, [total], totals=totals), _ROW)
    owner = np.repeat(sent.blocks, [len(k) for k in sent.keys])
    first = np.full(len(total), np.iinfo(np.int64).max)
    np.minimum.at(first, sent.inverse, np.where(sent.values[0] > 0, owner, np.iinfo(np.int64).max))
    mine = (first[sent.inverse] == owner).astype(np.int64) + 2 * total[sent.inverse]
    sent.inverse = np.arange(len(mine))
    return _table(sent.replies(kind, [mine], totals=totals), _ROW)


def discounts(totals: list[float]) -> tuple[float, float]:
    """Discounts of the root and of the bigram restaurants, from the words and bigrams met once and twice."""
    of = lambda one, two: float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one and two else 0.5
    return of(totals[2], totals[3]), of(totals[6], totals[7])


class Model:
    """The model's numbers that all tasks share: counts, discounts, and for each round and chain the root's totals.

    ``rounds[k][s]`` is (customers, tables, measure of all words, measure of what is left, scale of new tables) of the root after k sweeps.
    """

    def __init__(self, totals: list[float], samples: int):
        self.n, self.v, self.samples = totals[0], totals[1], samples
        self.root, self.discount = discounts(totals)
        self.rounds: list[list[tuple[float, ...]]] = []

    def scale(self, sample: int) -> float:
        """The auxiliary number of the root that its dishes' tables are drawn by: gamma with the tables of the round before (at first one for each word)."""
        tables = self.rounds[-1][sample][1] if self.rounds else self.v
        return float(gamma(np.array([0xB0], dtype=np.uint64), THETA_ROOT / self.root + tables, len(self.rounds), sample, 7)[0])

    def root_tables(self, keys: np.ndarray, customers: np.ndarray, scale: float, turn: int, sample: int) -> np.ndarray:
        return seat(keys, customers, np.full(len(keys), self.root * scale / (self.v + 1)), self.root, (turn * self.samples + sample) * 2)

    def measure(self, keys: np.ndarray, customers: np.ndarray, tables: np.ndarray, turn: int, sample: int) -> np.ndarray:
        """The words' shares of the root's measure, before they are made to sum to one."""
        some = customers > 0
        out = np.zeros(len(keys))
        out[some] = gamma(keys[some], customers[some] - self.root * tables[some], turn, sample, 8)
        return out

    def add_round(self, sums: list[float]) -> None:
        """``sums`` has for each chain customers, tables and measure of the words that groups keep; the last is the number of words that are one customer."""
        turn, found, ones = len(self.rounds), [], sums[-1]
        for s in range(self.samples):
            customers, tables, measure = (x + y for x, y in zip(sums[3 * s : 3 * s + 3], (ones, ones, 0.0), strict=True))
            key = np.array([0xA0], dtype=np.uint64)
            if ones:
                measure += float(gamma(key, ones * (1 - self.root), turn, s, 9)[0])
            found.append((customers, tables, measure, float(gamma(key, THETA_ROOT + self.root * tables, turn, s, 10)[0])))
        self.rounds.append(found)

    def draws(self, turn: int, words: np.ndarray, seen: np.ndarray, pair_word: np.ndarray, pair_context: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
        """For each chain, tables of bigrams with more than one customer after sweep ``turn`` + 1, given what round ``turn`` has ``seen`` of the words.

        ``seen`` has for each chain customers, tables in the root, and tables of its own restaurant for each word. Given the root's measure and a gamma number
        for each restaurant, dishes are independent of one another, so any block draws them alike and all at a time, and yet each draw is an exact Gibbs step.
        """
        used, pair_word, pair_context = places(len(words), pair_word, pair_context)
        words = words[used]
        dishes = Dishes(pair_keys(words[pair_context], words[pair_word]), counts)
        for sample in range(self.samples):
            customers, tables, own = seen[3 * sample : 3 * sample + 3, used]
            _, _, measure, rest = self.rounds[turn][sample]
            share = (self.measure(words, customers, tables, turn, sample) + rest / (self.v + 1)) / (measure + rest)
            scale = gamma(words, THETA / self.discount + own, turn, sample, 11)
            yield dishes.seat(self.discount * scale[pair_context] * share[pair_word], self.discount, (turn * self.samples + sample) * 2 + 1)

    def root_probability(self, sample: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The root's predictive probabilities after the last round."""
        c, t = self.rounds[-1][sample][:2]
        return (np.maximum(customers - self.root * tables, 0) + (THETA_ROOT + self.root * t) / (self.v + 1)) / (THETA_ROOT + c)


def _open(tokens: Tokens, replies: pa.Table, block: int, parts: int) -> list[tuple]:
    """What a block sends and keeps of the bigrams that it is first to have.

    Bigrams of one customer have one table in every seating, so only their numbers by word and by context matter; they and those of all bigrams go to the
    words' groups, with a mark on the words of the others. The others, with their words, stay in one row (OPEN) that sweeps work on.
    """
    reply = _received(replies, PAIRS)[0]
    count, own = reply >> 1, np.flatnonzero((reply & 1) & (reply > 1))
    one, many = own[count[own] == 1], own[count[own] > 1]
    size = len(tokens.words)
    of = lambda x, some: np.bincount(x[some], minlength=size)
    marked = (of(tokens.pair_word, many) + of(tokens.pair_context, many) > 0).astype(np.int64)
    values = [of(tokens.pair_word, one), of(tokens.pair_context, one), of(tokens.pair_word, own), of(tokens.pair_context, own), marked]
    rows = _send(block, WORDS, tokens.words, values, parts)
    if len(many):
        used = np.flatnonzero(marked)
        at = np.cumsum(marked) - 1
        rows.append((OPEN, -1, block, pack(tokens.words[used]), _planes([at[tokens.pair_word[many]], at[tokens.pair_context[many]], count[many]]), None))
    return rows


def _rounds_up(model: Model, keys: np.ndarray, customers: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
    """Root tables of the kept words for each chain, and the sums that Model.add_round takes but for the last."""
    turn, tables, sums = len(model.rounds), [], []
    for s in range(model.samples):
        found = model.root_tables(keys, customers[s], model.scale(s), turn, s)
        share = model.measure(keys, customers[s], found, turn, s).sum()
        tables.append(found)
        sums += [float(customers[s].sum()), float(found.sum()), float(share)]
    return tables, sums


def _words_opened(model: Model) -> Callable:
    """Round 0, every bigram at one table: what a group keeps of its words, and replies to blocks about the words of their OPEN bigrams."""

    def run(table: pa.Table) -> pa.Table:
        release()
        sent = Sent(table)
        one_c, one_t, all_c, all_t, marked = sent.sums()
        kept = np.flatnonzero((marked > 0) | (all_c > 1))
        tables, sums = _rounds_up(model, sent.every[kept], [all_c[kept]] * model.samples)
        full = [np.zeros(len(all_c), dtype=np.int64) for _ in tables]
        for x, y in zip(full, tables, strict=True):
            x[kept] = y
        rows = sent.replies(OPEN, [x for s in range(model.samples) for x in (all_c, full[s], all_t)], sent.values[4] > 0, [*sums, float(len(all_c) - len(kept) - (all_c == 0).sum() + (all_c[kept] == 0).sum())])
        if len(kept):
            now = [x for s in range(model.samples) for x in (all_c[kept], tables[s], all_t[kept])]
            rows.append((KEPT, sent.part, -1, pack(sent.every[kept]), _planes([one_c[kept], one_t[kept], *now]), None))
        return _table(rows, _ROW)

    return run


def _words_swept(model: Model) -> Callable:
    """A round's sums of the words' customers and tables, the root's tables given them, and replies."""

    def run(kept: pa.Table, table: pa.Table) -> pa.Table:
        release()
        if not kept.num_rows:
            return _table([], _ROW)
        keys = unpack(kept.column("keys")[0].as_py())
        fixed = _from_planes(kept.column("counts")[0].as_py())[:2]
        now = np.repeat(fixed[None], model.samples, axis=0)  # chain, (customers, tables of the own restaurant), word
        sent = Sent(table) if table.num_rows else None
        if sent is not None:
            at = np.searchsorted(keys, sent.every)
            now[:, :, at] += sent.sums().reshape(model.samples, 2, -1)
        tables, sums = _rounds_up(model, keys, list(now[:, 0]))
        values = [x for s in range(model.samples) for x in (now[s, 0], tables[s], now[s, 1])]
        rows = sent.replies(OPEN, [v[at] for v in values]) if sent is not None else []
        rows += [(TOTALS, kept.column("part")[0].as_py(), -1, None, None, [*sums, 0.0]), (KEPT, kept.column("part")[0].as_py(), -1, pack(keys), _planes([*fixed, *values]), None)]
        return _table(rows, _ROW)

    return run


def _sweep(model: Model, parts: int) -> Callable:
    """Draw a block's OPEN bigrams for all chains and send the sums by word and by context."""
    turn = len(model.rounds) - 1

    def run(state: pa.Table, replies: pa.Table) -> pa.Table:
        release()
        if not state.num_rows:
            return _table([], _ROW)
        words = unpack(state.column("keys")[0].as_py())
        pair_word, pair_context, counts = _from_planes(state.column("counts")[0].as_py())
        seen, values = _received(replies, OPEN), []
        for tables in model.draws(turn, words, seen, pair_word, pair_context, counts):
            values += [np.bincount(x, tables, len(words)).astype(np.int64) for x in (pair_word, pair_context)]
        return _table(_send(state.column("block")[0].as_py(), WORDS, words, values, parts), _ROW)

    return run


def _words_closed(samples: int) -> Callable:
    """Replies to all blocks about all their words: what the last sweep was drawn by, if any of the word's bigrams was, and its outcome."""

    def run(table: pa.Table) -> pa.Table:
        release()
        kind = table.column("kind")
        sent = Sent(table.filter(pc.equal(kind, WORDS)))
        _, _, all_c, all_t, marked = sent.sums()
        last = [x.copy() for _ in range(samples) for x in (all_c, np.minimum(all_c, 1), all_t)]
        before = [np.zeros(len(all_c), dtype=np.int64) for _ in last]
        for rows, which in ((before, BEFORE), (last, KEPT)):
            held = table.filter(pc.equal(kind, which))
            if held.num_rows:
                at = np.searchsorted(sent.every, unpack(held.column("keys")[0].as_py()))
                for row, x in zip(rows, _from_planes(held.column("counts")[0].as_py())[2:], strict=True):
                    row[at] = x
        for row in before:
            row[marked == 0] = 0
        return _table(sent.replies(OPEN, before + last), _ROW)

    return run


def score_texts(df: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, sweeps: int = SWEEPS, with_tokens: bool = False) -> DataFrame:
    """Per row (id, held_out, n_tokens, n_known, train_tokens, base_score, score), learning from rows where ``held`` is false; and each token's part of the score if ``with_tokens``.

    Tokens are the words, A-Z lowered, and one end. A word's restaurant is named by the word before; all share the root restaurant of
    words, whose base is uniform over the known words and one for all unknown ones. Customers of the root are the tables of the others.
    The score is the log10 probability of the row's tokens, each probability being the mean over the last seatings of ``samples`` chains of ``sweeps`` (one at least).

    Rows lie in blocks by a hash of id and text. A block sends its distinct words and bigrams with their training counts, by key group, and
    gets their global counts back in its own order. Sweeps work on the bigrams of more than one customer alone, each held by the block that is first to have
    it; words' groups hold the customers and tables of the words. Keys are 64-bit digests. A word that a third of all tokens are costs a number per block.
    Blocks and groups grow with the text and not with the number of partitions.

    Null texts are empty (one token, the end); null ids keep their rows; an empty table gives no rows; with no training rows all words are
    unknown. Only the two named columns and ``held`` are read. Rows of one id and one text share a block.
    """
    kind, names = dict(df.dtypes)[id_col], _NAMES + ["token_scores"] * with_tokens
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), held.alias("held_out"))
    n = text_blocks(docs, "text", _SHARE)
    parts = math.ceil(n / _WORDS)
    docs = docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))

    def first(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        words, word_counts, pairs, pair_counts = counted(table)
        return _table(_send(block, WORDS, words, [word_counts], parts) + _send(block, PAIRS, pairs, [pair_counts], n), _ROW)

    def second(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], _ROW)
        return _table(_open(Tokens(table), replies, table.column("block")[0].as_py(), parts), _ROW)

    def score(table: pa.Table, replies: pa.Table, closed: pa.Table, model: Model) -> pa.Table:
        tokens = Tokens(table)
        word, pair = _received(replies, WORDS)[0], _received(replies, PAIRS)[0] >> 1
        seen = _received(closed, OPEN)
        before, last = seen[: 3 * samples], seen[3 * samples :]
        many = np.flatnonzero(pair > 1)
        mean = np.zeros(len(pair))
        for s, drawn in enumerate(model.draws(len(model.rounds) - 2, tokens.words, before, tokens.pair_word[many], tokens.pair_context[many], pair[many])):
            tables = np.minimum(pair, 1)
            tables[many] = drawn
            customers, root, own = last[3 * s : 3 * s + 3]
            base = model.root_probability(s, customers, root)
            mean += (pair - model.discount * tables + (THETA + model.discount * own[tokens.pair_context]) * base[tokens.pair_word]) / (THETA + word[tokens.pair_context])
        each = np.log10(mean / samples)[tokens.pair]
        known = word[tokens.word]
        simple = np.log10((known + 1.0) / (model.n + model.v + 1))
        total = lambda x: np.add.reduceat(x, tokens.starts)
        columns = [table.column("id"), table.column("held_out"), pa.array(tokens.sizes, pa.int64()), pa.array(total((known > 0).astype(np.int64)), pa.int64()), pa.array([int(model.n)] * table.num_rows, pa.int64()), pa.array(total(simple)), pa.array(total(each))]
        if with_tokens:
            columns.append(pa.array(np.split(each, tokens.starts[1:]), pa.list_(pa.float64())))
        return pa.table(columns, names)

    def score_or_none(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
            return pa.table([pa.array([], table.schema.field("id").type), *(pa.array([], t) for t in kinds[: len(names) - 1])], names)
        is_closed = pc.equal(replies.column("kind"), OPEN)
        return score(table, replies.filter(pc.invert(is_closed)), replies.filter(is_closed), model)

    def summed(rows: DataFrame, size: int) -> list[float]:
        return list(rows.where(F.col("kind") == TOTALS).agg(*[F.coalesce(F.sum(F.get("totals", F.lit(k))), F.lit(0.0)) for k in range(size)]).first())  # one row

    def of(rows: DataFrame, kind: int) -> DataFrame:
        return rows.where(F.col("kind") == kind)

    counts = stored(docs.groupBy("block").applyInArrow(first, _ROW).groupBy("kind", "part").applyInArrow(_count_answer, _ROW))
    model = Model(summed(counts, 8), samples)
    counts = counts.where(F.col("kind") <= PAIRS)
    place = new_path(df.sparkSession, "sweeps")
    opened = stored(docs.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(second, _ROW), f"{place}/opened")
    now = stored(of(opened, WORDS).groupBy("part").applyInArrow(_words_opened(model), _ROW), f"{place}/0")
    sums = summed(now, 3 * samples + 1)
    ones, before = sums[-1], now
    model.add_round(sums)
    for k in range(1, max(1, sweeps) + 1):
        before = now
        sent = of(opened, OPEN).groupBy("block").cogroup(of(now, OPEN).groupBy("block")).applyInArrow(_sweep(model, parts), _ROW)
        now = stored(of(now, KEPT).groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(_words_swept(model), _ROW), f"{place}/{k}")
        model.add_round([*summed(now, 3 * samples), ones])
        if k > 1:
            remove(df.sparkSession, f"{place}/{k - 2}")
    words = of(opened, WORDS).unionAll(of(now, KEPT)).unionAll(of(before, KEPT).withColumn("kind", F.lit(BEFORE)))
    closed = stored(words.groupBy("part").applyInArrow(_words_closed(samples), _ROW))
    remove(df.sparkSession, place)
    return docs.groupBy("block").cogroup(counts.unionAll(closed).groupBy("block")).applyInArrow(score_or_none, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double" + ", token_scores array<double>" * with_tokens)


_NAMES = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, held_out("doc_id", 7)).withColumnRenamed("id", "doc_id")
