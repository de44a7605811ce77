"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, only, release, remove, stored, utf8

#: Rows in the last category, and rows outside it, that a chain is fitted on, at most.
SAMPLE = (4000, 16000)
#: Bytes of features that the driver takes of the sample, at most: the rows of smallest id hashes that fit.
SAMPLE_BYTES = 96 << 20
#: Word and stem features of a model, at most; those most telling of the category come first.
FEATURES = 2048
FOLDS = 5
_WORDS = re.compile(r"[^\W\d_]+")
_STEMS = (4, 5, 6)
_DENSE = 5


def _hash(kind: int, word: str) -> int:
    return xxhash.xxh32_intdigest(word.encode(), kind)


def terms(text: str | None) -> set[str]:
    """The distinct lower-case words of a text."""
    return set(_WORDS.findall((text or "").lower()))


def term_hashes(words: set[str]) -> set[int]:
    """Features of a text: its words (kind 0) and the stems of 4 to 6 letters of longer words (kind = letters)."""
    out = {_hash(0, w) for w in words}
    for n in _STEMS:
        out |= {_hash(n, s) for s in {w[:n] for w in words if len(w) > n}}
    return out


def dense(data: bytes, distinct: int) -> list[float]:
    """Shares of capitals, of marks and of digits among characters, distinct words over their square root law, and length."""
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    capitals, digits = counts[65:91].sum(), counts[48:58].sum()
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    return [capitals / n, marks / n, digits / n, np.log1p(distinct) / np.log1p(n), np.log1p(n) / 20]


def _block(x: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Some rows of (binary features, others) as numbers, with a one for the intercept."""
    return np.hstack((x[0][rows], x[1][rows], np.ones((len(rows), 1))))


def _linear(x: tuple[np.ndarray, np.ndarray], w: np.ndarray) -> np.ndarray:
    return np.concatenate([_block(x, r) @ w for r in _parts(np.arange(len(x[0])))] or [np.zeros(0)])


def _parts(rows: np.ndarray, size: int = 1024) -> list[np.ndarray]:
    return [rows[at : at + size] for at in range(0, len(rows), size)]


def fit_logistic(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, use: np.ndarray, l2: float = 1e-5, turns: int = 30) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps over the rows ``use``; both classes weigh alike.

    Binary features stay bytes; numbers are made for a thousand rows at a time.
    """
    rows = np.flatnonzero(use)
    w = np.zeros(x[0].shape[1] + x[1].shape[1] + 1)
    share = np.where(y, 0.5 / max(1, y[rows].sum()), 0.5 / max(1, (~y[rows]).sum()))
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-6
    for _ in range(turns):
        g, h = ridge * w, np.diag(ridge)
        for part in _parts(rows):
            block = _block(x, part)
            p = sigmoid(block @ w)
            g += block.T @ (share[part] * (p - y[part]))
            h += (block * (share[part] * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ block
        step = np.linalg.solve(h, g)
        w -= step * min(1, 10 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Link:
    """One category: its features (hash -> column), weights and threshold."""

    name: str
    columns: dict[int, int]
    weights: np.ndarray
    threshold: float

    def matrix(self, hashed: Sequence[np.ndarray], extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(hashed), len(self.columns)), dtype=np.uint8)
        for k, found in enumerate(hashed):
            hit = [self.columns[h] for h in found if h in self.columns]
            x[k, hit] = 1
        return x, extra


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def predict(self, hashed: Sequence[np.ndarray], shapes: np.ndarray) -> np.ndarray:
        """Probabilities, a column per category in order; each link sees those of the links before it."""
        out = np.zeros((len(hashed), len(self.links)))
        for k, link in enumerate(self.links):
            out[:, k] = sigmoid(_linear(link.matrix(hashed, out[:, :k] if k else shapes), link.weights))
        return out


def _counts(hashed: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features in order and how many rows have each; sorted in place, for the driver's memory."""
    flat = np.concatenate([np.zeros(0, dtype="<u4"), *hashed])
    flat.sort()
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(flat)), dtype=bool), flat[1:] != flat[:-1])))
    return flat[at], np.diff(at, append=len(flat))


def _telling(hashed: Sequence[np.ndarray], y: np.ndarray, limit: int) -> dict[int, int]:
    """Features of the category by falling strength of evidence.

    A feature counts if it is at least five times as frequent inside as outside, and if as many of its rows inside would come
    about by chance with a probability under one in a million (a bound on the binomial tail by relative entropy).
    """
    every, total = _counts(hashed)
    own, times = _counts([h for h, inside in zip(hashed, y, strict=True) if inside])
    inside = np.zeros(len(every), dtype=np.int64)
    inside[np.searchsorted(every, own)] = times
    outside = total - inside
    n, m = max(1, y.sum()), max(1, (~y).sum())
    ratio = ((inside + 0.5) / (n + 1)) / ((outside + 0.5) / (m + 1))
    prior = n / (n + m)
    share = inside / np.maximum(1, total)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.where(share > 0, share * np.log(share / prior), 0.0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - prior)), 0.0)
    strength = total * entropy
    good = np.flatnonzero((ratio >= 5) & (strength >= np.log(1e6)))
    good = good[np.lexsort((every[good], -strength[good]))][:limit]
    return {int(h): k for k, h in enumerate(every[good])}


def _unlike(hashed: Sequence[np.ndarray]) -> list[int]:
    """Rows of which no earlier row is a near copy, going by two signatures of three minimum hashes."""
    seen: set[tuple[int, ...]] = set()
    out = []
    factors = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], dtype=np.uint32)
    for k, h in enumerate(hashed):
        if not len(h):
            continue
        least = [int((h * f).min()) for f in factors]
        keys = {(0, *least[:3]), (1, *least[3:])}
        if not keys & seen:
            out.append(k)
        seen |= keys
    return out


def _fit_link(name: str, hashed: list[np.ndarray], extra: np.ndarray, y: np.ndarray) -> tuple[Link, np.ndarray]:
    """A link fitted on all rows, and the out-of-fold probabilities of the rows, which later links are fitted on."""
    fold = np.arange(len(y)) % FOLDS
    apart = np.zeros(len(y))
    for f in range(FOLDS):
        use = fold != f
        if y[use].all() or not y[use].any():
            apart[fold == f] = y[use].mean() if use.any() else 0.0
            continue
        link = Link(name, _telling([h for h, u in zip(hashed, use, strict=True) if u], y[use], FEATURES), np.zeros(0), 0.5)
        x = link.matrix(hashed, extra)
        w = fit_logistic(x, y, use)
        apart[~use] = sigmoid(_linear((x[0][~use], x[1][~use]), w))
    link = Link(name, _telling(hashed, y, FEATURES) if len(y) else {}, np.zeros(0), 0.5)
    if len(y) and y.any() and not y.all():
        link.weights = fit_logistic(link.matrix(hashed, extra), y, np.ones(len(y), dtype=bool))
    else:
        link.weights = np.zeros(len(link.columns) + extra.shape[1] + 1)
        link.weights[-1] = 30.0 if len(y) and y.all() else -30.0
    link.threshold = _threshold(apart, y)
    return link, apart


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the largest out-of-fold hits less three times the false alarms, in shares; 0.5 where one class lacks."""
    if not len(y) or y.all() or not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    gain = np.cumsum(y[order]) / y.sum() - 3 * np.cumsum(~y[order]) / (~y).sum()
    cut = p[order]
    last = np.flatnonzero(np.append(np.diff(cut) != 0, True))
    best = last[np.argmax(gain[last])]
    low = cut[best + 1] if best + 1 < len(cut) else 0.0
    return float(np.clip((cut[best] + low) / 2, 0.05, 0.95))


_FEATURES = "order bigint, labels array<boolean>, hashed binary, shape array<double>"


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text", sample: tuple[int, int] = SAMPLE) -> Chain:
    """Fit a chain over boolean columns of ``labels``, in order, on a bounded sample of the labelled rows (see SAMPLE), near copies left out.

    Rows with a null text, id or label are left out; the sample is the one of smallest id hashes. It is drawn from the labels alone,
    so it is the bounded side of a broadcast join. Features are found where the texts are read; the driver gets hashes only, SAMPLE_BYTES of them at most. Shape features are
    for the first category; later ones get its probability.
    """
    keys = labels.select(F.col(id_col).alias("label_id"), F.array(*[F.col(c).cast("boolean") for c in categories]).alias("labels"))
    keys = keys.where("label_id is not null and not exists(labels, x -> x is null)").withColumn("order", F.xxhash64("label_id"))
    last = F.element_at("labels", -1)
    inside, outside = (keys.where(c).orderBy("order", "label_id").limit(n) for c, n in ((last, sample[0]), (~last, sample[1])))
    rows = only(docs, id=id_col, text=text_col).where("text is not null")
    taken = rows.join(F.broadcast(inside.unionAll(outside)), F.col("id") == F.col("label_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            hashed, shapes = [], []
            for t in batch.column("text"):
                words = terms(t.as_py())
                hashed.append(np.array(sorted(term_hashes(words)), dtype="<u4").tobytes())
                shapes.append(dense(t.as_py().encode(), len(words)))
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("labels"), pa.array(hashed, pa.binary()), pa.array(shapes, pa.list_(pa.float64()))], ["order", "labels", "hashed", "shape"])

    place = new_path(docs.sparkSession, "sample")
    made = stored(taken.select("order", "labels", "text").mapInArrow(run, _FEATURES), place)
    sizes = made.select("order", F.octet_length("hashed").alias("size")).orderBy("order").toArrow()  # two numbers for each row of the sample
    inside = np.cumsum(sizes.column("size").to_numpy()) <= SAMPLE_BYTES
    if not inside.all():
        made = made.where(F.col("order") < F.lit(sizes.column("order")[int(np.argmin(inside))].as_py()))
    got = made.toArrow()
    remove(docs.sparkSession, place)
    hashed = [np.frombuffer(h.as_buffer(), dtype="<u4") for h in got.column("hashed")]
    order = sorted(range(len(hashed)), key=lambda k: hashed[k].tobytes())
    order = [order[k] for k in _unlike([hashed[k] for k in order])]
    hashed = [hashed[k] for k in order]
    marks = [got.column("labels")[k].as_py() for k in order]
    shapes = np.array([got.column("shape")[k].as_py() for k in order]).reshape(len(order), _DENSE)
    chain, earlier = Chain(), np.zeros((len(order), 0))
    for k, name in enumerate(categories):
        link, apart = _fit_link(name, hashed, earlier if k else shapes, np.array([m[k] for m in marks], dtype=bool))
        chain.links.append(link)
        earlier = np.hstack((earlier, apart[:, None]))
    return chain


class _Lookup:
    """Known hashes of a word's features, kept by word."""

    def __init__(self, chain: Chain):
        self.wanted = {h for link in chain.links for h in link.columns}
        self.kept: dict[str, tuple[int, ...]] = {}

    def __call__(self, words: set[str]) -> set[int]:
        out: set[int] = set()
        kept = self.kept
        for w in words:
            got = kept.get(w)
            if got is None:
                if len(kept) > 300_000:
                    kept.clear()
                got = kept[w] = tuple(h for h in term_hashes({w}) if h in self.wanted)
            if got:
                out.update(got)
        return out


def _judge(model: Chain, look: _Lookup, texts: pa.Array) -> np.ndarray:
    """Probabilities of the texts, a column per category; wordless ones have none."""
    hashed, shapes, blank = [], [], []
    for data in utf8(texts):
        words = terms((data or b"").decode())
        hashed.append(look(words))
        shapes.append(dense(data or b"", len(words)))
        blank.append(not words)
    p = model.predict(hashed, np.array(shapes).reshape(len(shapes), _DENSE))
    p[np.array(blank, dtype=bool)] = 0.0
    return p


def classify(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row (id, one probability per category, and whether each is over its threshold), judged on the whole text.

    Null and empty texts are in no category (probabilities 0). Repeated rows are judged alike, an empty table gives no rows, and only
    the two named columns are read.
    """
    docs = only(df, id=id_col, text=text_col)
    shared = df.sparkSession.sparkContext.broadcast(chain)  # at most FEATURES weights for each category
    names = [link.name for link in chain.links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model, look = shared.value, _Lookup(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                p = _judge(model, look, part.column("text"))
                over = [p[:, k] > link.threshold for k, link in enumerate(model.links)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c) for c in p.T), *(pa.array(o) for o in over)], ["id", *(f"p_{n}" for n in names), *names])

    schema = ", ".join([f"id {dict(docs.dtypes)['id']}", *(f"`p_{n}` double" for n in names), *(f"`{n}` boolean" for n in names)])
    return docs.mapInArrow(run, schema)


def drop(df: DataFrame, chain: Chain, category: str, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are not over the category's threshold, all columns kept; see classify. Columns go by place."""
    shared = df.sparkSession.sparkContext.broadcast(chain)
    text = df.columns.index(text_col)
    at = [link.name for link in chain.links].index(category)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model, look = shared.value, _Lookup(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                p = _judge(model, look, part.column(text))
                yield part.filter(pa.array(p[:, at] <= model.links[at].threshold))

    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


CATEGORIES = ("junk", "toxic")


def categories_of(labels: DataFrame) -> DataFrame:
    """The labels table as two categories: junk (quality 0) and toxic."""
    return labels.select("doc_id", (F.col("quality") == 0).alias("junk"), (F.col("toxic") == 1).alias("toxic"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = train(docs, categories_of(labels), CATEGORIES)
    return classify(docs, chain).withColumnRenamed("id", "doc_id")
