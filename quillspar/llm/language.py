"""Language identification by error-correcting output codes over n-gram classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, only, remove, stored

ORDERS = (2, 3, 4)
SLOTS = 1 << 14
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII other than letters becomes a space.
_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_CHUNK = 1 << 18


def ngram_slots(text: str) -> Iterator[np.ndarray]:
    """Hashed byte n-grams of the lower-cased text, block by block; words are set apart by one space."""
    data = b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" "
    for at in range(0, len(data), _CHUNK):
        b = np.frombuffer(data, dtype=np.uint8, count=min(_CHUNK + max(ORDERS) - 1, len(data) - at), offset=at).astype(np.uint32)
        code, out = b, []
        for n in range(2, max(ORDERS) + 1):
            code = (code[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
            if n in ORDERS:
                out.append(((code * np.uint32(2654435761)) >> np.uint32(18)) + np.uint32(SLOTS * ORDERS.index(n)))
        yield np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def code_matrix(classes: int) -> np.ndarray:
    """Codewords of +-1, a row per class. Up to 7 classes: every split of the classes; up to 512: the best of some random codes; else the first whose codewords all differ."""
    if classes <= 7:
        splits = range((1 << max(classes - 1, 0)) - 1)
        return np.array([[1] * len(splits)] + [[1 if s >> k & 1 else -1 for s in splits] for k in range(classes - 1)], dtype=np.int8)
    rng, best, most = np.random.default_rng(11), None, -1
    length = max(15, int(np.ceil(10 * np.log2(classes))))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), (classes, length))
        code = code[:, np.abs(code.sum(axis=0)) < classes]
        if classes > 512:  # all pairs would be too many, and codes of this length are far apart
            if len(np.unique(code, axis=0)) == classes:
                return code
            continue
        far = (code.shape[1] - code.astype(np.int32) @ code.T) // 2
        np.fill_diagonal(far, 1 << 30)
        if far.min() > most:
            best, most = code, far.min()
    return best


@dataclass
class Model:
    """Languages, their codewords, a weight for each bit and for each bit and n-gram."""

    languages: list[str]
    code: np.ndarray
    bit_weights: np.ndarray
    weights: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous). Each bit's classifier gives a margin; the nearest codeword has the least weighted
        logistic loss. The score is its share under a softmax of the losses; a lead of less than 2 to 1 is ambiguous."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        total, n = np.zeros(self.weights.shape[1]), 0
        for slots in ngram_slots(text):
            total += self.weights[slots].sum(axis=0)
            n += len(slots)
        margin = total / np.sqrt(n)
        loss = (self.bit_weights * np.logaddexp(0, -self.code * margin)).sum(axis=1)
        share = np.exp(loss.min() - loss)
        order = np.argsort(loss, kind="stable")
        share /= share.sum()
        return self.languages[order[0]], float(share[order[0]]), bool(share[order[0]] < 2 * share[order[1]])


#: Languages whose counts the driver sets up the classifiers from, and a task holds at a time; those of more are made on the executors.
DENSE = 64


def train(df: DataFrame, text: str = "text", label: str = "lang", classes: int | None = None) -> Model:
    """Count the n-grams of every labelled row by language, on the executors, and set up the bits' classifiers.

    A bit's classifier is the log odds of an n-gram under the languages coded +1 against those coded -1, each language having
    equal weight. A bit counts by how far apart it sets the languages on average. Every language is learned, or the ``classes`` of most rows
    (ties: first by name) if that is given. The driver gets a number per language and slot for up to DENSE languages, and beyond that a number per
    bit and slot, bits growing with the logarithm of the languages.
    """
    rows = only(df, text=text, lang=label).where("text is not null and lang is not null")
    if classes is not None:
        learned = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(classes).collect()]
        rows = rows.where(F.col("lang").isin(*learned) if learned else F.lit(False))
    found = rows.mapInArrow(_count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    return _dense_model(found) if rows.select("lang").distinct().count() <= DENSE else _spread_model(found)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, slot, n) of the n-grams of the batches; a language may come several times."""
    slots, counts = SLOTS * len(ORDERS), {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, have in counts.items():
            some = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.int32()), pa.array(have[some])], ["lang", "slot", "n"])
        counts.clear()

    for batch in batches:
        for t, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            if has_letter(one := t.as_py()):
                if lang not in counts and len(counts) == DENSE:
                    yield from rows()
                have = counts.setdefault(lang, np.zeros(slots, dtype=np.int64))
                for found in ngram_slots(one):
                    have += np.bincount(found, minlength=slots)
    yield from rows()


def _single(languages: list[str]) -> Model:
    return Model(languages, np.zeros((len(languages), 0), dtype=np.int8), np.zeros(0), np.zeros((SLOTS * len(ORDERS), 0), dtype=np.float32))


def _dense_model(counted: DataFrame) -> Model:
    """The model of counts (lang, slot, n), set up in the driver."""
    slots, found = SLOTS * len(ORDERS), counted.toPandas()
    languages = sorted(found["lang"].unique())
    if len(languages) < 2:
        return _single(languages)
    counts = np.zeros((len(languages), slots))
    counts[found["lang"].map(languages.index).to_numpy(), found["slot"].to_numpy()] = found["n"].to_numpy()
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * slots)
    code = code_matrix(len(languages))
    up, down = (code.T > 0).astype(float), (code.T < 0).astype(float)
    odds = np.log((up / up.sum(axis=1, keepdims=True)) @ share) - np.log((down / down.sum(axis=1, keepdims=True)) @ share)
    apart = (code * (share @ odds.T)).clip(0).mean(axis=0)
    return Model(languages, code, apart / max(apart.mean(), 1e-9), odds.T.astype(np.float32))


def _spread_model(counted: DataFrame) -> Model:
    """The same model for any number of languages: the log odds are made by slot and the weights by language, on the executors."""
    spark, slots = counted.sparkSession, SLOTS * len(ORDERS)
    place = new_path(spark, "grams")
    grams = stored(counted, place)
    sums = {r.lang: r.n for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row per language, as the model has
    languages = sorted(sums)
    if len(languages) < 2:
        remove(spark, place)
        return _single(languages)
    code = code_matrix(len(languages))
    total = np.array([sums[x] for x in languages]) + 0.5 * slots
    shared = spark.sparkContext.broadcast(({x: k for k, x in enumerate(languages)}, code, total))

    def log_odds(at: np.ndarray, n: np.ndarray, code: np.ndarray, total: np.ndarray) -> np.ndarray:
        means = [(((code == side) * (0.5 / total)[:, None]).sum(axis=0) + ((code[at] == side) * (n / total[at])[:, None]).sum(axis=0)) / (code == side).sum(axis=0) for side in (1, -1)]
        return np.log(means[0]) - np.log(means[1])

    def by_slot(table: pa.Table) -> pa.Table:
        place_of, code, total = shared.value
        at = np.array([place_of[x] for x in table.column("lang").to_pylist()])
        odds = log_odds(at, table.column("n").to_numpy(), code, total)
        return pa.table({"slot": table.column("slot").slice(0, 1), "odds": pa.array([odds.tobytes()], pa.binary())})

    made = grams.groupBy("slot").applyInArrow(by_slot, "slot int, odds binary").toArrow()
    nothing = np.zeros(0, dtype=np.int64)
    odds = np.tile(log_odds(nothing, nothing, code, total), (slots, 1))
    for slot, row in zip(made.column("slot").to_pylist(), made.column("odds"), strict=True):
        odds[slot] = np.frombuffer(row.as_buffer())
    table_of = spark.sparkContext.broadcast((odds, odds.sum(axis=0)))

    def by_language(table: pa.Table) -> pa.Table:
        (place_of, code, total), (odds, whole) = shared.value, table_of.value
        k = place_of[table.column("lang")[0].as_py()]
        mean = (0.5 * whole + table.column("n").to_numpy() @ odds[table.column("slot").to_numpy()]) / total[k]
        return pa.table({"apart": pa.array([(code[k] * mean).clip(0)], pa.list_(pa.float64()))})

    rows = grams.groupBy("lang").applyInArrow(by_language, "apart array<double>").select(F.posexplode("apart").alias("bit", "apart"))
    apart = np.array([r.apart for r in rows.groupBy("bit").agg(F.avg("apart").alias("apart")).orderBy("bit").collect()])
    remove(spark, place)
    return Model(languages, code, apart / max(apart.mean(), 1e-9), odds.astype(np.float32))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row (id, lang_pred, score, ambiguous) from its whole text alone.

    Null texts and texts without a letter give 'und' with score 0, as does a model without languages; repeated rows are judged
    alike; an empty table gives no rows; only the two named columns are read.
    """
    docs = only(df, id=id_col, text=text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # a number per bit and slot: bounded by the code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            lang, score, doubt = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())], ["id", "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, lang_pred string, score double, ambiguous boolean")


def held_out(column: str, mod: int) -> Column:
    """Whether the crc32 of an id's text leaves 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod == 2, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out("doc_id", 4)))
    return identify(docs, model).withColumnRenamed("id", "doc_id").withColumn("held_out", held_out("doc_id", 4))
