"""Embedding functions in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 256


def hashed_vector(text: str, dimension: int = DIMENSION) -> np.ndarray:
    """Signed counts of the words' hashes, of length one; zero for a text without words."""
    out = np.zeros(dimension, dtype=np.float32)
    for word in text.lower().split():
        digest = blake2b(word.encode(), digest_size=8).digest()
        out[int.from_bytes(digest[:4], "little") % dimension] += 1 if digest[4] % 2 == 0 else -1
    norm = float(np.linalg.norm(out))
    return out / norm if norm > 0 else out


def embed(text: Column, dimension: int = DIMENSION) -> Column:
    """The hashed vector of a text; null for null."""
    return embed_with(lambda: lambda texts: [hashed_vector(t, dimension) for t in texts])(text)


def dense_model(name: str, dimension: int, batch: int = 8, max_length: int = 8192) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """What sets up a dense embedding model in a task, from files that are there before any network is asked. Needs the model's library on the executors."""

    def load() -> Callable[[list[str]], list[np.ndarray]]:
        import os

        os.environ.setdefault("HF_HUB_OFFLINE", "1")
        from FlagEmbedding import BGEM3FlagModel

        model = BGEM3FlagModel(name, use_fp16=False)

        def run(texts: list[str]) -> list[np.ndarray]:
            found = np.asarray(model.encode(texts, batch_size=batch, max_length=max_length)["dense_vecs"], dtype=np.float32)
            if found.shape != (len(texts), dimension):
                raise ValueError(f"the model gives vectors of {found.shape[-1]} numbers, not {dimension}")
            return list(found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12))

        return run

    return load


def provider(backend: str = "fake", name: str = "BAAI/bge-m3", dimension: int = 1024) -> Callable[[Column], Column]:
    """The column function of the configured backend: hashed vectors ('fake'), or a dense model that each task sets up once."""
    if backend.lower() == "fake":
        return lambda text: embed(text, dimension)
    return embed_with(dense_model(name, dimension), 8)


def embed_with(load: Callable[[], Callable[[list[str]], list[np.ndarray]]], batch: int = 64) -> Callable[[Column], Column]:
    """A column function by a model that ``load`` sets up once in each task; it takes ``batch`` texts at a time."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for texts in batches:
            out: list = []
            for at in range(0, len(texts), batch):
                some = texts.slice(at, batch).to_pylist()
                made = iter(model([t for t in some if t is not None]))
                out += [None if t is None else next(made).tolist() for t in some]
            yield pa.array(out, pa.list_(pa.float32()))

    return run
