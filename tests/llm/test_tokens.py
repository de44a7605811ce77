import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillspar.llm import packing, tokens


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_library(library):
    rng = random.Random(7)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "\r", "'s", "'", "1", "23", ",", "!", "ÿ", " x", "\n ", " \n", "\xa0", "\x85", "中", "<|endoftext|>", "\x1c", "\xad", "😀", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["", None, "word " * 30_000]
    lengths, ids = tokens.Encoder().encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [library(t) for t in texts]


def test_segment_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        for top in (1, 255, 256, 65536, 1 << 31):
            x = rng.integers(0, top, n, dtype=np.uint32) if n else np.zeros(0, dtype=np.uint32)
            assert np.array_equal(tokens.unpack_ids(tokens.pack_ids(x)), x)


def test_token_output_whole_table(spark, library):
    d = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in tokens.op5_token_output(spark, d).collect()}
    at = 0
    for r in sorted(spark.read.parquet(f"{d}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = library(r.text)
        assert (out[r.doc_id].start, out[r.doc_id].n_tokens, out[r.doc_id].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_token_output_edges(spark, library, tmp_path):
    rows = [(5, None, 1), (3, "b c", 2), (None, "q", 3), (4, "", 4), (4, "twice", 5), (1, "é " * 50_000, 6), ((1 << 63) - 1, "last", 7)]
    tokens.write_token_files(spark.createDataFrame(rows, "doc_id long, text string, id int"), f"file://{tmp_path}/o")
    out = tokens.read_token_files(spark, f"file://{tmp_path}/o", with_ids=True).orderBy("start").collect()
    assert [r.id for r in out] == [1, 3, 4, 4, 5, (1 << 63) - 1, None]
    assert [r.ids for r in out if r.id in (1, 3, 5)] == [library("é " * 50_000), library("b c"), [0]]
    tokens.write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e")
    assert tokens.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def check_packing(rows, texts, library):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(texts)
    for i, got in docs.items():
        ids, at = library(texts[i]), 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.ids_crc32 == crc(ids[at : at + r.length]) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for got in sequences.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / total


def test_packing_whole_table(spark, library):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert check_packing(packing.op9_packing(spark, d).collect(), texts, library) < 0.02


def test_packing_edges(spark, library):
    rows = [(1, None, 0), (2, "", 0), (3, "a " * 3000, 0), (4, "b", 0)]
    odd = packing.pack(spark.createDataFrame([(None, "x y"), (None, "x y"), (7, "z"), (7, "z")], "doc_id long, text string")).collect()
    assert sorted((r.id or 0, r.length) for r in odd) == [(0, 3), (0, 3), (7, 2), (7, 2)] and len({(r.sequence_id, r.offset) for r in odd}) == 4
    df = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, start int")).withColumnRenamed("id", "doc_id")
    check_packing(df.collect(), {r[0]: r[1] for r in rows}, library)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_differencing_is_even():
    weights = np.random.default_rng(5).integers(1, 256, 400)
    bins = packing.differencing(weights, 40)
    sums = np.bincount(bins, weights=weights, minlength=40)
    assert sums.sum() == weights.sum() and sums.max() - sums.min() <= 30
