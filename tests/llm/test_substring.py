import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from quillspar.llm import substring


def brute(rows, n=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    rank = lambda i: (i is None, i or 0)
    for i, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            least[key] = min(least.get(key, rank(i)), rank(i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if least[tuple(w[k : k + n])] < rank(i):
                gone[k : k + n] = [True] * n
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    out = substring.op1_substring(spark, d)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_edge_cases(spark):
    a = " ".join(f"w{i}" for i in range(20))
    rows = [(4, a), (2, f"x {a} y"), (9, None), (7, ""), (None, f"{a} z q"), (4, a + " t"), (None, a), (11, "v " * 40), (12, "v " * 14), (13, a[:40]), (3, f"{a} {a}"), (20, " ".join(f"u{i % 5000}" for i in range(400_000)))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, id string")
    out = substring.remove_repeats(df).collect()
    assert sorted([(r.id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out], key=str) == brute(rows)
    spans = {r.id: [(s.start, s.length) for s in r.spans] for r in out if r.id is not None}
    assert spans[3] == [(0, 20), (20, 20)] or spans[3] == [(0, 40)]
    assert spans[2] == []
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert substring.remove_repeats(spark.createDataFrame([(None, None)], "doc_id long, text string")).count() == 1


def test_prefixes_split_and_merge():
    draw = np.random.default_rng(1)
    counts = np.zeros(65536, dtype=np.int64)
    counts[draw.integers(0, 65536, 3000)] = draw.integers(1, 50, 3000)
    counts[777] = 100_000  # one prefix of two words
    p = substring.Prefixes(counts, 1000)
    x = substring.Suffixes(pa.table({"text": pa.array([b""])}), 13)
    x.symbols = np.repeat(np.arange(65536, dtype=np.uint16), counts)
    x.third = draw.integers(0, 1 << 64, len(x.symbols), dtype=np.uint64)
    sizes = np.bincount(p.of(x), minlength=p.groups)
    assert len(sizes) == p.groups and sizes.max() <= 1100 and p.groups < 2.2 * counts.sum() / 1000
    assert p.bits[777] == 7 and (p.bits > 0).sum() == 1


def test_small_groups_give_the_same(spark, monkeypatch):
    """Groups of some suffixes, blocks of some documents, and equal high bits of different suffixes."""
    draw = random.Random(4)
    rows = [(draw.choice([None, *range(40)]), " ".join(draw.choices("abc", k=draw.randrange(0, 60)))) for _ in range(150)]
    monkeypatch.setattr(substring, "text_blocks", lambda *a: 9)
    monkeypatch.setattr(substring.count_prefixes, "__defaults__", (50,))
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=5).collect()
    assert sorted([(r.id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out], key=str) == brute(rows, 5)
    high, low = np.array([5, 9, 5, 5, 9, 1], dtype=np.uint64), np.array([2, 0, 1, 2, 0, 7], dtype=np.uint16)
    assert substring._ordered(high, low).tolist() == [5, 2, 0, 3, 1, 4]
