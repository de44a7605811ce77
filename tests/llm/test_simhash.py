import re

import numpy as np
import xxhash

from quillspar.llm import simhash


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def closed(fps, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    for text in ("", None, "One", "a b c", "Ä b\tC d\x0be F", "x " * 50, "the quick brown fox jumps over the lazy dog"):
        assert simhash.fingerprint(None if text is None else text.encode()) == brute(text)
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    assert simhash.fingerprint(long.encode()) == brute(long)


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.int64)}
    for x in list(fps)[:60]:
        for _ in range(8):
            y = x
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                y ^= 1 << int(b)
            fps.add(y - (1 << 64) if y >> 63 else y)
    fps = sorted(fps)
    from quillspar.llm.components import components

    found = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp bigint"))).collect()}
    want = closed([x & ((1 << 64) - 1) for x in fps])
    ours = [found.get(x, x) for x in fps]
    pair = {}
    for a, b in zip(want, ours, strict=True):
        assert pair.setdefault(a, b) == b
    assert len(set(want)) == len(set(ours))


def test_edge_cases(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (9, None), (7, ""), (None, "a b c d e f"), (1, "q" * 100_000)]
    out = {(r.id, r.component) for r in simhash.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")).collect()}
    assert out == {(5, 3), (3, 3), (9, 7), (7, 7), (None, 3), (1, 1)}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_whole(spark):
    d = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in simhash.op4_simhash(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()
    fps = [brute(r.text) for r in docs]
    want = closed(fps)
    assert len(out) == len(docs)
    for r, f, w in zip(docs, fps, want, strict=True):
        assert out[r.doc_id].fingerprint == f"{f:016x}"
        assert out[r.doc_id].component_id == docs[w].doc_id
